"""Names and patterns as column expressions. A backslash separates namespaces, :: a class and its member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .typing import is_builtin

SEP = "\\"


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, SEP, -1)


def namespace_of(fqn: Column) -> Column:
    return F.when(F.instr(fqn, SEP) > 0, F.substring(fqn, F.lit(1), F.length(fqn) - F.length(short_name(fqn)) - 1)).otherwise("")


def class_part(member: Column) -> Column:
    return F.when(F.instr(member, "::") > 0, F.substring_index(member, "::", 1))


def method_part(member: Column) -> Column:
    """What stands behind the first ::, or the whole without one."""
    at = F.instr(member, "::")
    return F.when(at > 0, F.substring(member, at + 2, F.length(member))).otherwise(member)


def import_key(alias: Column, fqn: Column) -> Column:
    return F.coalesce(alias, short_name(fqn))


def resolve_name(name: Column, imports: Column, namespace: Column) -> Column:
    """Fully qualified name: leading backslash, built-in, exact import, import of the first segment, own namespace, as it is."""
    first = F.substring_index(name, SEP, 1)
    rest = F.substring(name, F.length(first) + 1, F.length(name))
    return (
        F.when(name.startswith(SEP), F.substring(name, F.lit(2), F.length(name)))
        .when(is_builtin(name), name)
        .when(F.element_at(imports, name).isNotNull(), F.element_at(imports, name))
        .when((first != name) & F.element_at(imports, first).isNotNull(), F.concat(F.element_at(imports, first), rest))
        .when(F.length(namespace) > 0, F.concat(namespace, F.lit(SEP), name))
        .otherwise(name)
    )


def short_project(root: Column) -> Column:
    return F.regexp_extract(root, "([^/]+)/?$", 1)


def matches(function: Column, pattern: str) -> Column:
    """Whether a function name matches a pattern: exact, ::m (any class), C::m (class also by its last segments), or bare m; a bare name has the method of any class."""
    exact = function == F.lit(pattern)
    if pattern.startswith("::"):
        return exact | function.endswith(pattern) | (function == pattern[2:])
    if "::" in pattern:
        return exact | function.endswith(SEP + pattern) | (function == pattern.split("::", 1)[1])
    return exact | function.endswith("::" + pattern) | function.endswith(SEP + pattern)


def tails(name: Column) -> Column:
    """A name and what stands behind each of its backslashes."""
    parts = F.split(name, r"\\")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), SEP))


#: Ways in which two names may be the same function, by the keys that are equal then.
WHOLE, TAIL, BARE = "whole", "tail", "bare"


def suffix_index(names: DataFrame, column: str) -> DataFrame:
    """(column, key, how) of distinct names: each stands under itself and its tails, a member also under its bare method.

    A name is some other's tail where one's whole key is the other's tail key, so
    a match of tails is an equi-join, whose rows grow with segments of names.
    """
    c = F.col(column)
    keys = F.concat(
        F.array(F.struct(c.alias("key"), F.lit(WHOLE).alias("how"))),
        F.transform(F.slice(tails(c), 2, F.greatest(F.size(tails(c)) - 1, F.lit(0))), lambda t: F.struct(t.alias("key"), F.lit(TAIL).alias("how"))),
        F.when(F.instr(c, "::") > 0, F.array(F.struct(method_part(c).alias("key"), F.lit(BARE).alias("how")))).otherwise(F.array().cast("array<struct<key:string,how:string>>")),
    )
    return names.select(column).distinct().select(column, F.explode(keys).alias("x")).select(column, "x.key", "x.how")


def same_function(callees: DataFrame, functions: DataFrame) -> DataFrame:
    """(callee, function) of callees(callee) that may name functions(function): equal, the function's name behind a backslash
    of the callee's, a bare method name, or equal methods where the callee's class is a tail of the function's."""
    a = suffix_index(callees, "callee").withColumnRenamed("how", "callee_how")
    b = suffix_index(functions, "function").withColumnRenamed("how", "function_how")
    member = (F.instr("callee", "::") > 0) & (F.instr("function", "::") > 0)
    x, y = F.col("callee_how"), F.col("function_how")
    rule = ((x == WHOLE) & (y == WHOLE)) | ((x == TAIL) & (y == WHOLE)) | ((x == WHOLE) & (y == BARE) & (F.instr("callee", "::") == 0)) | ((x == WHOLE) & (y == TAIL) & member)
    return a.join(b, "key").where(rule).select("callee", "function").distinct()


def fuzzy_pairs(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(callee, pattern) of names(callee) and patterns(pattern) that may be the same: equal, either the other's tail, or equal
    methods where one has no class. The same as same_callee() holds for, by equi-joins."""
    a = suffix_index(names, "callee").withColumnRenamed("how", "callee_how")
    b = suffix_index(patterns, "pattern").withColumnRenamed("how", "pattern_how")
    x, y = F.col("callee_how"), F.col("pattern_how")
    bare = lambda how, other: (how == BARE) & (F.instr(other, "::") == 0)
    rule = ((x == WHOLE) & (y != BARE)) | ((y == WHOLE) & (x != BARE)) | (bare(x, "pattern") & (y == WHOLE)) | (bare(y, "callee") & (x == WHOLE))
    return a.join(b, "key").where(rule).select("callee", "pattern").distinct()


def tail_pairs(events: DataFrame, mapped: DataFrame) -> DataFrame:
    """event_pairs() but for *."""
    a = suffix_index(events, "event").where(F.col("how") != BARE).withColumnRenamed("how", "event_how")
    b = suffix_index(mapped.where("mapped <> '*'"), "mapped").where(F.col("how") != BARE).withColumnRenamed("how", "mapped_how")
    return a.join(b, "key").where((F.col("event_how") == WHOLE) | (F.col("mapped_how") == WHOLE)).select("event", "mapped").distinct()


def event_pairs(events: DataFrame, mapped: DataFrame) -> DataFrame:
    """(event, mapped) of distinct events(event) and mapped(mapped) for which event_matches() holds, by equi-joins; * stands for every event."""
    every = mapped.where("mapped = '*'").select("mapped").distinct()  # one row at most
    return tail_pairs(events, mapped).unionByName(events.select("event").distinct().crossJoin(F.broadcast(every)))


def same_callee(a: Column, b: Column) -> Column:
    """Whether two callee names may be the same function: equal, one the other's tail at a backslash, or equal methods of classes so related or unknown."""
    tail = lambda x, y: x.endswith(F.concat(F.lit(SEP), y))
    ca, cb = class_part(a), class_part(b)
    related = ca.isNull() | cb.isNull() | (ca == cb) | tail(ca, cb) | tail(cb, ca)
    return (a == b) | tail(a, b) | tail(b, a) | ((method_part(a) == method_part(b)) & (ca.isNotNull() | cb.isNotNull()) & related)


def event_matches(event: Column, mapped: Column) -> Column:
    tail = lambda x, y: x.endswith(F.concat(F.lit(SEP), y))
    return (mapped == "*") | (event == mapped) | tail(event, mapped) | tail(mapped, event)
