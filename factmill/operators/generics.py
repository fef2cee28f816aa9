"""Types with arguments as tables of terms: nested arguments, substitution by joins, bindings along the chain of ancestors.

A term is one type expression at any depth of a type: the type itself, its
arguments, their arguments. Types are few beside their uses, so everything here
works on different types and scopes; a scope is whatever binds template names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typing import kind
from .fixpoint import cut


def arguments(t: Column) -> Column:
    """The type arguments of a generic type: what stands between commas outside of inner brackets."""
    inner = F.regexp_extract(t, r"^[^<]*<(.*)>$", 1)
    pieces = F.regexp_extract_all(inner, F.lit(r"([<({\[]|[>)}\]]|,|[^<>(){}\[\],]+)"), 1)
    empty = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        parts = acc["parts"]
        last = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), x)))
        depth = acc["depth"] + F.when(x.isin("<", "(", "{", "["), 1).when(x.isin(">", ")", "}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((x == ",") & (acc["depth"] == 0), F.concat(parts, F.array(F.lit("")))).otherwise(last).alias("parts"))

    return F.filter(F.transform(F.aggregate(pieces, empty, step)["parts"], lambda x: F.trim(x)), lambda x: x != "")


def head(t: Column) -> Column:
    """The name before the arguments, without a question mark."""
    return F.regexp_extract(F.trim(t), r"^\??([^<]*)", 1)


def terms(types: DataFrame) -> DataFrame:
    """(type, path, depth, text, kind, head) of different types(type): path holds the place of each argument on the way down."""
    level = types.select(F.trim("type").alias("type")).where("type IS NOT NULL").distinct().select("type", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.col("type").alias("text"))
    described = lambda df: df.select("*", kind(F.col("text")).alias("kind"), head(F.col("text")).alias("head"))
    done: list[DataFrame] = []
    while True:  # as often as types are deep
        level = cut(described(level))
        done.append(level)
        inner = level.where("kind = 'generic'").select("type", "path", "depth", F.posexplode(arguments(F.col("text"))).alias("pos", "arg"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level = inner.select("type", F.concat("path", F.array("pos")).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("arg").alias("text"))


def substitute(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """(scope, type, result) of different uses(scope, type) under bindings(scope, name, bound), from the deepest terms up.

    A name becomes what it is bound to; ?T the bound type's nullable form; a
    generic's arguments are replaced one by one, and its own name by the bound
    type's; members of a union by the name of the bound type. Arrays,
    intersections and names that nothing binds stay.
    """
    uses = cut(uses.select("scope", F.trim("type").alias("type")).where("type IS NOT NULL").distinct())
    table = cut(terms(uses))
    bound = bindings.select("scope", F.col("name").alias("head"), "bound")
    deepest = table.agg(F.max("depth")).head()[0]
    above: DataFrame | None = None
    if deepest is None:
        return uses.select("scope", "type", F.lit(None).cast("string").alias("result"))
    for depth in range(deepest, -1, -1):
        here = uses.join(table.where(F.col("depth") == depth), "type").join(bound, ["scope", "head"], "left")
        of = F.when(F.col("bound").isNotNull(), head(F.col("bound")))
        # Members of unions, each on its own.
        member = here.where("kind = 'union_type'").select("scope", "type", "path", F.posexplode(F.transform(F.split("text", r"\|"), lambda x: F.trim(x))).alias("pos", "head"))
        member = member.join(bound, ["scope", "head"], "left").select("scope", "type", "path", "pos", F.coalesce(head(F.col("bound")), F.col("head")).alias("part"))
        union = member.groupBy("scope", "type", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "|").alias("joined"))
        here = here.join(union, ["scope", "type", "path"], "left")
        if above is not None:
            args = above.select("scope", "type", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("pos"), "result").alias("a"))
            args = args.groupBy("scope", "type", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["result"]), ", ").alias("args"))
            here = here.join(args, ["scope", "type", "path"], "left")
        else:
            here = here.withColumn("args", F.lit(None).cast("string"))
        text = F.col("text")
        result = (
            F.when(F.col("kind") == "simple", F.coalesce("bound", "text"))
            .when((F.col("kind") == "nullable") & F.col("bound").isNotNull(), F.concat(F.lit("?"), F.regexp_replace("bound", r"^\?", "")))
            .when(F.col("kind") == "generic", F.concat(F.coalesce(of, F.col("head")), F.lit("<"), F.coalesce("args", F.lit("")), F.lit(">")))
            .when(F.col("kind") == "union_type", F.col("joined"))
            .otherwise(text)
        )
        above = cut(here.select("scope", "type", "path", result.alias("result")))
    return above.select("scope", "type", "result")


def own_bindings(receivers: DataFrame, templates: DataFrame) -> DataFrame:
    """(scope, owner, name, bound): templates(owner, pos, name) of a receiver's class, bound to the receiver's arguments as far as there are any.

    receivers(type); the type's text is the scope. A raw use binds nothing.
    """
    used = receivers.select(F.trim("type").alias("type")).distinct().where(kind(F.col("type")) == "generic")
    given = used.select(F.col("type").alias("scope"), head(F.col("type")).alias("owner"), F.posexplode(arguments(F.col("type"))).alias("pos", "bound"))
    return given.join(templates.select("owner", "pos", "name"), ["owner", "pos"]).select("scope", "owner", "name", "bound")


def bindings(receivers: DataFrame, templates: DataFrame, extends: DataFrame) -> DataFrame:
    """(scope, owner, name, bound) for a receiver's class and all its ancestors.

    extends(class, type) says a parent with its arguments, in terms of the
    class's own templates. A step up substitutes what is bound so far into those
    arguments, for all receivers at once; a class doesn't come twice in a chain.
    """
    parents = cut(extends.select("class", F.trim("type").alias("type"), head(F.col("type")).alias("parent")).where("type IS NOT NULL"))
    at = cut(receivers.select(F.trim("type").alias("scope")).distinct().select("scope", head(F.col("scope")).alias("owner")))
    known = cut(own_bindings(receivers, templates))
    done, met = [known], at
    while True:
        step = cut(at.join(parents, at["owner"] == parents["class"]).select("scope", "owner", "parent", "type").join(met.select("scope", F.col("owner").alias("parent")), ["scope", "parent"], "left_anti"))
        if step.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # What a parent is given, by position; the substitution's scope is the receiver at this class.
        scope = F.concat_ws("\n", "scope", "owner")
        given = step.where(kind(F.col("type")) == "generic").select("scope", "owner", "parent", F.posexplode(arguments(F.col("type"))).alias("pos", "arg"))
        changed = substitute(given.select(scope.alias("scope"), F.col("arg").alias("type")), known.select(scope.alias("scope"), "name", "bound"))
        known = given.withColumn("at", scope).join(changed.select(F.col("scope").alias("at"), F.col("type").alias("arg"), F.col("result").alias("bound")), ["at", "arg"])
        known = cut(known.join(templates.select(F.col("owner").alias("parent"), "pos", "name"), ["parent", "pos"]).select("scope", F.col("parent").alias("owner"), "name", "bound"))
        done.append(known)
        at = cut(step.select("scope", F.col("parent").alias("owner")))
        met = cut(met.unionByName(at))


def method_returns(receivers: DataFrame, methods: DataFrame, templates: DataFrame, extends: DataFrame) -> DataFrame:
    """(type, owner, name, declared, result): what methods(owner, name, return_type) of a receiver's class and of its ancestors return to receivers(type).

    A name's nearest declaration counts. Without arguments the declared type is the result.
    """
    every = cut(bindings(receivers, templates, extends))
    parents = extends.select("class", head(F.col("type")).alias("parent"))
    at = cut(receivers.select(F.trim("type").alias("type")).distinct().select("type", head(F.col("type")).alias("owner"), F.lit(0).alias("far")))
    lines, met = [at], at
    while True:
        at = cut(at.join(parents, at["owner"] == parents["class"]).select("type", F.col("parent").alias("owner"), (F.col("far") + 1).alias("far")).join(met.select("type", "owner"), ["type", "owner"], "left_anti"))
        if at.isEmpty():
            break
        lines.append(at)
        met = cut(met.unionByName(at))
    declared = reduce(DataFrame.unionByName, lines).join(methods.select("owner", "name", F.col("return_type").alias("declared")), "owner")
    nearest = declared.groupBy("type", "name").agg(F.min("far").alias("far"))
    declared = cut(declared.join(nearest, ["type", "name", "far"]))
    scope = F.concat_ws("\n", "type", "owner")
    result = substitute(declared.select(scope.alias("scope"), F.col("declared").alias("type")), every.select(F.concat_ws("\n", "scope", "owner").alias("scope"), "name", "bound"))
    met = declared.withColumn("scope", scope).withColumn("trimmed", F.trim("declared")).join(result.withColumnRenamed("type", "trimmed"), ["scope", "trimmed"], "left")
    return met.select("type", "owner", "name", "declared", F.coalesce("result", "declared").alias("result"))
