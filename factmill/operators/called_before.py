"""Constraints of the form: A must be called before B.

calls: caller, callee_name, line, and for the interprocedural part target.
Within a caller only lines count; where no local A exists the callers decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import same_function
from .fixpoint import cut, nearest_by, reach

#: Calls up a chain after which a constraint counts as not kept (fixed value).
DEEPEST = 100


def local_checks(calls: DataFrame, before: Column, after: Column) -> DataFrame:
    """For every call of B in a caller with an A: wrong_order if its line is smaller than the first A's, matched with the
    closest A on a strictly smaller line, or neither on the same line. (caller, line, status, before_line)"""
    by = Window.partitionBy("caller")
    closest = by.orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    a_line = F.when(before, F.col("line"))
    marked = calls.where(before | after).select("caller", "line", after.alias("is_after"), F.min(a_line).over(by).alias("first"), F.max(a_line).over(closest).alias("before_line"))
    status = F.when(F.col("first").isNull(), "no_local").when(F.col("line") < F.col("first"), "wrong_order").when(F.col("before_line").isNotNull(), "matched").otherwise("same_line")
    return marked.where("is_after").select("caller", "line", status.alias("status"), F.when(F.col("line") >= F.col("first"), F.col("before_line")).alias("before_line"))


def unguarded_edges(calls: DataFrame, before: Column) -> DataFrame:
    """(caller, target) of calls with no A on a smaller line of their caller."""
    first = F.min(F.when(before, F.col("line"))).over(Window.partitionBy("caller"))
    return calls.withColumn("first", first).where("target IS NOT NULL AND (first IS NULL OR first >= line)").select("caller", "target").distinct()


def interprocedural(calls: DataFrame, before: Column, after: Column) -> DataFrame:
    """(caller, satisfied) of callers of B without a local A.

    Unsatisfied if walking unguarded edges backwards reaches a function that
    nobody calls; closed cycles are satisfied.
    """
    local = calls.where(before).select("caller").distinct()
    origins = calls.where(after).select("caller").distinct().join(local, "caller", "left_anti")
    edges = unguarded_edges(calls, before).select(F.col("caller").alias("src"), F.col("target").alias("dst"))
    called = calls.where("target IS NOT NULL").select(F.col("target").alias("node")).distinct()
    roots = calls.select(F.col("caller").alias("node")).distinct().join(called, "node", "left_anti")
    # One set for all origins: what is reached from the functions that nobody calls, along the same edges forwards.
    open_ = reach(edges, roots).select(F.col("node").alias("caller"), F.lit(True).alias("open"))
    return origins.join(open_, "caller", "left").select("caller", F.col("open").isNull().alias("satisfied"))


def verdict(calls: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: satisfied, and the number of violating callers and of matches."""
    local = local_checks(calls, before, after)
    a = local.agg(F.count_if(F.col("status") == "wrong_order").alias("wrong_order"), F.count_if(F.col("status") == "matched").alias("matched"))
    b = interprocedural(calls, before, after).agg(F.count_if(~F.col("satisfied")).alias("missing"))
    return a.crossJoin(b).select((F.col("wrong_order") + F.col("missing") == 0).alias("satisfied"), "wrong_order", "missing", "matched")


@dataclass(frozen=True)
class Findings:
    """What an analysis of "A before B" found, in four tables.

    violations: context_function, file_path, after_line, before_line, kind (wrong_order
    or missing_before), and the caller by which the nearest function that nobody
    calls leads here without A: missing_caller, missing_line, missing_file, n_steps.
    All null where nobody calls the context itself, or its callers go too deep.
    matches: context_function, file_path, after_line, after_callee, before_line,
    before_callee, via_caller, caller_context.
    satisfied_in: context_function.
    missing_paths: context_function, caller, call_line, file_path: every caller that brings no A.
    """

    violations: DataFrame
    matches: DataFrame
    satisfied_in: DataFrame
    missing_paths: DataFrame


@dataclass(frozen=True)
class Sets:
    """Calls that each stand for several: sites(caller, set, line, file_path) call every one of members(set, callee). Names of sets are no callees."""

    sites: DataFrame
    members: DataFrame


#: Stands before the name of a set where names of callees are.
_SET = "\x00"


def _marked_members(sets: Sets, before: Column, after: Column) -> DataFrame:
    """(set, callee, is_before, is_after)."""
    m = sets.members.select(F.concat(F.lit(_SET), "set").alias("set"), "callee").distinct()
    return m.withColumn("is_before", F.coalesce(before, F.lit(False))).withColumn("is_after", F.coalesce(after, F.lit(False)))


def marked_calls(calls: DataFrame, before: Column, after: Column, sets: Sets | None = None, members: DataFrame | None = None) -> DataFrame:
    """calls with callee (the target, the name of an unresolved call, or a marked set), is_before, is_after and before: the closest
    (line, callee) of an A on a smaller line of the caller, and the first A's line. before and after are conditions on callee."""
    c = calls.select("caller", F.coalesce("target", "callee_name").alias("callee"), "line", "file_path")
    c = c.withColumn("is_before", F.coalesce(before, F.lit(False))).withColumn("is_after", F.coalesce(after, F.lit(False))).withColumn("named", F.col("callee"))
    if sets is not None:
        kinds = members.groupBy(F.col("set").alias("callee")).agg(F.max("is_before").alias("is_before"), F.max("is_after").alias("is_after"), F.max(F.when(F.col("is_before"), F.col("callee"))).alias("named"))
        c = c.unionByName(sets.sites.select("caller", F.concat(F.lit(_SET), "set").alias("callee"), "line", "file_path").join(kinds, "callee").select(*c.columns))
    by = Window.partitionBy("caller")  # the calls of one function, so of one file
    closest = by.orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    a = F.max(F.when(F.col("is_before"), F.struct("line", F.col("named").alias("callee")))).over(closest)
    return c.select("*", a.alias("before"), F.min(F.when(F.col("is_before"), F.col("line"))).over(by).alias("first")).drop("named")


def caller_edges(marked: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes(node), sites(src, key, line, file_path, before), means(key, dst)): functions from which calls of B can be reached,
    their calls by the name that is called, and the functions that a name may mean.

    Where no call names a function exactly, calls whose names fit it count: see
    names.same_function. The names that are looked at are those from which B is
    reached. A name that many call may mean many, so edges stay in two tables.
    """
    called = marked.select("caller", "callee").distinct()
    back = called.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    seeds = marked.where("is_after").select(F.col("callee").alias("node"))
    if members is not None:
        back = back.unionByName(members.select(F.col("callee").alias("src"), F.col("set").alias("dst")))
        seeds = seeds.unionByName(members.where("is_after").select(F.col("callee").alias("node")))
    scope = cut(reach(back, seeds.distinct()))
    nodes = cut(called.select(F.col("caller").alias("node")).distinct().join(scope, "node", "left_semi"))
    sites = marked.join(scope.withColumnRenamed("node", "callee"), "callee", "left_semi").select(F.col("caller").alias("src"), F.col("callee").alias("key"), "line", "file_path", "before")
    keys = called.select("callee").distinct().join(scope.withColumnRenamed("node", "callee"), "callee", "left_semi")
    if members is not None:
        of = members.join(scope.withColumnRenamed("node", "callee"), "callee", "left_semi").join(called.select(F.col("callee").alias("set")).distinct(), "set", "left_semi").select("set", "callee")
        keys = keys.where(~F.col("callee").startswith(_SET)).unionByName(of.select("callee")).distinct()
    keys = cut(keys)
    alone = nodes.join(keys.select(F.col("callee").alias("node")), "node", "left_anti").select(F.col("node").alias("function"))
    exact = keys.join(nodes.select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("callee").alias("key"), F.col("callee").alias("dst"))
    means = cut(exact.unionByName(same_function(keys, alone).select(F.col("callee").alias("key"), F.col("function").alias("dst"))))
    if members is not None:
        means = cut(means.unionByName(of.withColumnRenamed("callee", "key").join(means, "key").select(F.col("set").alias("key"), "dst").distinct()))
    return nodes, cut(sites.join(means.select("key").distinct(), "key", "left_semi").select("src", "key", "line", "file_path", "before")), means


def analyse(calls: DataFrame, before: Column, after: Column, deepest: int = DEEPEST, sets: Sets | None = None) -> Findings:
    """Whether A is called before B wherever B is called, with witnesses, from calls(caller, target, callee_name, line, file_path),
    and from sets of calls.

    A caller of B with an A of its own is judged by lines. Without one, its
    callers decide: each must call an A on a smaller line, or be called only by
    such. A function that nobody calls breaks the constraint for all that it leads
    to; so does one whose calls, all without A, go up deepest steps even on the
    shortest way; closed cycles don't. All contexts share one walk: it goes down
    from where the verdict is known, and each function is met once, at its least
    depth, with the least (caller, line) that leads there. The reference walks up
    anew from every context, depth first; which of several witnesses it names, and
    chains over the bound that a shorter one spares, depend on its order of visits.
    """
    members = None if sets is None else cut(_marked_members(sets, before, after))
    marked = cut(marked_calls(calls, before, after, sets, members))
    nodes, sites, means = caller_edges(marked, members)
    free = sites.where("before IS NULL").groupBy("src", "key").agg(F.min(F.struct("line", "file_path")).alias("x")).select("src", "key", "x.line", "x.file_path")
    free = cut(free)
    zero = F.lit(0).alias("depth")
    # What functions lead to that nobody calls.
    open_ = cut(nearest_by(free, means, nodes.join(means.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", zero)))
    closed = cut(nodes.join(open_.select("node"), "node", "left_anti"))
    # How far up calls without A go among the others, from functions that are only called after an A.
    inner = cut(means.join(closed.select(F.col("node").alias("dst")), "dst", "left_semi").select("key", "dst"))
    led = inner.join(free.select("key").distinct(), "key", "left_semi").select(F.col("dst").alias("node")).distinct()
    tops = closed.join(led, "node", "left_anti").select("node", zero)
    steps = nearest_by(free, inner, tops).select("node", "depth")
    deep = cut(steps.where(F.col("depth") >= deepest))
    # The nearest caller that brings an A.
    brings = sites.where("before IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("src").alias("caller_context"), "line", "before")).alias("w"))
    kept = brings.join(inner, "key").groupBy(F.col("dst").alias("node")).agg(F.min("w").alias("w"))
    seeds = kept.select("node", zero, "w.caller_context", F.col("w.before.line").alias("before_line"), F.col("w.before.callee").alias("before_callee"))
    witness = nearest_by(free, inner, seeds).select(F.col("node").alias("caller"), "caller_context", F.col("before_line").alias("w_line"), F.col("before_callee").alias("w_callee"))

    def each(rows: DataFrame) -> DataFrame:
        """rows(callee, ...) with those of a set once for each B in it."""
        if members is None:
            return rows
        b = members.where("is_after").select("set", "callee")
        of = rows.where(F.col("callee").startswith(_SET)).withColumnRenamed("callee", "set").join(b, "set").select(*rows.columns)
        return rows.where(~F.col("callee").startswith(_SET)).unionByName(of)

    after_calls = marked.where("is_after")
    local = after_calls.where("first IS NOT NULL")
    wrong = local.where("line < first")
    apart = after_calls.where("first IS NULL")
    bad = open_.select(F.col("node").alias("caller"), F.col("depth").alias("n_steps"), "via").unionByName(deep.select(F.col("node").alias("caller"), F.lit(None).cast("int").alias("n_steps"), F.lit(None).cast(open_.schema["via"].dataType).alias("via")))
    missing = apart.join(bad, "caller")
    none = lambda kind: F.lit(None).cast(kind)
    violations = each(wrong).select(F.col("caller").alias("context_function"), "file_path", F.col("line").alias("after_line"), F.col("first").alias("before_line"), F.lit("wrong_order").alias("kind"), none("string").alias("missing_caller"), none("int").alias("missing_line"), none("string").alias("missing_file"), none("int").alias("n_steps")).unionByName(
        each(missing).select(F.col("caller").alias("context_function"), "file_path", F.col("line").alias("after_line"), none("int").alias("before_line"), F.lit("missing_before").alias("kind"), F.col("via.src").alias("missing_caller"), F.col("via.line").cast("int").alias("missing_line"), F.col("via.file_path").alias("missing_file"), "n_steps")
    )
    good = apart.join(bad.select("caller"), "caller", "left_anti")
    matches = each(local.where("line >= first AND before IS NOT NULL")).select(F.col("caller").alias("context_function"), "file_path", F.col("line").alias("after_line"), F.col("callee").alias("after_callee"), F.col("before.line").alias("before_line"), F.col("before.callee").alias("before_callee"), F.lit(False).alias("via_caller"), none("string").alias("caller_context")).unionByName(
        each(good.join(witness, "caller")).select(F.col("caller").alias("context_function"), "file_path", F.col("line").alias("after_line"), F.col("callee").alias("after_callee"), F.col("w_line").alias("before_line"), F.col("w_callee").alias("before_callee"), F.lit(True).alias("via_caller"), "caller_context")
    )
    ordered = local.select("caller").distinct().join(wrong.select("caller").distinct(), "caller", "left_anti")
    satisfied_in = ordered.unionByName(good.select("caller").distinct()).select(F.col("caller").alias("context_function"))
    leads = open_.select(F.col("node").alias("src")).unionByName(steps.where(F.col("depth") >= deepest - 1).select(F.col("node").alias("src")))
    contexts = missing.select(F.col("caller").alias("dst")).distinct()
    # As many as there are results: names stand for functions here, but for contexts only.
    paths = free.join(leads, "src", "left_semi").join(means.join(contexts, "dst", "left_semi").select("key", "dst"), "key").groupBy("dst", "src").agg(F.min(F.struct("line", "file_path")).alias("x"))
    paths = paths.select(F.col("dst").alias("context_function"), F.col("src").alias("caller"), F.col("x.line").alias("call_line"), "x.file_path")
    return Findings(violations, matches, satisfied_in, paths)
