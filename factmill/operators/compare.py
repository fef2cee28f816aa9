"""Comparisons: symbol dumps, golden metrics, benchmark runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typing import canonical

#: Share by which a metric may differ, by how it is judged (fixed values).
TOLERANCE = {"no_drop": 0.0, "ten_percent": 0.1, "twice": 2.0}


def symbol_diff(ours: DataFrame, truth: DataFrame, compared: list[str]) -> DataFrame:
    """(fqn, problem): extra, missing, or <column>_differs, from tables unique on fqn."""
    b = truth.select("fqn", F.struct(*compared).alias("b"))
    both = ours.select("fqn", F.struct(*compared).alias("a")).join(b, "fqn", "full_outer")
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"{c}_differs") for c in compared]
    problems = F.when(F.col("b").isNull(), F.array(F.lit("extra"))).when(F.col("a").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select("fqn", F.explode(problems).alias("problem"))


@dataclass(frozen=True)
class Dump:
    """Symbols of a code base as another tool or an earlier run sees them.

    classes(fqn, extends, is_abstract, is_final), methods(owner, name, visibility,
    is_static, return_type, params), properties(owner, name, visibility, type),
    implements(class, interface). Tables are unique on their names.
    """

    classes: DataFrame
    methods: DataFrame
    properties: DataFrame
    implements: DataFrame


#: Kinds of mismatches (fixed values).
KINDS = ("class_missing_in_ours", "class_missing_in_theirs", "class_field_mismatch", "method_missing_in_ours", "method_missing_in_theirs", "method_field_mismatch", "property_missing_in_ours", "property_missing_in_theirs", "property_field_mismatch", "implements_mismatch")


def _level(ours: DataFrame, theirs: DataFrame, key: list[str], fields: dict[str, Column], what: str) -> DataFrame:
    """(*key, kind, detail): missing on either side, or one row for each field that differs, from one outer join."""
    a = ours.select(*key, F.struct(*(c.alias(f) for f, c in fields.items())).alias("a"))
    b = theirs.select(*key, F.struct(*(c.alias(f) for f, c in fields.items())).alias("b"))
    both = a.join(b, key, "full_outer")
    row = lambda kind, detail: F.struct(F.lit(f"{what}_{kind}").alias("kind"), detail.alias("detail"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    differs = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), row("field_mismatch", F.concat(F.lit(f"{f}: "), text(F.col(f"a.{f}")), F.lit(" / "), text(F.col(f"b.{f}"))))) for f in fields]
    found = F.when(F.col("a").isNull(), F.array(row("missing_in_ours", F.lit(None).cast("string")))).when(F.col("b").isNull(), F.array(row("missing_in_theirs", F.lit(None).cast("string")))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(*key, F.explode(found).alias("x")).select(*key, "x.kind", "x.detail")


def reflection_diff(ours: Dump, theirs: Dump) -> DataFrame:
    """(class, member, kind, detail) of everything that differs, of ten kinds.

    Members and interfaces are compared in classes that both sides have: one that
    is missing is said once and not again for all that it holds. Types are equal
    if their canonical texts are, and interfaces as sets, whose order and repetition don't count.
    """
    shared = ours.classes.select(F.col("fqn").alias("class")).join(theirs.classes.select(F.col("fqn").alias("class")), "class").distinct()
    inside = lambda df, owner="owner": df.withColumnRenamed(owner, "class").join(shared, "class", "left_semi")
    column = F.col
    classes = _level(ours.classes.withColumnRenamed("fqn", "class"), theirs.classes.withColumnRenamed("fqn", "class"), ["class"], {c: column(c) for c in ("extends", "is_abstract", "is_final")}, "class")
    types = lambda: F.array_join(F.transform("params", lambda p: F.coalesce(canonical(p["type"]), F.lit("none"))), ", ")
    fields = {"visibility": column("visibility"), "is_static": column("is_static"), "return_type": canonical(column("return_type")), "n_params": F.size("params"), "param_types": types()}
    methods = _level(inside(ours.methods), inside(theirs.methods), ["class", "name"], fields, "method")
    properties = _level(inside(ours.properties), inside(theirs.properties), ["class", "name"], {"visibility": column("visibility"), "type": canonical(column("type"))}, "property")
    # Sets are equal if no interface is on one side alone.
    a, b = (inside(x.implements, "class").select("class", "interface").distinct() for x in (ours, theirs))
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    alone = mark(a, "a").join(mark(b, "b"), ["class", "interface"], "full_outer").where("a IS NULL OR b IS NULL")
    sides = alone.groupBy("class").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(column(s).isNotNull(), column("interface")))), ", ").alias(s) for s in ("a", "b")))
    implements = sides.select("class", F.lit(None).cast("string").alias("member"), F.lit("implements_mismatch").alias("kind"), F.concat(F.lit("only ours: "), "a", F.lit("; only theirs: "), "b").alias("detail"))
    out = classes.select("class", F.lit(None).cast("string").alias("member"), "kind", "detail")
    for part in (methods, properties):
        out = out.unionByName(part.withColumnRenamed("name", "member"))
    return out.unionByName(implements)


def diff_summary(diff: DataFrame) -> DataFrame:
    """(problem, n) of a symbol_diff."""
    return diff.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def golden_compare(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """(metric, actual, expected, ok) from (metric, value) and (metric, value, rule)."""
    g = golden.select("metric", F.col("value").alias("expected"), "rule")
    a, e = F.col("value"), F.col("expected")
    ok = F.when(a.isNull(), False).when(F.col("rule") == "no_drop", a >= e).when(F.col("rule") == "ten_percent", F.abs(a - e) <= TOLERANCE["ten_percent"] * F.abs(e)).otherwise(a <= TOLERANCE["twice"] * e)
    return g.join(actual.select("metric", "value"), "metric", "left").select("metric", F.col("value").alias("actual"), "expected", ok.alias("ok"))


def bench_compare(current: DataFrame, baseline: DataFrame, wall: float = 2.0, memory: float = 1.5) -> DataFrame:
    """(corpus, wall_ratio, memory_ratio, ok) from (corpus, wall_ms, memory_mb)."""
    b = baseline.select("corpus", F.col("wall_ms").alias("bw"), F.col("memory_mb").alias("bm"))
    joined = current.join(b, "corpus")
    w, m = F.col("wall_ms") / F.when(F.col("bw") > 0, F.col("bw")), F.col("memory_mb") / F.when(F.col("bm") > 0, F.col("bm"))
    return joined.select("corpus", F.round(w, 6).alias("wall_ratio"), F.round(m, 6).alias("memory_ratio"), ((w <= wall) & (m <= memory)).alias("ok"))


def medians(runs: DataFrame) -> DataFrame:
    return runs.groupBy("corpus").agg(F.median("wall_ms").alias("wall_ms"), F.max("memory_mb").alias("memory_mb"))
