"""Call resolution and its aggregates."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from .inherit import all_methods, member_owners

#: Confidence by the kind of the receiver's type (fixed values).
CONFIDENCE = {"simple": 1.0, "nullable": 0.9, "union_type": 0.5, "mixed": 0.1, "self_type": 0.95, "static_type": 0.95, "parent_type": 0.9}
OTHER_CONFIDENCE = 0.7


def confidence(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), kind), F.lit(OTHER_CONFIDENCE))


def resolve_calls(facts: Facts, builtins: Collection[str] = ()) -> DataFrame:
    """calls with target (declaring owner::name), confidence and method; unresolved ones stay, with confidence 0.

    Where calls have a call_type, a static call of an external class or an
    unknown method still has a target, with confidence 0.5, and a function call
    has the function, or else the name of one of builtins, with confidence 1.
    """
    methods = all_methods(facts).select(F.col("class").alias("receiver"), F.col("name").alias("callee_name"), F.col("owner").alias("target_owner"), F.col("visibility").alias("target_visibility"), F.col("return_type").alias("target_return"), F.col("params").alias("target_params"))
    return _resolved(facts, methods, builtins)


#: Columns of calls on which their target, confidence and method depend.
NAMED_BY = ("receiver", "callee_name", "receiver_kind", "how", "call_type")


def resolve_names(facts: Facts, builtins: Collection[str] = ()) -> DataFrame:
    """What calls mean, for those who ask for no single one: resolve_calls() of their different names, with n_calls, the number of calls of each.

    Calls are counted by name before they are shuffled, and only names meet the
    methods, of which nothing but the owner is joined. Columns: NAMED_BY as far as
    calls have them, target, target_owner, confidence, method, n_calls.
    """
    by = [c for c in NAMED_BY if c in facts.calls.columns]
    named = facts.with_(calls=facts.calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls")))
    none = [F.lit(None).cast(facts.methods.schema[c].dataType).alias(a) for c, a in (("visibility", "target_visibility"), ("return_type", "target_return"), ("params", "target_params"))]
    owners = member_owners(facts, facts.methods).select(F.col("class").alias("receiver"), F.col("name").alias("callee_name"), F.col("owner").alias("target_owner"), *none)
    return _resolved(named, owners, builtins).select(*by, "target", "target_owner", "confidence", "method", "n_calls")


def n_calls(resolved: DataFrame, where: Column | None = None) -> Column:
    """How many calls there are, or those where something holds: rows of resolve_names() stand for n_calls each."""
    n = F.col("n_calls") if "n_calls" in resolved.columns else F.lit(1)
    return F.coalesce(F.sum(n if where is None else F.when(where, n)), F.lit(0).cast("long"))


def _resolved(facts: Facts, methods: DataFrame, builtins: Collection[str]) -> DataFrame:
    found = F.col("target_owner").isNotNull()
    met = facts.calls.join(methods, ["receiver", "callee_name"], "left").select(
        *facts.calls.columns,
        F.when(found, F.concat_ws("::", "target_owner", "callee_name")).alias("target"),
        F.when(found, confidence(F.col("receiver_kind"))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(found, F.col("how")).otherwise("unresolved").alias("method"),
        "target_owner",
        "target_visibility",
        "target_return",
        "target_params",
    )
    return _static_and_functions(facts, met, builtins) if "call_type" in facts.calls.columns else met


def _static_and_functions(facts: Facts, met: DataFrame, builtins: Collection[str]) -> DataFrame:
    declared = facts.functions.columns
    functions = facts.functions.dropDuplicates(["fqn"]).select(
        F.col("fqn").alias("callee_name"),
        F.lit("call").alias("call_type"),
        F.col("fqn").alias("function"),
        *((F.col(c) if c in declared else F.lit(None).cast(met.schema[f"target_{t}"].dataType)).alias(f"function_{t}") for c, t in (("return_type", "return"), ("params", "params"))),
    )
    met = met.join(functions, ["callee_name", "call_type"], "left")
    user = F.col("function").isNotNull()
    builtin = ~user & (F.col("call_type") == "call") & F.col("callee_name").isin(*builtins)
    external = F.col("target").isNull() & (F.col("call_type") == "static_call") & F.col("receiver").isNotNull()
    new = {
        "target": F.when(user, F.col("function")).when(builtin, F.col("callee_name")).when(external, F.concat_ws("::", "receiver", "callee_name")),
        "confidence": F.when(user | builtin, 1.0).when(external, 0.5),
        "method": F.when(user | builtin, "explicit_type").when(external, F.col("how")),
        "target_owner": F.when(user, F.col("function")).when(external, F.col("receiver")),
        "target_return": F.when(user, F.col("function_return")),
        "target_params": F.when(user, F.col("function_params")),
    }
    return met.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in [*facts.calls.columns, "target", "confidence", "method", "target_owner", "target_visibility", "target_return", "target_params"]))


#: Confidence of an edge that a mapping of events gives (fixed value).
SYNTHETIC_CONFIDENCE = 0.95


def with_synthetic(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """resolved with one more call for each edge (caller, target) that a plugin found; other columns of these are null."""
    t = F.col("target")
    owner = F.when(t.contains("::"), F.substring_index("target", "::", 1)).otherwise(t)
    new = edges.select("caller", "target", F.substring_index("target", "::", -1).alias("callee_name"), F.substring_index("caller", "::", 1).alias("caller_class"), owner.alias("target_owner"), F.lit(SYNTHETIC_CONFIDENCE).alias("confidence"), F.lit("plugin_generated").alias("method"))
    return resolved.unionByName(new.select(*(c for c in new.columns if c in resolved.columns)), allowMissingColumns=True)


def symbol_stats(facts: Facts) -> DataFrame:
    """One row of counts: classes, interfaces, traits, functions, methods, properties."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(facts.classes, "classes")
    for name in ("interfaces", "traits", "functions", "methods", "properties"):
        out = out.crossJoin(count(getattr(facts, name), name))  # one row each
    return out


def resolution_rate(resolved: DataFrame) -> DataFrame:
    n, hit = n_calls(resolved), n_calls(resolved, F.col("target").isNotNull())
    return resolved.agg(n.alias("total_calls"), hit.alias("resolved_calls"), (n - hit).alias("unresolved_calls"), F.coalesce(F.round(100.0 * hit / F.when(n > 0, n), 4), F.lit(0.0)).alias("resolution_rate"))


def confidence_histogram(resolved: DataFrame) -> DataFrame:
    bucket = F.when(F.col("target").isNull(), "unresolved").when(F.col("confidence") >= 0.9, "exact").when(F.col("confidence") >= 0.5, "likely").otherwise("possible")
    return resolved.groupBy(bucket.alias("bucket")).agg(n_calls(resolved).alias("n"))


def confidence_shares(resolved: DataFrame) -> DataFrame:
    """One row: percentages of calls by confidence, rounded to a tenth, and their numbers; zero without calls."""
    c, hit = F.col("confidence"), F.col("target").isNotNull()
    of = {"exact": c >= 0.9, "likely": (c >= 0.5) & (c < 0.9), "possible": (c < 0.5) & hit, "unresolved": (c < 0.5) & ~hit}
    n = resolved.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(x).alias(name) for name, x in of.items()))
    share = lambda name: F.round(F.coalesce(100.0 * F.col(name) / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)), 1)
    return n.select(*(share(name).alias(name) for name in of), *(F.col(name).alias(f"{name}_count") for name in of))


#: What a resolved call passes, by how it was resolved (fixed values).
CHECKS = {
    "interface_compliance": ("native_type", "explicit_type", "plugin_generated"),
    "call_site_args": ("this_reference", "self_reference", "static_reference", "parent_reference", "phpdoc", "static_call", "this_call"),
    "property_types": ("assignment", "assignment_tracking", "constructor_call", "constructor_injection", "property_type"),
    "return_types": ("return_type_chain",),
}


def type_checks(resolved: DataFrame) -> DataFrame:
    """One row: (passed, failed, unchecked) of each of four checks; unresolved calls are unchecked arguments."""
    hit = F.col("target").isNotNull()
    counts = resolved.agg(*(F.count_if(hit & F.col("method").isin(*methods)).alias(name) for name, methods in CHECKS.items()), F.count_if(~hit).alias("open"))
    zero = F.lit(0).cast("long")
    return counts.select(*(F.struct(F.col(name).alias("pass"), zero.alias("fail"), (F.col("open") if name == "call_site_args" else zero).alias("unchecked")).alias(name) for name in CHECKS))


def type_check_buckets(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("method").agg(n_calls(resolved, F.col("target").isNotNull()).alias("passed"), n_calls(resolved, F.col("target").isNull()).alias("unchecked"))


def unresolved_calls(facts: Facts, resolved: DataFrame) -> DataFrame:
    """Unresolved calls by reason: the method exists somewhere, or nowhere."""
    names = facts.methods.select(F.col("name").alias("callee_name")).distinct().withColumn("known", F.lit(True))
    return resolved.where("target IS NULL").join(names, "callee_name", "left").groupBy("callee_name", F.when(F.col("known"), "method of another class").otherwise("unknown name").alias("reason")).agg(n_calls(resolved).alias("n"))


def by_caller(resolved: DataFrame) -> DataFrame:
    """Callers in byte order with what they call."""
    return resolved.groupBy("caller").agg(F.count(F.lit(1)).alias("n_calls"), F.count("target").alias("n_resolved"), F.countDistinct("callee_name").alias("n_callees")).orderBy("caller")


def callee_only(resolved: DataFrame) -> DataFrame:
    """Targets that call nothing."""
    return resolved.where("target IS NOT NULL").select(F.col("target").alias("node")).distinct().join(resolved.select(F.col("caller").alias("node")).distinct(), "node", "left_anti")
