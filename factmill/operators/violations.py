"""Checks of calls across projects and of declarations against interfaces; API changes and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.typing import argument_fits, base, is_builtin, kind, null_fits
from .boundary import class_project, cross, file_project
from .fixpoint import cut
from .inherit import ancestor_chain, member_owners

VISIBILITY_RANK = {"public": 3, "protected": 2, "private": 1}


def rank(visibility: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in VISIBILITY_RANK.items() for x in kv)), visibility)


def visibility_violations(boundary: DataFrame) -> DataFrame:
    """Calls of private (error) or protected (warning) methods from another project."""
    bad = cross(boundary).where(F.col("target_visibility").isin("private", "protected"))
    return bad.select("call_id", "caller", "target", F.col("target_visibility").alias("visibility"), F.when(F.col("target_visibility") == "private", "error").otherwise("warning").alias("severity"))


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def fails(violations: DataFrame, strict: bool = False) -> DataFrame:
    """One row (errors, warnings, failed): errors fail a run, warnings only if strict."""
    counts = violations.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning")))
    return counts.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))


def null_counters(accesses: DataFrame) -> DataFrame:
    """One row: guarded accesses, unguarded ones, and how many of these are surely of null. Unknown states count nowhere."""
    state = F.col("state")
    return accesses.agg(F.count_if(state == "definitely_not_null").alias("guarded"), F.count_if(state.isin("possibly_null", "definitely_null")).alias("unguarded"), F.count_if(state == "definitely_null").alias("definite"))


def return_counters(returns: DataFrame) -> DataFrame:
    """One row: methods that were checked, and how many of each status."""
    methods = returns.groupBy("method").agg(F.min("status").alias("status"))  # a method's rows have one status
    return methods.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "failed", "uncertain")))


def _bounds() -> tuple[Column, Column]:
    """The least and most arguments that target_params take."""
    params = F.col("target_params")
    required = F.size(F.filter(params, lambda p: ~p["has_default"] & ~F.coalesce(p["is_variadic"], F.lit(False))))
    return required, F.when(F.exists(params, lambda p: F.coalesce(p["is_variadic"], F.lit(False))), F.lit(2**31 - 1)).otherwise(F.size(params))


def argument_counts(boundary: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Calls with fewer arguments than required, or more than there are parameters (unless the last is variadic)."""
    required, most = _bounds()
    n = F.size("args")
    calls = cross(boundary).where(F.col("confidence") >= min_confidence)
    return calls.select("call_id", "target", n.alias("n_args"), required.alias("n_required"), most.alias("n_most")).where("n_args < n_required OR n_args > n_most")


def argument_types(facts: Facts, boundary: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Arguments whose type doesn't fit the parameter at their position; unresolved arguments are skipped.

    Types are few and calls many: every different pair of types is judged once,
    those of two classes with the hierarchy, and the pairs that don't fit are
    joined back, by broadcast only where Spark finds them small.
    """
    return _misfits(facts, cross(boundary).where(F.col("confidence") >= min_confidence).select("call_id", "target", "args", "target_params"))


def _misfits(facts: Facts, calls: DataFrame) -> DataFrame:
    """(other columns of calls, pos, arg, param) of calls(args, target_params, ...)."""
    others = [c for c in calls.columns if c not in ("args", "target_params")]
    zipped = F.arrays_zip("args", F.col("target_params.type").alias("params"))
    pairs = calls.select(*others, F.posexplode(F.slice(zipped, F.lit(1), F.least(F.size("args"), F.size("target_params")))).alias("pos", "x")).where("x.args IS NOT NULL AND x.params IS NOT NULL")
    pairs = pairs.select(*others, "pos", F.col("x.args").alias("arg"), F.col("x.params").alias("param"))
    return pairs.join(_bad_pairs(facts, cut(pairs.select("arg", "param").distinct())), ["arg", "param"]).select(*others, "pos", "arg", "param")


def _bad_pairs(facts: Facts, pairs: DataFrame) -> DataFrame:
    """(arg, param) of different pairs that don't fit."""
    arg, param = F.col("arg"), F.col("param")
    pairs = pairs.withColumn("a", base(arg)).withColumn("p", base(param))
    classes = F.coalesce(~is_builtin(F.col("a")) & ~is_builtin(F.col("p")), F.lit(False))
    ups = ancestor_chain(facts).select(F.col("class").alias("a"), F.col("ancestor").alias("p")).unionByName(facts.implements.select(F.col("class").alias("a"), F.col("interface").alias("p"))).distinct()
    subtypes = cut(pairs.where(classes).select("a", "p").distinct().join(ups, ["a", "p"], "left_semi")).withColumn("is_sub", F.lit(True))
    fits = F.when(arg == "null", null_fits(param)).otherwise(argument_fits(arg, param, F.col("is_sub")))
    return pairs.join(subtypes, ["a", "p"], "left").where(~fits).select("arg", "param")


def first_matches(boundary: DataFrame, calls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """boundary(target, file_path, line, ...) with first_call: of the calls(call_id, target, file_path, line, confidence) of the same
    target on the same line of the same file, the one that comes first; null where none is sure enough.

    Such a line may hold several calls. The least call_id of each (target, file,
    line) is found before the join, so a key meets its rows once.
    """
    key = ["target", "file_path", "line"]
    first = calls.where(F.col("target").isNotNull() & (F.col("confidence") >= min_confidence)).groupBy(*key).agg(F.min("call_id").alias("first_call"))
    return boundary.join(first, key, "left")


def third_project_returns(facts: Facts, boundary: DataFrame) -> DataFrame:
    """Calls whose result is a class of a third project."""
    at = class_project(facts).select(F.col("fqn").alias("result"), F.col("project").alias("third"))
    calls = cross(boundary).withColumn("result", F.when(kind(F.col("target_return")).isin("simple", "nullable"), base(F.col("target_return"))))
    return calls.join(at, "result").where("third <> caller_project AND third <> callee_project").select("call_id", "target", "result", "third")


def interface_compliance(facts: Facts, scope: str = "all") -> DataFrame:
    """(class, interface, name, problem) of declarations: missing, param_count, param_type, return_type, visibility.

    scope 'cross_project' leaves out interfaces and classes of one project.
    A method is judged once for each interface, however many classes inherit it,
    and its types once for each different pair of signatures. Classes meet only names.
    """
    key = ["interface", "name", "owner"]
    wanted = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("interface"), "name", _types("params").alias("ip"), F.col("return_type").alias("ir"))
    have = facts.methods.select("owner", "name", _types("params").alias("cp"), F.col("return_type").alias("cr"), F.col("visibility").alias("cv"))
    pairs = facts.implements.join(wanted.select("interface", "name").distinct(), "interface").join(member_owners(facts, facts.methods), ["class", "name"], "left")
    if scope == "cross_project":
        at = class_project(facts)
        pairs = pairs.join(at.select(F.col("fqn").alias("class"), F.col("project").alias("a")), "class", "left").join(at.select(F.col("fqn").alias("interface"), F.col("project").alias("b")), "interface", "left").where("NOT (a <=> b)")
    pairs = cut(pairs.select("class", *key))
    met = cut(pairs.select(*key).distinct().join(wanted, ["interface", "name"]).join(have, ["owner", "name"], "left"))
    signature = ["ip", "ir", "cp", "cr"]
    misfit = F.exists(F.slice(F.arrays_zip("ip", "cp"), F.lit(1), F.least(F.size("ip"), F.size("cp"))), lambda z: ~argument_fits(z["ip"], z["cp"]))
    judged = cut(met.select(*signature).distinct().select(*signature, misfit.alias("param_type"), (~argument_fits(F.col("cr"), F.col("ir"))).alias("return_type")))
    problems = F.when(F.col("cv").isNull(), F.array(F.lit("missing"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.size("ip") != F.size("cp"), "param_count"),
                F.when(F.col("param_type"), "param_type"),
                F.when(F.col("return_type"), "return_type"),
                F.when(rank(F.col("cv")) < 3, "visibility"),
            )
        )
    )
    found = _same(met, judged, signature).select(*key, problems.alias("problems")).where("size(problems) > 0")
    return _same(pairs, found, key).select("class", "interface", "name", F.explode("problems").alias("problem"))


def _types(params: str) -> Column:
    return F.transform(params, lambda p: p["type"])


def _same(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left joined with right where all columns of key agree, nulls with nulls."""
    other = right.select(*(F.col(c).alias(f"{c}_") if c in key else F.col(c) for c in right.columns))
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]).drop(*(f"{c}_" for c in key))


def call_site_compliance(facts: Facts, boundary: DataFrame, scope: str = "all") -> DataFrame:
    """(call_id, target, interface, problem, pos) of calls whose method differs from that of an interface of its class.

    Types are compared by their exact base name, those not declared not at all:
    return_type, param_count, and param_type at each position. Interfaces and
    classes outside all projects are left out, and with scope 'cross_project'
    those of one project.
    """
    places = facts.classes.select("fqn", "file_path").unionByName(facts.interfaces.select("fqn", "file_path"))
    at = places.join(file_project(places, facts.projects), "file_path").select("fqn", "project")
    own = facts.implements.join(at.select(F.col("fqn").alias("class"), F.col("project").alias("a")), "class").join(at.select(F.col("fqn").alias("interface"), F.col("project").alias("b")), "interface")
    own = own.where("a <> b") if scope == "cross_project" else own
    wanted = facts.methods.where("owner_kind = 'interface'").select(F.col("owner").alias("interface"), "name", F.col("params").alias("ip"), F.col("return_type").alias("ir"))
    calls = cross(boundary).select("call_id", "target", F.col("target_owner").alias("class"), F.substring_index("target", "::", -1).alias("name"), F.col("target_params").alias("cp"), F.col("target_return").alias("cr"))
    pairs = calls.where("cp IS NOT NULL").join(own, "class").join(wanted, ["interface", "name"])
    differ = lambda x, y: F.coalesce(base_name(x) != base_name(y), F.lit(False))
    problem = lambda what, pos=None: F.struct(F.lit(what).alias("problem"), (F.lit(None).cast("int") if pos is None else pos).alias("pos"))
    shared = F.slice(F.arrays_zip("ip", "cp"), F.lit(1), F.least(F.size("ip"), F.size("cp")))
    types = F.transform(shared, lambda z, i: F.when(differ(z["ip"]["type"], z["cp"]["type"]), problem("param_type", i)))
    whole = F.array(F.when(differ(F.col("ir"), F.col("cr")), problem("return_type")), F.when(F.size("ip") != F.size("cp"), problem("param_count")))
    return pairs.select("call_id", "target", "interface", F.explode(F.array_compact(F.concat(whole, types))).alias("x")).select("call_id", "target", "interface", "x.problem", "x.pos")


def base_name(t: Column) -> Column:
    """base(), but null where nothing is declared, and the text of unions and intersections."""
    return F.when(t.isNotNull() & (F.trim(t) != ""), F.coalesce(base(t), F.trim(t)))


def api_signatures(facts: Facts, surface: DataFrame) -> DataFrame:
    """Signatures of the methods that other projects call."""
    m = facts.methods.select(F.concat_ws("::", "owner", "name").alias("target"), F.array_join(F.transform("params", lambda p: p["type"]), ",").alias("param_types"), F.transform("params", lambda p: p["type"]).alias("types"), "return_type", "visibility", "is_static", F.size("params").alias("n_params"))
    return surface.select("target").join(m, "target")


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target, change) between signatures(target, types, return_type, visibility).

    A result changes only where both are declared; more parameters count as
    added and required, whatever their defaults; types are compared position by
    position as far as both lists go, one row for each that differs.
    """
    n = new.select("target", *(F.col(c).alias(f"new_{c}") for c in ("types", "return_type", "visibility")))
    both = old.join(n, "target", "left")
    size, new_size = F.size("types"), F.size("new_types")
    shared = F.slice(F.arrays_zip("types", "new_types"), F.lit(1), F.least(size, new_size))
    retyped = F.transform(F.filter(shared, lambda z: F.coalesce(z["types"] != z["new_types"], F.lit(False))), lambda z: F.lit("parameter_type_changed"))
    one = F.array(
        F.when(F.col("return_type") != F.col("new_return_type"), "return_type_changed"),
        F.when(new_size > size, "parameter_added_required").when(new_size < size, "parameter_removed"),
        F.when(rank(F.col("new_visibility")) < rank(F.col("visibility")), "visibility_reduced"),
    )
    changes = F.when(F.col("new_visibility").isNull(), F.array(F.lit("method_removed"))).otherwise(F.concat(F.array_compact(one), retyped))
    return both.select("target", F.explode(changes).alias("change"))


def pair_counts(facts: Facts, boundary: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(caller_project, callee_project, target, n_calls, n_violations).

    Violations are calls of what isn't visible, wrong argument counts, and
    arguments that don't fit. They are summed for each call_id and then meet the
    calls of that id, which need not be one; both sides of this join are narrow.
    """
    place = ["caller_project", "callee_project", "target"]
    calls = cross(boundary)
    judged = F.col("confidence") >= min_confidence
    required, most = _bounds()
    n = F.size("args")
    wrong = F.when(F.col("target_visibility").isin("private", "protected"), 1).otherwise(0) + F.when(judged & ((n < required) | (n > most)), 1).otherwise(0)
    bad = calls.select("call_id", wrong.alias("v")).where("v > 0").unionByName(_misfits(facts, calls.where(judged).select("call_id", "args", "target_params")).select("call_id", F.lit(1).alias("v")))
    sums = bad.groupBy("call_id").agg(F.sum("v").alias("v"))
    met = calls.select("call_id", *place).join(sums, "call_id", "left")
    return met.groupBy(*place).agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_violations"))


def stability(counts: DataFrame, breaking: DataFrame | None = None) -> DataFrame:
    """stability_scores() of what pair_counts() summed."""
    pair = ["caller_project", "callee_project"]
    out = counts.groupBy(*pair).agg(F.sum("n_calls").alias("n_calls"), F.sum("n_violations").alias("v"))
    if breaking is not None:
        b = breaking.join(counts.select("target", "callee_project").distinct(), "target").groupBy("callee_project").agg(F.count(F.lit(1)).alias("b"))
        out = out.join(b, "callee_project", "left")
    else:
        out = out.withColumn("b", F.lit(0))
    return _scored(out)


def _scored(out: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0.0), 1 - 0.1 * F.coalesce("v", F.lit(0)) - 0.2 * F.coalesce("b", F.lit(0)))
    return out.select("caller_project", "callee_project", "n_calls", F.coalesce("v", F.lit(0)).cast("long").alias("n_violations"), F.round(score, 6).alias("score"))


def stability_scores(boundary: DataFrame, violations: DataFrame, breaking: DataFrame | None = None) -> DataFrame:
    """Score of each pair of projects with calls: 1 - 0.1 * violations - 0.2 * breaking changes, not below 0.

    Violations are those of the pair's calls; breaking changes all those of the called project.
    """
    pair = ["caller_project", "callee_project"]
    calls = cross(boundary)
    of = calls.select("call_id", "target", *pair)
    v = violations.select("call_id").join(of.select("call_id", *pair), "call_id").groupBy(*pair).agg(F.count(F.lit(1)).alias("v"))
    out = calls.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_calls")).join(v, pair, "left")
    if breaking is not None:
        b = breaking.join(of.select("target", "callee_project").distinct(), "target").groupBy("callee_project").agg(F.count(F.lit(1)).alias("b"))
        out = out.join(b, "callee_project", "left")
    else:
        out = out.withColumn("b", F.lit(0))
    return _scored(out)
