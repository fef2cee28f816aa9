"""Registered queries over derived facts, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import docs, names, typing
from ..operators import boundary, called_before, compare, generics, inherit, liveness, plugins, resolve, violations
from ..operators.fixpoint import cut, delete, exists, reach_pairs, shared_folder, simple_paths
from ..sources import documents, projects, sinks
from ..sources.php.facts import event_sites
from .bridge import CTES, TYPES, facts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {CTES} {sql}" if ctes else sql
        return f

    return register


#: Tables that a session writes once and all its queries read: (application, folder, name) to the state of the folder's files, path and schema.
_KEPT: dict[tuple[str, str, str], tuple[tuple, str, StructType]] = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, and a sum of hashes of the names, lengths and times, of the files in a folder; listed and summed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).head())


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written to the shared folder when it is first asked for, and again once a file in sf_dir has changed or its own is gone."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), state(spark, sf_dir)
    before = _KEPT.get(key)
    if before is None or before[0] != now or not exists(spark, before[1]):
        df = make()
        path = f"{shared_folder(spark)}/kept/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _KEPT[key] = now, path, df.schema
    _, path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables that this session's queries share."""
    delete(spark, f"{shared_folder(spark)}/kept")


def _hierarchy(spark: SparkSession, sf_dir: str):
    """Facts whose chains of ancestors are known."""
    f = facts(spark, sf_dir)
    return f.with_(extra=f.extra | {"ancestors": kept(spark, sf_dir, "ancestors", lambda: inherit.ancestor_chain(f))})


def _resolved(spark: SparkSession, sf_dir: str):
    f = _hierarchy(spark, sf_dir)
    return f, kept(spark, sf_dir, "resolved", lambda: resolve.resolve_calls(f))


def _named(spark: SparkSession, sf_dir: str):
    """Facts and what the names of calls mean, for queries on which no single call has a bearing."""
    f = _hierarchy(spark, sf_dir)
    return f, kept(spark, sf_dir, "named", lambda: resolve.resolve_names(f))


def _boundary(spark: SparkSession, sf_dir: str):
    f, r = _resolved(spark, sf_dir)
    return f, kept(spark, sf_dir, "boundary", lambda: boundary.boundary_calls(f, r))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller_class, file_path), written so that Spark knows how small it is beside the calls that are joined with it."""
    return kept(spark, sf_dir, "files", lambda: facts(spark, sf_dir).classes.select(F.col("fqn").alias("caller_class"), "file_path"))


#: What builds the tables that queries share, in order, for those who time them apart.
SHARED = {"shared_ancestors": _hierarchy, "shared_named": _named, "shared_resolved": _resolved, "shared_boundary": _boundary}


# ---------------------------------------------------------------- symbols and inheritance


@query("SELECT (SELECT count(*) FROM classes) AS classes, (SELECT count(*) FROM interfaces) AS interfaces, (SELECT count(*) FROM traits) AS traits, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM methods) AS methods, (SELECT count(*) FROM properties) AS properties")
def symbol_stats(spark, sf_dir):
    return resolve.symbol_stats(facts(spark, sf_dir))


@query("SELECT class, ancestor, dist FROM ancestors")
def ancestor_chain(spark, sf_dir):
    return inherit.ancestor_chain(_hierarchy(spark, sf_dir))


@query("SELECT class, name, owner, visibility, return_type FROM all_methods")
def all_methods(spark, sf_dir):
    return inherit.all_methods(_hierarchy(spark, sf_dir)).select("class", "name", "owner", "visibility", "return_type")


@query("""SELECT class, name, owner, type FROM (
  SELECT l.class, p.*, 0 AS r, dist AS near FROM lineage l JOIN properties p ON p.owner = l.ancestor) QUALIFY row_number() OVER (PARTITION BY class, name ORDER BY r, near) = 1""")
def all_properties(spark, sf_dir):
    return inherit.all_properties(_hierarchy(spark, sf_dir)).select("class", "name", "owner", "type")


_OVERRIDES = """overrides AS (
  SELECT DISTINCT b.owner || '::' || b.name AS base, m.owner || '::' || m.name AS override
  FROM (SELECT class, ancestor AS up FROM ancestors UNION ALL SELECT class, interface FROM implements UNION ALL SELECT class, trait FROM uses) u
  JOIN methods b ON b.owner = u.up JOIN methods m ON m.owner = u.class AND m.name = b.name)"""


@query(f", {_OVERRIDES} SELECT * FROM overrides")
def method_overrides(spark, sf_dir):
    return inherit.method_overrides(_hierarchy(spark, sf_dir))


@query("SELECT DISTINCT class, up AS supertype FROM (SELECT class, ancestor AS up FROM ancestors UNION ALL SELECT class, interface FROM implements)")
def subtype_pairs(spark, sf_dir):
    return inherit.subtype_pairs(_hierarchy(spark, sf_dir))


@query("SELECT fqn, coalesce(max(dist), 0)::INT AS depth FROM classes LEFT JOIN ancestors ON class = fqn GROUP BY fqn")
def topo_order(spark, sf_dir):
    return inherit.topological_order(_hierarchy(spark, sf_dir)).orderBy("depth", "fqn")


@query("SELECT owner, name, ord FROM methods")
def last_write_wins(spark, sf_dir):
    return facts(spark, sf_dir).methods.select("owner", "name", "ord")


@query("SELECT DISTINCT class FROM implements WHERE interface = 'I3'")
def implementors(spark, sf_dir):
    return facts(spark, sf_dir).implements.where("interface = 'I3'").select("class").distinct()


# ---------------------------------------------------------------- calls


@query("SELECT call_id, caller, target, confidence, method FROM resolved")
def resolve_calls(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("call_id", "caller", "target", F.col("confidence").cast("double").alias("confidence"), "method")


@query("SELECT count(*) AS total_calls, count(target) AS resolved_calls, count(*) - count(target) AS unresolved_calls, round(100.0 * count(target) / count(*), 4) AS resolution_rate FROM resolved")
def resolution_rate(spark, sf_dir):
    return resolve.resolution_rate(_named(spark, sf_dir)[1])


@query("SELECT CASE WHEN target IS NULL THEN 'unresolved' WHEN confidence >= 0.9 THEN 'exact' WHEN confidence >= 0.5 THEN 'likely' ELSE 'possible' END AS bucket, count(*) AS n FROM resolved GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return resolve.confidence_histogram(_named(spark, sf_dir)[1])


@query("SELECT method, count(target) AS passed, count(*) - count(target) AS unchecked FROM resolved GROUP BY 1")
def type_check_buckets(spark, sf_dir):
    return resolve.type_check_buckets(_named(spark, sf_dir)[1])


@query("SELECT callee_name, CASE WHEN callee_name IN (SELECT name FROM methods) THEN 'method of another class' ELSE 'unknown name' END AS reason, count(*) AS n FROM resolved WHERE target IS NULL GROUP BY 1, 2")
def unresolved_calls(spark, sf_dir):
    return resolve.unresolved_calls(*_named(spark, sf_dir))


@query("SELECT caller, count(*) AS n_calls, count(target) AS n_resolved, count(DISTINCT callee_name) AS n_callees FROM resolved GROUP BY caller")
def callers_sorted(spark, sf_dir):
    return resolve.by_caller(_resolved(spark, sf_dir)[1])


@query("SELECT DISTINCT target AS node FROM resolved WHERE target IS NOT NULL AND target NOT IN (SELECT caller FROM resolved)")
def callee_only_nodes(spark, sf_dir):
    return resolve.callee_only(_resolved(spark, sf_dir)[1])


_DOT = "'\"' || replace(caller, chr(92), chr(92) || chr(92)) || '\" -> \"' || replace(target, chr(92), chr(92) || chr(92)) || '\" [color=' || CASE WHEN confidence >= 0.9 THEN 'green' WHEN confidence >= 0.5 THEN 'orange' ELSE 'red' END || '];'"


@query(f"SELECT DISTINCT {_DOT} AS line FROM resolved WHERE target IS NOT NULL")
def dot_edges(spark, sf_dir):
    from ..sources.sinks import dot_lines

    return dot_lines(_resolved(spark, sf_dir)[1])


@query("SELECT call_id, caller, target FROM resolved WHERE contains(target, 'S1::')")
def calls_to(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].where(F.col("target").contains("S1::")).select("call_id", "caller", "target")


@query("SELECT call_id, caller, target FROM resolved WHERE contains(caller, 'S1::')")
def calls_from(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].where(F.col("caller").contains("S1::")).select("call_id", "caller", "target")


@query("SELECT DISTINCT caller, caller = 'm3' OR ends_with(caller, '::m3') AS by_method, ends_with(caller, chr(92) || 'S4::m3') AS by_class FROM calls")
def pattern_match(spark, sf_dir):
    c = F.col("caller")
    return facts(spark, sf_dir).calls.select("caller", names.matches(c, "::m3").alias("by_method"), names.matches(c, "S4::m3").alias("by_class")).distinct()


@query("""SELECT DISTINCT a.target AS callee, p.q AS pattern FROM (SELECT DISTINCT target FROM resolved WHERE target IS NOT NULL) a
  CROSS JOIN (VALUES ('S4::m3'), ('m7'), ('N0' || chr(92) || 'S9::m1')) p(q)
  WHERE a.target = p.q OR ends_with(a.target, chr(92) || p.q) OR ends_with(p.q, chr(92) || a.target)
    OR (split_part(a.target, '::', 2) = CASE WHEN contains(p.q, '::') THEN split_part(p.q, '::', 2) ELSE p.q END
      AND (NOT contains(p.q, '::') OR split_part(a.target, '::', 1) = split_part(p.q, '::', 1) OR ends_with(split_part(a.target, '::', 1), chr(92) || split_part(p.q, '::', 1)) OR ends_with(split_part(p.q, '::', 1), chr(92) || split_part(a.target, '::', 1))))""")
def fuzzy_callee(spark, sf_dir):
    callees = _resolved(spark, sf_dir)[1].where("target IS NOT NULL").select(F.col("target").alias("callee")).distinct()
    patterns = spark.createDataFrame([("S4::m3",), ("m7",), ("N0\\S9::m1",)], "pattern string")
    return names.fuzzy_pairs(callees, patterns)


# ---------------------------------------------------------------- projects


@query("SELECT file_path, project FROM file_project")
def file_project(spark, sf_dir):
    f = facts(spark, sf_dir)
    return boundary.file_project(f.classes, f.projects)


@query("SELECT call_id, caller, target, caller_project, callee_project FROM boundary WHERE caller_project <> callee_project")
def boundary_calls(spark, sf_dir):
    return boundary.cross(_boundary(spark, sf_dir)[1]).select("call_id", "caller", "target", "caller_project", "callee_project")


@query("SELECT target, callee_project AS project, count(DISTINCT caller_project) AS n_callers, string_agg(DISTINCT caller_project, ',' ORDER BY caller_project) AS callers FROM boundary WHERE caller_project <> callee_project GROUP BY 1, 2")
def api_surface(spark, sf_dir):
    return boundary.api_surface(_boundary(spark, sf_dir)[1])


@query("SELECT caller_project, callee_project, count(*) AS n_calls FROM boundary WHERE caller_project <> callee_project GROUP BY 1, 2")
def project_dependencies(spark, sf_dir):
    return boundary.project_dependencies(_boundary(spark, sf_dir)[1])


@query("SELECT caller_project, callee_project, count(*) AS n_calls, count(DISTINCT target) AS n_api_methods FROM boundary WHERE caller_project <> callee_project GROUP BY 1, 2")
def boundary_summary(spark, sf_dir):
    return boundary.boundary_summary(_boundary(spark, sf_dir)[1])


@query("SELECT count(*) FILTER (caller_project = callee_project) AS same_project, count(*) FILTER (caller_project <> callee_project) AS cross_project, count(*) AS total, (SELECT count(*) FROM projects) AS n_projects FROM boundary")
def boundary_totals(spark, sf_dir):
    return boundary.boundary_totals(*_boundary(spark, sf_dir))


# ---------------------------------------------------------------- violations

_CROSS = ", x AS (SELECT b.*, m.visibility AS tv, m.params AS tp, m.return_type AS tr FROM boundary b JOIN methods m ON m.owner || '::' || m.name = b.target WHERE caller_project <> callee_project)"
_VISIBILITY = ", v AS (SELECT call_id, caller, target, tv AS visibility, CASE tv WHEN 'private' THEN 'error' ELSE 'warning' END AS severity FROM x WHERE tv IN ('private', 'protected'))"


@query(f"{_CROSS}{_VISIBILITY} SELECT * FROM v")
def visibility_violations(spark, sf_dir):
    return violations.visibility_violations(_boundary(spark, sf_dir)[1])


@query(f"{_CROSS}{_VISIBILITY} SELECT severity, count(*) AS n FROM v GROUP BY 1")
def severity_counts(spark, sf_dir):
    return violations.severity_counts(violations.visibility_violations(_boundary(spark, sf_dir)[1]))


_COUNTS = ", ac AS (SELECT * FROM (SELECT call_id, target, len(args)::INT AS n_args, len(list_filter(tp, lambda p: NOT p.has_default))::INT AS n_required, len(tp)::INT AS n_most FROM x) WHERE n_args < n_required OR n_args > n_most)"


@query(f"{_CROSS}{_COUNTS} SELECT * FROM ac")
def argument_count(spark, sf_dir):
    return violations.argument_counts(_boundary(spark, sf_dir)[1])


def _fits(arg: str, param: str) -> str:
    """argument_fits for the built-in types of the derived facts."""
    b = f"ltrim({arg}, '?')"
    p = f"ltrim({param}, '?')"
    return f"({param} IN ('mixed') OR {arg} = 'mixed' AND {param} = 'mixed' OR (NOT contains({arg}, '|') AND {b} = {p}) OR (contains({param}, '|') AND NOT contains({arg}, '|') AND list_contains(string_split({param}, '|'), {b})) OR (NOT contains({arg}, '|') AND {b} = 'int' AND {p} = 'float'))"


_ARGUMENTS = f""", ats AS (SELECT call_id, target, pos::INT AS pos, arg, param FROM (
  SELECT call_id, target, i AS pos, args[(i + 1)::INT] AS arg, tp[(i + 1)::INT].type AS param FROM (SELECT *, unnest(range(0, least(len(args), len(tp)))) AS i FROM x))
  WHERE arg IS NOT NULL AND param IS NOT NULL AND NOT CASE WHEN arg = 'null' THEN starts_with(param, '?') OR param = 'mixed' ELSE {_fits('arg', 'param')} END)"""


@query(f"{_CROSS}{_ARGUMENTS} SELECT * FROM ats")
def argument_types(spark, sf_dir):
    return violations.argument_types(*_boundary(spark, sf_dir))


@query(f"""{_CROSS} SELECT x.call_id, x.target, e.extends AS result, p.project AS third FROM x JOIN classes e ON e.fqn = split_part(x.target, '::', 1) JOIN class_project p ON p.fqn = e.extends
  WHERE p.project <> caller_project AND p.project <> callee_project""")
def third_project_return(spark, sf_dir):
    f, b = _boundary(spark, sf_dir)
    parent = f.classes.select(F.col("fqn").alias("target_owner"), F.col("extends").alias("r"))
    fluent = b.drop("target_return").join(parent, "target_owner", "left").withColumnRenamed("r", "target_return")  # methods return their class's parent
    return violations.third_project_returns(f, fluent)


_COMPLIANCE = f""", w AS (
  SELECT i.class, i.interface, m.name, m.params AS ip, m.return_type AS ir, a.visibility AS cv, a.params AS cp, a.return_type AS cr
  FROM implements i JOIN methods m ON m.owner = i.interface AND m.owner_kind = 'interface' LEFT JOIN all_methods a ON a.class = i.class AND a.name = m.name
), problems AS (
  SELECT class, interface, name, 'missing' AS problem FROM w WHERE cv IS NULL
  UNION ALL SELECT class, interface, name, 'param_count' FROM w WHERE cv IS NOT NULL AND len(ip) <> len(cp)
  UNION ALL SELECT class, interface, name, 'param_type' FROM w WHERE cv IS NOT NULL AND len(list_filter(range(1, least(len(ip), len(cp)) + 1), lambda i: NOT {_fits('ip[i::INT].type', 'cp[i::INT].type')})) > 0
  UNION ALL SELECT class, interface, name, 'return_type' FROM w WHERE cv IS NOT NULL AND NOT {_fits('cr', 'ir')}
  UNION ALL SELECT class, interface, name, 'visibility' FROM w WHERE cv IN ('private', 'protected')
)"""


@query(f"{_COMPLIANCE} SELECT class, interface, name FROM problems WHERE problem = 'missing'")
def interface_missing(spark, sf_dir):
    return violations.interface_compliance(_hierarchy(spark, sf_dir)).where("problem = 'missing'").drop("problem")


@query(f"{_COMPLIANCE} SELECT * FROM problems WHERE problem <> 'missing'")
def interface_signature(spark, sf_dir):
    return violations.interface_compliance(_hierarchy(spark, sf_dir)).where("problem <> 'missing'")


_API = ", api AS (SELECT DISTINCT target FROM boundary WHERE caller_project <> callee_project), sig AS (SELECT target, array_to_string(list_transform(params, lambda p: p.type), ',') AS param_types, return_type, visibility, is_static, len(params)::INT AS n_params, ord FROM api JOIN methods ON owner || '::' || name = target)"


def _signatures(spark, sf_dir):
    f, b = _boundary(spark, sf_dir)
    return violations.api_signatures(f, boundary.api_surface(b)), b


@query(f"{_API} SELECT target, param_types, return_type, visibility, is_static, n_params FROM sig")
def api_signatures(spark, sf_dir):
    return _signatures(spark, sf_dir)[0].drop("types")


def _changed(sig: DataFrame) -> DataFrame:
    """A later state: methods m0 are gone, m1 private, m2 return void, m3 have one more parameter, m4 none, m5 another first one, m6 return nothing declared."""
    is_ = lambda m: F.col("target").endswith(f"::{m}")
    t = F.col("types")
    return sig.where(~is_("m0")).select(
        "target",
        F.when(is_("m3"), F.concat(t, F.array(F.lit("int")))).when(is_("m4"), F.slice(t, 1, 0)).when(is_("m5"), F.transform(t, lambda x, i: F.when(i == 0, "resource").otherwise(x))).otherwise(t).alias("types"),
        F.when(is_("m2"), "void").when(~is_("m6"), F.col("return_type")).alias("return_type"),
        F.when(is_("m1"), "private").otherwise(F.col("visibility")).alias("visibility"),
    )


_BREAKING = f"""{_API}, breaking AS (
  SELECT target, 'method_removed' AS change FROM sig WHERE ends_with(target, '::m0')
  UNION ALL SELECT target, 'parameter_added_required' FROM sig WHERE ends_with(target, '::m3')
  UNION ALL SELECT target, 'parameter_removed' FROM sig WHERE ends_with(target, '::m4') AND n_params > 0
  UNION ALL SELECT target, 'parameter_type_changed' FROM sig WHERE ends_with(target, '::m5') AND n_params > 0
  UNION ALL SELECT target, 'return_type_changed' FROM sig WHERE ends_with(target, '::m2') AND return_type <> 'void'
  UNION ALL SELECT target, 'visibility_reduced' FROM sig WHERE ends_with(target, '::m1') AND visibility <> 'private'
)"""


@query(f"{_BREAKING} SELECT * FROM breaking")
def breaking_changes(spark, sf_dir):
    sig, _ = _signatures(spark, sf_dir)
    return violations.breaking_changes(sig, _changed(sig))


@query(f"""{_CROSS}{_VISIBILITY}{_COUNTS}{_ARGUMENTS}{_BREAKING}, pairs AS (SELECT caller_project, callee_project, count(*) AS n_calls FROM x GROUP BY ALL),
  bad AS (SELECT call_id FROM v UNION ALL SELECT call_id FROM ac UNION ALL SELECT call_id FROM ats),
  pv AS (SELECT caller_project, callee_project, count(*) AS n FROM bad JOIN x USING (call_id) GROUP BY ALL),
  pb AS (SELECT callee_project, count(*) AS n FROM breaking JOIN (SELECT DISTINCT target, callee_project FROM x) USING (target) GROUP BY ALL)
  SELECT caller_project, callee_project, n_calls, coalesce(pv.n, 0) AS n_violations, round(greatest(0.0, 1 - 0.1 * coalesce(pv.n, 0) - 0.2 * coalesce(pb.n, 0)), 6)::DOUBLE AS score
  FROM pairs LEFT JOIN pv USING (caller_project, callee_project) LEFT JOIN pb USING (callee_project)""")
def stability_scores(spark, sf_dir):
    f, b = _boundary(spark, sf_dir)
    sig, _ = _signatures(spark, sf_dir)
    out = violations.stability(cut(violations.pair_counts(f, b)), violations.breaking_changes(sig, _changed(sig)))
    return out.withColumn("score", F.col("score").cast("double"))


# ---------------------------------------------------------------- called before


def _events(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("caller"), F.col("event_type").alias("callee_name"), line.alias("line"))


_EVENTS = "e AS (SELECT user_id AS caller, event_type AS callee_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS line FROM events)"
_LOCAL = f"""WITH {_EVENTS}, m AS (
  SELECT *, min(line) FILTER (callee_name = 'signup') OVER (PARTITION BY caller) AS first, max(line) FILTER (callee_name = 'signup') OVER (PARTITION BY caller ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_line
  FROM e WHERE callee_name IN ('signup', 'purchase'))
SELECT caller, line, CASE WHEN first IS NULL THEN 'no_local' WHEN line < first THEN 'wrong_order' WHEN before_line IS NOT NULL THEN 'matched' ELSE 'same_line' END AS status, CASE WHEN line >= first THEN before_line END AS before_line
FROM m WHERE callee_name = 'purchase'"""


@query(_LOCAL, ctes=False)
def called_before_local(spark, sf_dir):
    c = F.col("callee_name")
    return called_before.local_checks(_events(spark, sf_dir), c == "signup", c == "purchase")


@query(f"SELECT caller, line, before_line FROM ({_LOCAL}) WHERE status = 'matched'", ctes=False)
def called_before_matches(spark, sf_dir):
    return called_before_local(spark, sf_dir).where("status = 'matched'").drop("status")


_INTER = """, g AS (SELECT *, min(line) FILTER (callee_name = 'm1') OVER (PARTITION BY caller) AS first FROM resolved),
origin AS (SELECT DISTINCT caller FROM g WHERE callee_name = 'm2' AND first IS NULL),
open_edge AS (SELECT DISTINCT caller, target FROM g WHERE target IS NOT NULL AND (first IS NULL OR first >= line)),
back(origin, node) AS (SELECT caller, caller FROM origin UNION SELECT b.origin, o.caller FROM back b JOIN open_edge o ON o.target = b.node),
bad AS (SELECT DISTINCT origin FROM back WHERE node NOT IN (SELECT target FROM resolved WHERE target IS NOT NULL))
SELECT caller, caller NOT IN (SELECT origin FROM bad) AS satisfied FROM origin"""


@query(_INTER)
def called_before_interproc(spark, sf_dir):
    _, r = _resolved(spark, sf_dir)
    c = F.col("callee_name")
    return called_before.interprocedural(r, c == "m1", c == "m2")


#: "m1 before m2" with witnesses; every function is met at its least depth from where its verdict is known.
_FINDINGS = """, c AS (SELECT caller, coalesce(target, callee_name) AS callee, line, file_path FROM resolved JOIN classes ON fqn = caller_class),
f AS (SELECT *, callee = 'm1' OR ends_with(callee, '::m1') AS is_b, callee = 'm2' OR ends_with(callee, '::m2') AS is_a FROM c),
g AS (SELECT *, max({'line': line, 'callee': callee}) FILTER (is_b) OVER (PARTITION BY caller ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(line) FILTER (is_b) OVER (PARTITION BY caller) AS first FROM f),
scope(node) AS (SELECT DISTINCT callee FROM g WHERE is_a UNION SELECT caller FROM scope JOIN c ON callee = node),
fn AS (SELECT DISTINCT caller AS node FROM c WHERE caller IN (SELECT node FROM scope)),
key AS (SELECT DISTINCT callee FROM c WHERE callee IN (SELECT node FROM scope)),
alone AS (SELECT node, string_split(node, '::')[1] AS k, string_split(node, '::')[2] AS m FROM fn WHERE node NOT IN (SELECT callee FROM key)),
likely AS (SELECT callee, node FROM key JOIN alone ON ends_with(callee, chr(92) || node) OR callee = m OR (contains(callee, '::') AND split_part(callee, '::', 2) = m AND (ends_with(split_part(callee, '::', 1), chr(92) || k) OR ends_with(k, chr(92) || split_part(callee, '::', 1))))),
e AS (SELECT caller AS src, callee AS dst, line, file_path, b FROM g WHERE callee IN (SELECT node FROM fn) UNION ALL SELECT caller, node, line, file_path, b FROM g JOIN likely USING (callee)),
fr AS (SELECT src, dst, min({'line': line, 'file': file_path}) AS x FROM e WHERE b IS NULL GROUP BY ALL),
walk(node, depth) AS (SELECT node, 0 FROM fn WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst, depth + 1 FROM walk JOIN fr ON src = node WHERE depth < 30),
opened AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
via AS (SELECT o.node, o.depth, min({'src': src, 'line': x.line, 'file': x.file}) AS v FROM opened o LEFT JOIN (SELECT fr.*, p.depth AS d FROM fr JOIN opened p ON p.node = src) q ON q.dst = o.node AND q.d = o.depth - 1 GROUP BY ALL),
closed AS (SELECT node FROM fn WHERE node NOT IN (SELECT node FROM opened)),
seen AS (SELECT dst AS node, min({'ctx': src, 'line': line, 'b': b}) AS w FROM e WHERE b IS NOT NULL AND dst IN (SELECT node FROM closed) GROUP BY dst),
led(node, depth, w) AS (SELECT node, 0, w FROM seen UNION SELECT dst, depth + 1, w FROM led JOIN fr ON src = node WHERE depth < 30 AND dst IN (SELECT node FROM closed) AND dst NOT IN (SELECT node FROM seen)),
witness AS (SELECT node, arg_min(w, {'depth': depth, 'w': w}) AS w FROM led GROUP BY node),
after_call AS (SELECT * FROM g WHERE is_a),
violation AS (
  SELECT caller AS context_function, file_path, line AS after_line, first AS before_line, 'wrong_order' AS kind, NULL::VARCHAR AS missing_caller, NULL::INT AS missing_line, NULL::VARCHAR AS missing_file, NULL::INT AS n_steps FROM after_call WHERE line < first
  UNION ALL SELECT caller, file_path, line, NULL, 'missing_before', v.src, v.line, v.file, depth FROM after_call JOIN via ON node = caller WHERE first IS NULL
), match AS (
  SELECT caller AS context_function, file_path, line AS after_line, callee AS after_callee, b.line AS before_line, b.callee AS before_callee, false AS via_caller, NULL::VARCHAR AS caller_context FROM after_call WHERE line >= first AND b IS NOT NULL
  UNION ALL SELECT caller, file_path, line, callee, w.b.line, w.b.callee, true, w.ctx FROM after_call JOIN witness ON node = caller WHERE first IS NULL
)"""


def _findings(spark, sf_dir):
    """The findings of "m1 before m2", each table written once a session."""
    f, r = _resolved(spark, sf_dir)
    calls = r.drop("file_path").join(_files(spark, sf_dir), "caller_class")
    c = F.col("callee")
    found = []

    def part(name: str) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            found[:] = found or [called_before.analyse(calls, names.matches(c, "m1"), names.matches(c, "m2"))]
            return getattr(found[0], name)

        return make

    return called_before.Findings(*(kept(spark, sf_dir, f"before-{name}", part(name)) for name in ("violations", "matches", "satisfied_in", "missing_paths")))


@query(f"{_FINDINGS} SELECT * FROM violation")
def called_before_violations(spark, sf_dir):
    """Violations with the caller through which the nearest uncalled function leads there."""
    return _findings(spark, sf_dir).violations


@query(f"{_FINDINGS} SELECT * FROM match")
def called_before_witnesses(spark, sf_dir):
    """Matches, local and by callers."""
    return _findings(spark, sf_dir).matches


@query(f"{_FINDINGS} SELECT dst AS context_function, src AS caller, x.line AS call_line, x.file AS file_path FROM fr WHERE dst IN (SELECT context_function FROM violation WHERE kind = 'missing_before') AND src IN (SELECT node FROM opened)")
def called_before_missing_paths(spark, sf_dir):
    return _findings(spark, sf_dir).missing_paths


@query(f"{_FINDINGS} SELECT DISTINCT caller AS context_function FROM after_call WHERE (first IS NOT NULL AND caller NOT IN (SELECT context_function FROM violation)) OR (first IS NULL AND caller IN (SELECT node FROM closed))")
def called_before_satisfied(spark, sf_dir):
    return _findings(spark, sf_dir).satisfied_in


# ---------------------------------------------------------------- liveness


_LIVE = f""", {_OVERRIDES}, refs AS (
  SELECT target, 'resolved_call' AS reason, false AS is_weak FROM resolved WHERE target IS NOT NULL
  UNION SELECT split_part(target, '::', 1), 'static_access', false FROM resolved WHERE target IS NOT NULL
  UNION SELECT callee_name, 'unresolved_call', true FROM resolved WHERE target IS NULL
  UNION SELECT extends, 'inheritance', false FROM classes WHERE extends IS NOT NULL
  UNION SELECT interface, 'interface_impl', false FROM implements
  UNION SELECT trait, 'trait_use', false FROM uses
), symbols AS (
  SELECT fqn, 'class' AS kind, 'public' AS visibility FROM classes UNION ALL SELECT fqn, 'interface', 'public' FROM interfaces UNION ALL SELECT fqn, 'trait', 'public' FROM traits
  UNION ALL SELECT fqn, 'function', 'public' FROM functions UNION ALL SELECT owner || '::' || name, 'method', visibility FROM methods UNION ALL SELECT owner || '::$' || name, 'property', 'private' FROM properties
), edge AS (
  SELECT owner || '::' || name AS src, owner AS dst FROM methods UNION SELECT owner || '::$' || name, owner FROM properties UNION SELECT fqn, extends FROM classes WHERE extends IS NOT NULL
  UNION SELECT class, interface FROM implements UNION SELECT class, trait FROM uses UNION SELECT trait, class FROM uses
  UNION SELECT owner, owner || '::' || name FROM methods WHERE owner_kind = 'interface' UNION SELECT base, override FROM overrides
), strong(node) AS (SELECT target FROM refs WHERE NOT is_weak AND target IN (SELECT fqn FROM symbols) UNION SELECT e.dst FROM strong s JOIN edge e ON e.src = s.node),
marked AS (
  SELECT fqn, kind FROM symbols WHERE kind IN ('method', 'function') AND visibility <> 'private' AND fqn NOT IN (SELECT node FROM strong)
  AND CASE kind WHEN 'method' THEN split_part(fqn, '::', 2) ELSE split_part(fqn, chr(92), 2) END IN (SELECT target FROM refs WHERE is_weak)
), more(node) AS (SELECT fqn FROM marked UNION SELECT e.dst FROM more m JOIN edge e ON e.src = m.node),
weak AS (SELECT fqn FROM marked WHERE kind = 'method'),
alive_s AS (SELECT node AS fqn FROM (SELECT node FROM strong UNION SELECT node FROM more WHERE node NOT IN (SELECT fqn FROM weak)) WHERE node IN (SELECT fqn FROM symbols)),
dead AS (SELECT * FROM symbols WHERE fqn NOT IN (SELECT fqn FROM alive_s) AND fqn NOT IN (SELECT fqn FROM weak))
"""


@query(f"{_LIVE} SELECT target, reason, is_weak FROM refs")
def liveness_refs(spark, sf_dir):
    return liveness.references(*_named(spark, sf_dir))


@query(f"{_LIVE} SELECT fqn FROM alive_s")
def alive_strong(spark, sf_dir):
    return _alive(spark, sf_dir)[1].where("mark = 'strong'").select("fqn")


@query(f"{_LIVE} SELECT fqn FROM weak")
def alive_weak(spark, sf_dir):
    return _alive(spark, sf_dir)[1].where("mark = 'weak'").select("fqn")


def _alive(spark, sf_dir):
    f, r = _named(spark, sf_dir)
    return f, kept(spark, sf_dir, "alive", lambda: liveness.alive(f, r))


def _dead(spark, sf_dir):
    return liveness.dead(*_alive(spark, sf_dir))


@query(f"{_LIVE} SELECT fqn, kind, visibility FROM dead")
def dead_symbols(spark, sf_dir):
    return _dead(spark, sf_dir)


@query(f"{_LIVE} SELECT CASE kind WHEN 'method' THEN CASE visibility WHEN 'private' THEN 'private_method' ELSE 'other_method' END ELSE kind END AS kind, count(*) AS n FROM dead GROUP BY 1")
def dead_counts(spark, sf_dir):
    return liveness.dead_counts(_dead(spark, sf_dir))


@query(f"{_LIVE} SELECT fqn, kind FROM dead ORDER BY fqn, kind LIMIT 50")
def dead_top50(spark, sf_dir):
    return _dead(spark, sf_dir).select("fqn", "kind").orderBy("fqn", "kind").limit(50)


@query("SELECT root, 'psr-4' AS kind, file_path FROM projects JOIN classes ON starts_with(file_path, root || '/') UNION ALL SELECT 'extra', 'files', file_path FROM classes")
def discovered_files(spark, sf_dir):
    """Source files by autoload entries: each project's folder, and every file once more by its path."""
    f = facts(spark, sf_dir)
    folders = f.projects.select("root", F.lit("psr-4").alias("kind"), F.col("root").alias("path"))
    single = f.classes.select(F.lit("extra").alias("root"), F.lit("files").alias("kind"), F.col("file_path").alias("path"))
    return projects.discover(folders.unionByName(single), f.classes)


_EVENT = "SELECT class || '::onEvent' AS caller, interface || '::handle' AS target FROM implements"


@query(f"SELECT method, count(*) AS n, round(sum(confidence), 2) AS confidence, count(DISTINCT target) AS targets FROM (SELECT method, confidence, target FROM resolved UNION ALL SELECT 'plugin_generated', 0.95, target FROM ({_EVENT})) GROUP BY 1")
def merged_edges(spark, sf_dir):
    """The call graph with edges of a plugin: here every class dispatches to its interface."""
    f, r = _resolved(spark, sf_dir)
    edges = f.implements.select(F.concat("class", F.lit("::onEvent")).alias("caller"), F.concat("interface", F.lit("::handle")).alias("target"))
    return resolve.with_synthetic(r, edges).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"), F.countDistinct("target").alias("targets"))


_BAD = "SELECT count(*) FILTER (v = 'private') AS errors, count(*) FILTER (v = 'protected') AS warnings FROM (SELECT m.visibility AS v FROM boundary b JOIN methods m ON b.target = m.owner || '::' || m.name WHERE caller_project <> callee_project)"


@query(f"SELECT errors, warnings, errors > 0 OR warnings > 0 AS failed FROM ({_BAD})")
def visibility_verdict(spark, sf_dir):
    """Whether a strict check of visibility fails."""
    return violations.fails(violations.visibility_violations(_boundary(spark, sf_dir)[1]), strict=True)


# ---------------------------------------------------------------- documents


def _quote(c: str) -> str:
    """The SQL of a quoted name."""
    return f"'\"' || replace({c}, chr(92), chr(92) || chr(92)) || '\"'"


def _document(head: str, parts: list[str]) -> str:
    """The SQL of a document: its parts give lines."""
    rows = [f"SELECT 0 AS section, '{head}' AS line", *(f"SELECT {i + 1}, line FROM ({part})" for i, part in enumerate(parts)), f"SELECT {len(parts) + 1}, '}}'"]
    return " UNION ALL ".join(rows)


_EDGE = f"{_quote('caller')} || ' -> ' || {_quote('target')} || ' [color=\"' || CASE WHEN confidence >= 0.9 THEN '#4caf50' WHEN confidence >= 0.5 THEN '#ff9800' ELSE '#f44336' END || '\"];'"


@query(_document("digraph CallGraph { rankdir=LR; node [shape=box];", [
    f"SELECT DISTINCT {_quote('caller')} || ' [style=filled, fillcolor=\"#e1f5fe\"];' AS line FROM resolved",
    f"SELECT DISTINCT {_quote('target')} || ' [style=filled, fillcolor=\"#fff3e0\"];' AS line FROM resolved WHERE target IS NOT NULL AND target NOT IN (SELECT caller FROM resolved)",
    f"SELECT DISTINCT {_EDGE} AS line FROM resolved WHERE target IS NOT NULL",
]))
def call_graph_dot(spark, sf_dir):
    return sinks.call_graph_dot(_resolved(spark, sf_dir)[1])


_PAIRS = "(SELECT caller_project AS a, callee_project AS b, count(*) AS n FROM boundary WHERE caller_project <> callee_project GROUP BY 1, 2)"
_SHORT = "string_split({}, '/')[-1]"


@query(_document("digraph ProjectDependencies { rankdir=LR; node [shape=box];", [
    f"SELECT DISTINCT {_quote(_SHORT.format('p'))} || ';' AS line FROM (SELECT a AS p FROM {_PAIRS} UNION SELECT b FROM {_PAIRS})",
    f"SELECT {_quote(_SHORT.format('a'))} || ' -> ' || {_quote(_SHORT.format('b'))} || ' [label=\"' || n || ' calls\"];' AS line FROM {_PAIRS}",
]))
def boundary_dot(spark, sf_dir):
    return sinks.boundary_dot(boundary.project_dependencies(_boundary(spark, sf_dir)[1]))


@query(f"""SELECT 'dependencies' AS section, json_object('from', a, 'to', b, 'call_count', n)::VARCHAR AS json FROM {_PAIRS} UNION ALL
  SELECT 'api_surface', json_object('fqn', target, 'class', split_part(target, '::', 1), 'method', split_part(target, '::', 2), 'used_by', list_transform(p, lambda x: {_SHORT.format('x')}))::VARCHAR
  FROM (SELECT target, list_sort(list(DISTINCT caller_project)) AS p FROM boundary WHERE caller_project <> callee_project GROUP BY target)""")
def boundary_json(spark, sf_dir):
    b = _boundary(spark, sf_dir)[1]
    return sinks.boundary_json(boundary.project_dependencies(b), boundary.api_surface(b))


_PLACED = f"""{_LIVE}, place_of AS (
  SELECT fqn, 'class' AS kind, file_path, 1 AS line FROM classes UNION ALL SELECT fqn, 'interface', '/lib/interfaces.php', 1 FROM interfaces UNION ALL SELECT fqn, 'trait', '/lib/traits.php', 1 FROM traits
  UNION ALL SELECT fqn, 'function', '/mono/AFRICA/functions.php', 1 FROM functions
  UNION ALL SELECT owner || '::' || name, 'method', CASE owner_kind WHEN 'interface' THEN '/lib/interfaces.php' WHEN 'trait' THEN '/lib/traits.php' ELSE file_path END, ord FROM methods LEFT JOIN classes ON fqn = owner
  UNION ALL SELECT fqn || '::$v' || (p_partkey % 9), 'property', any_value(file_path), max(p_partkey) FROM part CROSS JOIN size_n JOIN classes ON k = p_partkey % n GROUP BY 1
), placed AS (SELECT dead.*, file_path, line FROM dead LEFT JOIN place_of USING (fqn, kind))
"""


def _placed(spark, sf_dir):
    f, living = _alive(spark, sf_dir)
    return liveness.located(f, liveness.dead(f, living))


@query(f"{_PLACED} SELECT fqn, '  [DEAD] ' || fqn || ' (' || kind || ')' || chr(10) || '    at ' || file_path || ':' || line AS line FROM placed")
def dead_text(spark, sf_dir):
    return sinks.dead_text(_placed(spark, sf_dir))


@query(f"{_PLACED} SELECT json_object('fqn', fqn, 'kind', kind, 'file', file_path, 'line', line)::VARCHAR AS json FROM placed")
def dead_json(spark, sf_dir):
    return sinks.dead_json(_placed(spark, sf_dir))


@query(f"""{_PLACED} SELECT json_object('ruleId', 'dead-code', 'level', 'warning', 'message', json_object('text', 'Dead ' || kind || ': ' || fqn), 'locations', json_array(json_object('physicalLocation',
  json_object('artifactLocation', json_object('uri', file_path), 'region', json_object('startLine', line)))))::VARCHAR AS json FROM placed""")
def dead_sarif(spark, sf_dir):
    return sinks.sarif_results(sinks.dead_violations(_placed(spark, sf_dir)))


@query(f"""{_PLACED} SELECT file_path, min(fqn) AS first, '<file name="' || file_path || '">' || string_agg('<error line="' || line || '" severity="warning" message="Dead ' || kind || ': ' || fqn || '" source="dead-code"/>', '' ORDER BY fqn) || '</file>' AS xml
  FROM placed GROUP BY file_path""")
def dead_checkstyle(spark, sf_dir):
    return sinks.checkstyle(sinks.dead_violations(_placed(spark, sf_dir)))


@query(f"{_PLACED} SELECT fqn, kind FROM placed WHERE kind <> 'property' AND (kind <> 'method' OR visibility = 'private')")
def dead_reported(spark, sf_dir):
    """What is reported unless flags ask for more."""
    return liveness.dead_filter(_dead(spark, sf_dir)).select("fqn", "kind")


# ---------------------------------------------------------------- reports and comparisons


@query("""SELECT json_object('total', count(*), 'resolved', count(target)) AS coverage, count(*) FILTER (confidence >= 0.9) AS exact, count(*) FILTER (target IS NULL) AS unresolved FROM resolved""")
def report_summary(spark, sf_dir):
    _, r = _named(spark, sf_dir)
    hit = F.col("target").isNotNull()
    counts = r.agg(resolve.n_calls(r).alias("total"), resolve.n_calls(r, hit).alias("hit"), resolve.n_calls(r, (F.col("confidence") >= 0.9) & hit).alias("exact"), resolve.n_calls(r, ~hit).alias("unresolved"))
    return counts.select(F.to_json(F.struct("total", F.col("hit").alias("resolved"))).alias("coverage"), "exact", "unresolved")


@query("""SELECT fqn, problem FROM (
  SELECT fqn, CASE WHEN b IS NULL THEN 'extra' WHEN a IS NULL THEN 'missing' WHEN a.extends IS DISTINCT FROM b.extends THEN 'extends_differs' END AS problem
  FROM (SELECT coalesce(x.fqn, y.fqn) AS fqn, CASE WHEN x.fqn IS NOT NULL THEN {'extends': x.extends} END AS a, CASE WHEN y.fqn IS NOT NULL THEN {'extends': y.extends} END AS b
    FROM (SELECT * FROM classes WHERE k % 10 <> 1) x FULL JOIN (SELECT k, fqn, CASE WHEN k % 7 = 3 THEN 'other' ELSE extends END AS extends FROM classes WHERE k % 10 <> 2) y ON x.fqn = y.fqn))
  WHERE problem IS NOT NULL""")
def symbol_diff(spark, sf_dir):
    c = facts(spark, sf_dir).classes
    truth = c.where("k % 10 <> 2").withColumn("extends", F.when(F.col("k") % 7 == 3, "other").otherwise(F.col("extends")))
    return compare.symbol_diff(c.where("k % 10 <> 1"), truth, ["extends"])


_DIFF = ORACLES["symbol_diff"]


@query(f"{_DIFF.replace('SELECT fqn, problem FROM (', 'SELECT problem, count(*) AS n FROM (', 1)} GROUP BY 1", ctes=False)
def diff_summary(spark, sf_dir):
    return compare.diff_summary(symbol_diff(spark, sf_dir))


@query("""SELECT metric, actual, expected, CASE rule WHEN 'no_drop' THEN actual >= expected WHEN 'ten_percent' THEN abs(actual - expected) <= 0.1 * abs(expected) ELSE actual <= 2 * expected END AS ok FROM (
  SELECT 'calls' AS metric, count(*)::DOUBLE AS actual, 1000000::DOUBLE AS expected, 'no_drop' AS rule FROM resolved
  UNION ALL SELECT 'resolved', count(target)::DOUBLE, count(*)::DOUBLE * 0.36, 'ten_percent' FROM resolved
  UNION ALL SELECT 'classes', count(*)::DOUBLE, 80::DOUBLE, 'twice' FROM classes)""")
def golden_compare(spark, sf_dir):
    f, r = _resolved(spark, sf_dir)
    d = lambda c: c.cast("double")
    counts = r.agg(d(F.count(F.lit(1))).alias("n"), d(F.count("target")).alias("hit"))
    actual = counts.selectExpr("stack(2, 'calls', n, 'resolved', hit) AS (metric, value)").unionByName(f.classes.agg(F.lit("classes").alias("metric"), d(F.count(F.lit(1))).alias("value")))
    golden = counts.selectExpr("stack(3, 'calls', cast(1000000 AS double), 'no_drop', 'resolved', n * 0.36D, 'ten_percent', 'classes', cast(80 AS double), 'twice') AS (metric, value, rule)")
    return compare.golden_compare(actual, golden)


@query("""SELECT corpus, round(w / bw, 6) AS wall_ratio, round(m / bm, 6) AS memory_ratio, w / bw <= 2.0 AND m / bm <= 1.5 AS ok FROM (
  SELECT event_type AS corpus, median(value) AS w, max(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1) JOIN (SELECT event_type AS corpus, median(value) AS bw, max(value) AS bm FROM events WHERE event_id % 2 = 1 GROUP BY 1) USING (corpus)""", ctes=False)
def bench_compare(spark, sf_dir):
    """Medians of one set of runs against those of another: events stand for runs."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("corpus"), F.col("value").alias("wall_ms"), F.col("value").alias("memory_mb"), (F.col("event_id") % 2 == 0).alias("current"))
    return compare.bench_compare(compare.medians(runs.where("current")), compare.medians(runs.where("NOT current")))


# ---------------------------------------------------------------- names and types as text


@query("""SELECT DISTINCT k % 3 AS rule, CASE k % 3 WHEN 0 THEN 'Lib' || chr(92) || 'S' || k WHEN 1 THEN 'N' || n || chr(92) || 'X' ELSE 'Lib' || chr(92) || 'Deep' || chr(92) || 'Y' END AS fqn FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)""", ctes=False)
def import_resolution(spark, sf_dir):
    """Names by rule: an import, the own namespace, an import of the first segment."""
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    imports = F.create_map(F.concat(F.lit("A"), k.cast("string")), F.concat(F.lit("Lib\\S"), k.cast("string")), F.lit("D"), F.lit("Lib\\Deep"))
    name = F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"))).when(k % 3 == 1, "X").otherwise("D\\Y")
    return s.select((k % 3).alias("rule"), names.resolve_name(name, imports, F.concat(F.lit("N"), n.cast("string"))).alias("fqn")).distinct()


_KINDS = {"int": "simple", "string": "simple", "float": "simple", "bool": "simple", "mixed": "mixed", "array": "simple", "?int": "nullable", "int|string": "union_type"}


@query("SELECT t, k AS kind, n AS n_parts, count(*) AS uses FROM methods, unnest(params) u(p) JOIN (VALUES " + ", ".join(f"('{t}', '{k}', {2 if '|' in t else 0}::INT)" for t, k in _KINDS.items()) + ") v(t, k, n) ON v.t = p.type GROUP BY ALL")
def type_parse(spark, sf_dir):
    t = F.col("t")
    used = facts(spark, sf_dir).methods.select(F.explode("params.type").alias("t"))
    return used.groupBy("t", typing.kind(t).alias("kind"), F.size(typing.parts(t)).alias("n_parts")).agg(F.count(F.lit(1)).alias("uses"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html, '<[a-z]+')) AS tag FROM pages) SELECT substr(tag, 2) AS tag, count(*) AS n FROM t GROUP BY 1""", ctes=False)
def source_scan(spark, sf_dir):
    """Text scan of sources: opening tags of pages, as the event scan does with class names."""
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z]+)"), 1)).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


assert set(_KINDS) == set(TYPES)


# ---------------------------------------------------------------- sources

# One file a supplier, so that SQL derives the rows: supplier k has the (k % n)-th of each.

#: Body of f(?X $r, $n), what it accesses $r as, and in which state.
_BODIES = (
    ("$r->g();", "method", "possibly_null"),
    ("if ($r !== null) { $r->g(); }", "method", "definitely_not_null"),
    ("if ($r === null) { return; } $n = $r->p;", "property", "definitely_not_null"),
    ("$r = null; $r->g();", "method", "definitely_null"),
    ("$n = $r[0];", "array", "possibly_null"),
    ("if ($r instanceof X) { $n = 1; } else { $r->g(); }", "method", "possibly_null"),
    ("if ($n) { $r = new X(); } $r->g();", "method", "definitely_not_null"),
    ("if ($r === null) { throw new E(); } $r->g();", "method", "definitely_not_null"),
)
#: Declared result and body of g(), its status and problem.
_RESULTS = (
    (": int", "return 1;", "verified", None),
    (": int", "return 'a';", "failed", "return_type_mismatch"),
    (": void", "return 1;", "failed", "void_with_value"),
    (": int", "$n = 1;", "failed", "missing_return"),
    (": ?int", "return null;", "verified", None),
    ("", "return 1;", "uncertain", None),
)
#: Body of h(), the target of its call, confidence and method; @ is k.
_CALLS = (
    ("strlen('a');", "strlen", 1.0, "explicit_type"),
    ("self::f(null, 1);", "S@::f", 1.0, "static_call"),
    ("Ext::make();", "Ext::make", 0.5, "static_call"),
    ("$x = new S@(); $x->f(null, 1);", "S@::f", 1.0, "assignment_tracking"),
    ("helper@();", "helper@", 1.0, "explicit_type"),
)


def _generated(spark, sf_dir):
    """The fact tables of those files, parsed once a session."""
    from ..sources.php.facts import fact_rows, tables

    own = F.col("s_suppkey").cast("string")
    pick = lambda rows, i: F.replace(F.element_at(F.array(*(F.lit(r[i]) for r in rows)), (F.col("s_suppkey") % len(rows) + 1).cast("int")), F.lit("@"), own)
    parts = ["<?php class S", own, " { public function f(?X $r, $n) { ", pick(_BODIES, 0), " } public function g()", pick(_RESULTS, 0), " { ", pick(_RESULTS, 1), " } public function h() { ", pick(_CALLS, 0), " } } function helper", own, "() { return 1; }"]
    content = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/gen/S"), own, F.lit(".php")).alias("file_path"), content.alias("content"))
    return tables(kept(spark, sf_dir, "generated", lambda: fact_rows(files)))


def _case(rows, i: int) -> str:
    """The SQL of the i-th field."""
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}"
    return f"CASE s_suppkey % {len(rows)} " + " ".join(f"WHEN {k} THEN {value(r[i])}" for k, r in enumerate(rows)) + " END"


_ACCESSES = f"SELECT 'S' || s_suppkey || '::f' AS method, {_case(_BODIES, 1)} AS access, {_case(_BODIES, 2)} AS state FROM supplier UNION ALL SELECT 'S' || s_suppkey || '::h', 'method', 'definitely_not_null' FROM supplier WHERE s_suppkey % {len(_CALLS)} = 3"  # h() calls f() of a new object
_CHECKS = f"SELECT 'S' || s_suppkey || '::g' AS method, {_case(_RESULTS, 2)} AS status, {_case(_RESULTS, 3)} AS problem FROM supplier UNION ALL SELECT 'S' || s_suppkey || m, 'uncertain', NULL FROM supplier CROSS JOIN (VALUES ('::f'), ('::h')) v(m)"


@query(_ACCESSES, ctes=False)
def null_accesses(spark, sf_dir):
    return _generated(spark, sf_dir)["null_accesses"].select("method", "access", "state")


@query(f"SELECT count(*) FILTER (state = 'definitely_not_null') AS guarded, count(*) FILTER (state IN ('possibly_null', 'definitely_null')) AS unguarded, count(*) FILTER (state = 'definitely_null') AS definite FROM ({_ACCESSES})", ctes=False)
def null_counters(spark, sf_dir):
    return violations.null_counters(_generated(spark, sf_dir)["null_accesses"])


@query(_CHECKS, ctes=False)
def return_checks(spark, sf_dir):
    return _generated(spark, sf_dir)["returns"].select("method", "status", "problem")


@query(f"SELECT count(DISTINCT method) AS total, count(DISTINCT method) FILTER (status = 'verified') AS verified, count(DISTINCT method) FILTER (status = 'failed') AS failed, count(DISTINCT method) FILTER (status = 'uncertain') AS uncertain FROM ({_CHECKS})", ctes=False)
def return_counters(spark, sf_dir):
    return violations.return_counters(_generated(spark, sf_dir)["returns"])


@query(f"SELECT 'S' || s_suppkey || '::h' AS caller, replace({_case(_CALLS, 1)}, '@', s_suppkey::VARCHAR) AS target, ({_case(_CALLS, 2)})::DOUBLE AS confidence, {_case(_CALLS, 3)} AS method FROM supplier", ctes=False)
def parsed_calls(spark, sf_dir):
    """Calls from source text to their targets: built-in, own and external static, tracked and user functions."""
    from ..sources.php.facts import BUILTIN_FUNCTIONS, resolve_sites

    resolved = resolve.resolve_calls(resolve_sites(_generated(spark, sf_dir)), BUILTIN_FUNCTIONS)
    return resolved.where("caller LIKE '%::h'").select("caller", "target", F.col("confidence").cast("double").alias("confidence"), "method")


@query(f"SELECT method, problem, 1 AS line FROM ({_CHECKS}) WHERE problem IS NOT NULL", ctes=False)
def return_diagnostics(spark, sf_dir):
    return _generated(spark, sf_dir)["returns"].where("problem IS NOT NULL").select("method", "problem", "line")


@query(f"SELECT method, state, 1 AS line FROM ({_ACCESSES})", ctes=False)
def null_states(spark, sf_dir):
    return _generated(spark, sf_dir)["null_accesses"].select("method", "state", "line")


#: Suppliers dispatch events, parts map them to handlers; names are whole, short or of another namespace.
_DISPATCHES = "SELECT fqn || '::m' || (k % 41) AS caller, CASE k % 3 WHEN 0 THEN fqn WHEN 1 THEN 'S' || k ELSE 'N9' || chr(92) || 'S' || k END AS event, file_path, (k % 9)::INT AS line FROM classes"
_MAPS = "SELECT fqn AS class, CASE WHEN p_partkey % 500 = 0 THEN '*' WHEN p_partkey % 2 = 0 THEN fqn ELSE 'S' || k END AS mapped, 'm' || (p_partkey % 41) AS handler FROM part CROSS JOIN size_n JOIN names ON k = p_partkey % n"
_EVENT_EDGES = f"SELECT DISTINCT caller, class || '::' || handler AS target, file_path, line FROM ({_DISPATCHES}) JOIN ({_MAPS}) ON mapped = '*' OR event = mapped OR ends_with(event, chr(92) || mapped) OR ends_with(mapped, chr(92) || event)"


def _dispatched(spark, sf_dir):
    """Facts with events: see _DISPATCHES and _MAPS."""
    f = facts(spark, sf_dir)
    k, fqn = F.col("k"), F.col("fqn")
    short = F.concat(F.lit("S"), k.cast("string"))
    sent = f.classes.select(F.concat(fqn, F.lit("::m"), (k % 41).cast("string")).alias("caller"), F.when(k % 3 == 0, fqn).when(k % 3 == 1, short).otherwise(F.concat(F.lit("N9\\"), short)).alias("event"), "file_path", (k % 9).cast("int").alias("line"))
    p = F.col("p_partkey")
    n = f.classes.agg(F.count(F.lit(1)).alias("n"))
    maps = table(spark, sf_dir, "part").select("p_partkey").crossJoin(F.broadcast(n)).withColumn("k", p % F.col("n")).join(f.classes.select("k", "fqn"), "k")
    maps = maps.select(fqn.alias("class"), F.when(p % 500 == 0, "*").when(p % 2 == 0, fqn).otherwise(short).alias("event"), F.concat(F.lit("m"), (p % 41).cast("string")).alias("handler"))
    return f.with_(extra=f.extra | {"dispatches": sent, "event_maps": maps})


@query(f"SELECT DISTINCT caller, target FROM ({_EVENT_EDGES})")
def event_edges(spark, sf_dir):
    """What the plugin for events adds to the call graph."""
    return plugins.run(_dispatched(spark, sf_dir), ["events"])[0].select("caller", "target")


@query(_FINDINGS.replace("FROM resolved JOIN classes ON fqn = caller_class)", f"FROM resolved JOIN classes ON fqn = caller_class UNION ALL SELECT caller, target, line, file_path FROM ({_EVENT_EDGES}))", 1) + " SELECT * FROM violation")
def called_before_merged(spark, sf_dir):
    """Violations of "m1 before m2" once the plugin's edges have joined the graph."""
    f, r = _resolved(spark, sf_dir)
    calls = r.drop("file_path").join(_files(spark, sf_dir), "caller_class").select("caller", "target", "callee_name", "line", "file_path")
    edges, sites, every = event_sites(_dispatched(spark, sf_dir).extra)
    added = edges.select("caller", "target", F.substring_index("target", "::", -1).alias("callee_name"), "line", "file_path")
    sets = called_before.Sets(sites.withColumn("set", F.lit("*")), every.select(F.lit("*").alias("set"), F.col("target").alias("callee")))
    c = F.col("callee")
    return called_before.analyse(calls.unionByName(added), names.matches(c, "m1"), names.matches(c, "m2"), sets=sets).violations


_TREE = ", kin AS (SELECT c.k AS dst, p.k AS src FROM classes c JOIN classes p ON c.extends = p.fqn)"


@query(f"""{_TREE}, way(root, node, path) AS (SELECT k, k, k::VARCHAR FROM classes WHERE extends IS NULL UNION ALL SELECT root, dst, path || ',' || dst FROM way JOIN kin ON src = node)
SELECT root::VARCHAR AS method, path FROM way WHERE node NOT IN (SELECT src FROM kin)""")
def cfg_paths(spark, sf_dir):
    """All paths through branching graphs: trees of classes, from each root to its leaves."""
    edges, starts = _trees(spark, sf_dir)
    return simple_paths(edges, starts).select(F.col("graph").alias("method"), F.array_join("path", ",").alias("path"))


@query(f"""{_TREE}, below(root, node) AS (SELECT k, k FROM classes WHERE extends IS NULL UNION SELECT root, dst FROM below JOIN kin ON src = node)
SELECT root::VARCHAR AS method, count(*)::INT AS n_blocks FROM below GROUP BY root""")
def cfg_reachability(spark, sf_dir):
    """Nodes that each root reaches."""
    edges, starts = _trees(spark, sf_dir)
    met = reach_pairs(edges.select("src", "dst"), starts.select(F.col("graph").alias("origin"), "node"))
    return met.groupBy(F.col("origin").alias("method")).agg(F.count(F.lit(1)).cast("int").alias("n_blocks"))


def _trees(spark, sf_dir):
    """Trees of classes as graphs of their own, named by their roots: (edges(graph, src, dst), starts(graph, node))."""
    c = facts(spark, sf_dir).classes
    kin = c.select(F.col("k").alias("dst"), F.col("extends").alias("fqn")).join(c.select("fqn", F.col("k").alias("src")), "fqn").select("src", "dst")
    starts = c.where("extends IS NULL").select(F.col("k").cast("string").alias("graph"), F.col("k").alias("node"))
    graphs = reach_pairs(kin, starts.select(F.col("graph").alias("origin"), "node"))
    return cut(kin.join(graphs.select(F.col("origin").alias("graph"), F.col("node").alias("src")), "src").select("graph", "src", "dst")), starts


@query("""SELECT s_suppkey AS k, name, replace(type, '@', s_suppkey::VARCHAR) AS type, 'List<B' || s_suppkey || '>' AS result FROM supplier CROSS JOIN (VALUES ('rows', 'array<int, X@>'), ('one', '?T')) v(name, type)""", ctes=False)
def doc_params(spark, sf_dir):
    """Parameters of doc comments, and their result with the template bound."""
    c, own = F.col("doc"), F.col("s_suppkey").cast("string")
    doc = F.concat(F.lit("/**\n * Does it.\n * @template T of B"), own, F.lit("\n * @param array<int, X"), own, F.lit("> $rows\n * @param ?T $one some text\n * @return List<T>\n * @throws Failure\n */"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), doc.alias("doc"))
    rows = rows.select("k", F.explode(docs.params(c)).alias("p"), docs.tag_type(c, "return").alias("r"), F.map_from_entries(F.transform(docs.templates(c), lambda t: F.struct(t["name"], t["bound"]))).alias("b"))
    return rows.select("k", "p.name", "p.type", docs.substitute(F.col("r"), F.col("b")).alias("result"))


# ---------------------------------------------------------------- generics


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), use AS (
  SELECT DISTINCT p_partkey % n AS k, 'E' || (p_partkey % 7) AS e, p_partkey % 5 = 0 AS few FROM part CROSS JOIN n
), bound AS (
  SELECT CASE k % 3 WHEN 0 THEN 'R' || k || '<Box<' || e || '>>' WHEN 1 THEN 'R' || k || '<int' || CASE WHEN few THEN '' ELSE ', ' || e END || '>' ELSE 'R' || k END AS type,
    'R' || (k - k % 3) AS owner, CASE k % 3 WHEN 0 THEN 'Box<' || e || '>' WHEN 1 THEN CASE WHEN few THEN 'V' ELSE e END ELSE 'List<int, D' || k || '>' END AS x, string_split(CASE k % 3 WHEN 0 THEN 'Box' WHEN 1 THEN CASE WHEN few THEN 'V' ELSE e END ELSE 'List' END, '<')[1] AS h FROM use
)
SELECT DISTINCT type, owner, name, CASE name WHEN 'get' THEN '?' || x WHEN 'all' THEN 'List<' || x || '>' WHEN 'map' THEN 'Map<string, List<' || x || '>>' WHEN 'either' THEN h || '|null' ELSE 'int' END AS result
FROM bound CROSS JOIN (VALUES ('get'), ('all'), ('map'), ('either'), ('size')) v(name)""", ctes=False)
def generic_returns(spark, sf_dir):
    """What methods of generic ancestors return: class k of each three has T, K and V, or none, and the last two extend the first with arguments."""
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("R"), x.cast("string"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    given = F.when(k % 3 == 0, F.array(F.lit("T"))).when(k % 3 == 1, F.array(F.lit("K"), F.lit("V"))).otherwise(F.array().cast("array<string>"))
    templates = s.select(name(k).alias("owner"), F.posexplode(given).alias("pos", "name"))
    parent = F.concat(name(k - k % 3), F.when(k % 3 == 1, "<V>").otherwise(F.concat(F.lit("<List<int, D"), k.cast("string"), F.lit(">>"))))
    extends = s.where("s_suppkey % 3 > 0").select(name(k).alias("class"), parent.alias("type"))
    declared = (("get", "?T"), ("all", "List<T>"), ("map", "Map<string, List<T>>"), ("either", "T|null"), ("size", "int"))
    methods = s.where("s_suppkey % 3 = 0").select(name(k).alias("owner"), F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("return_type")) for a, b in declared))).alias("m")).select("owner", "m.*")
    p = F.col("p_partkey")
    used = table(spark, sf_dir, "part").select("p_partkey").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))).select((p % F.col("n")).alias("k"), F.concat(F.lit("E"), (p % 7).cast("string")).alias("e"), (p % 5 == 0).alias("few"))
    k = F.col("k")
    arguments = F.when(k % 3 == 0, F.concat(F.lit("<Box<"), "e", F.lit(">>"))).when(k % 3 == 1, F.when(F.col("few"), "<int>").otherwise(F.concat(F.lit("<int, "), "e", F.lit(">")))).otherwise("")
    receivers = used.select(F.concat(name(k), arguments).alias("type")).distinct()
    return generics.method_returns(receivers, methods, templates, extends).select("type", "owner", "name", "result")


# ---------------------------------------------------------------- first matches, dumps, whole reports


@query("""SELECT b.call_id, (SELECT min(c.call_id) FROM placed c WHERE c.target = b.target AND c.file_path = b.file_path AND c.line = b.line) AS first_call FROM (SELECT boundary.*, file_path FROM boundary JOIN classes ON fqn = caller_class) b WHERE caller_project <> callee_project""".replace("FROM placed c", "FROM (SELECT resolved.*, file_path FROM resolved JOIN classes ON fqn = caller_class) c"))
def first_matches(spark, sf_dir):
    """For calls across projects the first call of the same target on the same line of the same file."""
    _, b = _boundary(spark, sf_dir)
    at = _files(spark, sf_dir)
    placed = lambda df: df.drop("file_path").join(at, "caller_class")
    return violations.first_matches(placed(boundary.cross(b)), placed(_resolved(spark, sf_dir)[1])).select("call_id", "first_call")


_THEIRS = """, tc AS (SELECT k, fqn, CASE WHEN k % 7 = 3 THEN 'other' ELSE extends END AS extends, is_abstract, is_final <> (k % 11 = 5) AS is_final FROM classes WHERE k % 10 <> 2),
oc AS (SELECT * FROM classes WHERE k % 10 <> 1), shared AS (SELECT fqn FROM oc JOIN tc USING (fqn)),
kinds AS (
  SELECT fqn AS class, NULL AS member, 'class_missing_in_ours' AS kind FROM tc WHERE fqn NOT IN (SELECT fqn FROM oc)
  UNION ALL SELECT fqn, NULL, 'class_missing_in_theirs' FROM oc WHERE fqn NOT IN (SELECT fqn FROM tc)
  UNION ALL SELECT fqn, NULL, 'class_field_mismatch' FROM oc JOIN tc USING (fqn) WHERE oc.extends IS DISTINCT FROM tc.extends
  UNION ALL SELECT fqn, NULL, 'class_field_mismatch' FROM oc JOIN tc USING (fqn) WHERE oc.is_final <> tc.is_final
  UNION ALL SELECT owner, name, CASE WHEN ord % 23 = 1 THEN 'method_missing_in_theirs' WHEN ord % 23 = 2 THEN 'method_missing_in_ours' ELSE 'method_field_mismatch' END FROM methods JOIN shared ON fqn = owner
    WHERE ord % 23 IN (1, 2) OR (ord % 23 = 3 AND visibility <> 'private') OR (ord % 23 = 4 AND len(params) > 0)
  UNION ALL SELECT owner, name, 'method_field_mismatch' FROM methods JOIN shared ON fqn = owner WHERE ord % 23 = 4 AND len(params) > 0
  UNION ALL SELECT owner, name, CASE WHEN type = 'float' THEN 'property_missing_in_theirs' WHEN type = 'array' THEN 'property_missing_in_ours' ELSE 'property_field_mismatch' END FROM properties JOIN shared ON fqn = owner WHERE type IN ('float', 'array', 'bool')
  UNION ALL SELECT fqn, NULL, 'implements_mismatch' FROM classes JOIN shared USING (fqn) WHERE k % 6 = 4
)"""


@query(f"{_THEIRS} SELECT class, member, kind FROM kinds")
def reflection_diff(spark, sf_dir):
    """Ten kinds of differences between a dump and a changed one: types in other order, repeated and added interfaces among them."""
    f = facts(spark, sf_dir)
    k, o, t = F.col("k"), F.col("ord") % 23, F.col("type")
    number = f.classes.select(F.col("fqn").alias("class"), "k")
    flipped = F.when(t == "int|string", "string|int").when(t == "?int", "null|int")
    ours = compare.Dump(f.classes.where("k % 10 <> 1"), f.methods.where(o != 2), f.properties.where(t != "array"), f.implements)
    params = F.when(o == 4, F.slice("params", 1, F.greatest(F.size("params") - 1, F.lit(0)))).otherwise(F.col("params"))
    their_methods = f.methods.where(o != 1).withColumn("visibility", F.when(o == 3, "private").otherwise(F.col("visibility"))).withColumn("params", params)
    their_properties = f.properties.where(t != "float").withColumn("type", F.when(t == "bool", "callable").otherwise(F.coalesce(flipped, t)))
    added = number.where(k % 6 == 4).select("class", F.lit("Countable").alias("interface"))
    again = f.implements.join(number.where(k % 6 == 2), "class").select("class", "interface")
    their_classes = f.classes.where("k % 10 <> 2").withColumn("extends", F.when(k % 7 == 3, "other").otherwise(F.col("extends"))).withColumn("is_final", F.col("is_final") != (k % 11 == 5))
    theirs = compare.Dump(their_classes, their_methods, their_properties, f.implements.unionByName(added).unionByName(again))
    return compare.reflection_diff(ours, theirs).select("class", "member", "kind")


_BUCKET = {"interface_compliance": "'explicit_type'", "call_site_args": "'static_call'", "property_types": "'property_type'", "return_types": "'return_type_chain'"}
_SHARES = {"exact": "confidence >= 0.9", "likely": "confidence >= 0.5 AND confidence < 0.9", "possible": "confidence < 0.5 AND target IS NOT NULL", "unresolved": "target IS NULL"}
_KINDS_OF_DEAD = {"dead_classes": "kind = 'class'", "dead_interfaces": "kind = 'interface'", "dead_traits": "kind = 'trait'", "dead_functions": "kind = 'function'", "dead_private_methods": "kind = 'method' AND visibility = 'private'", "dead_other_methods": "kind = 'method' AND visibility <> 'private'", "dead_properties": "kind = 'property'"}
_VIOLATION = "SELECT 'visibility' AS rule, CASE tv WHEN 'private' THEN 'error' ELSE 'warning' END AS severity, 'Call of ' || tv || ' ' || target AS message, file_path, line FROM x JOIN classes ON fqn = caller_class WHERE tv IN ('private', 'protected')"


def _items(section: int, rows: str, key: str, json: str) -> str:
    """The SQL of a part with commas."""
    one = f"SELECT {key} AS key, ({json})::VARCHAR AS j, count(*) AS n FROM ({rows}) GROUP BY ALL"
    return f"SELECT {section} AS section, key, CASE WHEN row_number() OVER (ORDER BY key, j) > 1 THEN ',' ELSE '' END || array_to_string(list_transform(range(n), lambda i: j), ',' || chr(10)) AS line FROM ({one})"


def _member(section: int, name: str, rows: str, comma: str = ",") -> str:
    return f"SELECT {section}, '', '\"{name}\": ' || ({rows})::VARCHAR || '{comma}'"


_KEY = "file_path || chr(31) || lpad(line::VARCHAR, 12, '0') || chr(31) || rule"


@query(f"{_PLACED}{_CROSS} " + " UNION ALL ".join([
    "SELECT 0 AS section, '' AS key, '{' AS line",
    _member(1, "coverage", "SELECT json_object('classes', (SELECT count(*) FROM classes), 'methods', (SELECT count(*) FROM methods), 'calls', count(*), 'resolution_rate', round(100.0 * count(target) / count(*), 1)::DOUBLE) FROM resolved"),
    _member(2, "type_checks", "SELECT json_object(" + ", ".join(f"'{b}', json_object('pass', count(*) FILTER (target IS NOT NULL AND method = {m}), 'fail', 0, 'unchecked', {'count(*) - count(target)' if b == 'call_site_args' else 0})" for b, m in _BUCKET.items()) + ") FROM resolved"),
    _member(3, "dead_code", "SELECT json_object(" + ", ".join(f"'{n}', count(*) FILTER ({c})" for n, c in _KINDS_OF_DEAD.items()) + ", 'top_dead_candidates', (SELECT to_json(list({'fqn': fqn, 'kind': kind, 'file': file_path, 'line': line} ORDER BY fqn, kind)) FROM (SELECT * FROM placed ORDER BY fqn, kind LIMIT 50))) FROM dead"),
    _member(4, "confidence", "SELECT json_object(" + ", ".join(f"'{n}', round(100.0 * count(*) FILTER ({c}) / count(*), 1)::DOUBLE" for n, c in _SHARES.items()) + ", " + ", ".join(f"'{n}_count', count(*) FILTER ({c})" for n, c in _SHARES.items()) + ") FROM resolved"),
    "SELECT 5, '', '\"violations\": ['",
    _items(6, _VIOLATION, _KEY, "json_object('severity', severity, 'file', file_path, 'line', line, 'message', message)"),
    "SELECT 7, '', ']'", "SELECT 8, '', '}'",
]))
def report_json(spark, sf_dir):
    """A whole report as one JSON document."""
    return documents.report_json(_report(spark, sf_dir))


def _report(spark, sf_dir):
    f, r = _resolved(spark, sf_dir)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rate = r.agg(F.count(F.lit(1)).alias("calls"), F.round(100.0 * F.count("target") / F.count(F.lit(1)), 1).alias("resolution_rate"))
    coverage = n(f.classes, "classes").crossJoin(n(f.methods, "methods")).crossJoin(rate)
    top = _placed(spark, sf_dir).orderBy("fqn", "kind").limit(50)
    return documents.Report(coverage, r, liveness.dead_counts(_dead(spark, sf_dir)), top, _visible(spark, sf_dir))


def _visible(spark, sf_dir):
    """Violations of visibility with their places."""
    f, b = _boundary(spark, sf_dir)
    v = F.col("target_visibility")
    bad = boundary.cross(b).where(v.isin("private", "protected")).drop("file_path").join(_files(spark, sf_dir), "caller_class")
    return bad.select(F.lit("visibility").alias("rule"), F.when(v == "private", "error").otherwise("warning").alias("severity"), F.concat(F.lit("Call of "), v, F.lit(" "), "target").alias("message"), "file_path", "line")


@query(f"{_CROSS} " + " UNION ALL ".join([
    f"SELECT 0 AS section, '' AS key, '{{\"$schema\": \"{documents.SARIF_SCHEMA}\", \"version\": \"2.1.0\", \"runs\": [{{\"tool\": {{\"driver\": {{\"name\": \"{documents.TOOL}\", \"rules\": [' AS line",
    _items(1, f"SELECT rule, min(severity) AS level FROM ({_VIOLATION}) GROUP BY rule", "rule", "json_object('id', rule, 'defaultConfiguration', json_object('level', level))"),
    "SELECT 2, '', ']}}, \"results\": ['",
    _items(3, _VIOLATION, _KEY, "json_object('ruleId', rule, 'level', severity, 'message', json_object('text', message), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path), 'region', json_object('startLine', line)))))"),
    "SELECT 4, '', ']}]}'",
]))
def report_sarif(spark, sf_dir):
    """Violations as one SARIF log."""
    return documents.report_sarif(_visible(spark, sf_dir))


@query(f"{_CROSS} , v AS ({_VIOLATION}) SELECT 0 AS section, '' AS key, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' AS line UNION ALL SELECT 1, '', '<checkstyle version=\"8.0\">' UNION ALL SELECT 3, '', '</checkstyle>' UNION ALL SELECT 2, key, line FROM ("
       "SELECT DISTINCT file_path || chr(31) || '0' AS key, '<file name=\"' || file_path || '\">' AS line FROM v UNION ALL SELECT DISTINCT file_path || chr(31) || '2', '</file>' FROM v UNION ALL "
       "SELECT file_path || chr(31) || '1' || lpad(line::VARCHAR, 12, '0') || chr(31) || rule, '<error line=\"' || line || '\" severity=\"' || severity || '\" message=\"' || message || '\" source=\"' || rule || '\"/>' FROM v)")
def report_checkstyle(spark, sf_dir):
    """Violations as one Checkstyle document."""
    return documents.report_checkstyle(_visible(spark, sf_dir))


@query(f"{_FINDINGS} " + " UNION ALL ".join([
    "SELECT 0 AS section, '' AS key, '{' AS line", "SELECT 1, '', '\"constraint\": {\"before\": \"m1\", \"after\": \"m2\"},'",
    "SELECT 2, '', '\"satisfied\": ' || (SELECT count(*) = 0 FROM violation)::VARCHAR || ','", "SELECT 3, '', '\"violations\": ['",
    _items(4, "SELECT * FROM violation", "context_function || chr(31) || lpad(after_line::VARCHAR, 12, '0')", "json_object('context_function', context_function, 'file', file_path, 'after_line', after_line, 'before_line', before_line, 'kind', kind)"),
    "SELECT 5, '', '],'", "SELECT 6, '', '\"matches\": ['",
    _items(7, "SELECT * FROM match", "context_function || chr(31) || lpad(after_line::VARCHAR, 12, '0')", "json_object('context_function', context_function, 'file', file_path, 'after_line', after_line, 'after_callee', after_callee, 'before_line', before_line, 'before_callee', before_callee)"),
    "SELECT 8, '', '],'",
    _member(9, "summary", "SELECT json_object('violations', (SELECT count(*) FROM violation), 'matches', (SELECT count(*) FROM match), 'satisfied_functions', (SELECT count(DISTINCT caller) FROM after_call WHERE (first IS NOT NULL AND caller NOT IN (SELECT context_function FROM violation)) OR (first IS NULL AND caller IN (SELECT node FROM closed))))", ""),
    "SELECT 10, '', '}'",
]))
def called_before_json(spark, sf_dir):
    """The findings as one JSON document."""
    return documents.called_before_json(_findings(spark, sf_dir), "m1", "m2")


# ---------------------------------------------------------------- call sites against interfaces, dumps


@query(f"""{_CROSS}, placed_at AS (SELECT 'I' || n_nationkey AS interface FROM place), w AS (
  SELECT x.call_id, x.target, i.interface, m.params AS ip, m.return_type AS ir, x.tp AS cp, x.tr AS cr FROM x JOIN implements i ON i.class = split_part(x.target, '::', 1) JOIN class_project ON fqn = i.class
  JOIN placed_at USING (interface) JOIN methods m ON m.owner = i.interface AND m.owner_kind = 'interface' AND m.name = split_part(x.target, '::', 2)
) SELECT call_id, target, interface, 'return_type' AS problem, NULL::INT AS pos FROM w WHERE ltrim(ir, '?') <> ltrim(cr, '?')
  UNION ALL SELECT call_id, target, interface, 'param_count', NULL FROM w WHERE len(ip) <> len(cp)
  UNION ALL SELECT call_id, target, interface, 'param_type', (i - 1)::INT FROM (SELECT *, unnest(range(1, least(len(ip), len(cp)) + 1)) AS i FROM w) WHERE ltrim(ip[i::INT].type, '?') <> ltrim(cp[i::INT].type, '?')""")
def call_site_compliance(spark, sf_dir):
    """Calls whose method differs from that of an interface; interface j is in the project of nation j's region."""
    f, b = _boundary(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("I"), F.col("n_nationkey").cast("string"))
    placed = nations.select(name.alias("fqn"), F.concat(F.lit("/mono/"), "r_name", F.lit("/"), name, F.lit(".php")).alias("file_path"))
    return violations.call_site_compliance(f.with_(interfaces=placed), b)


@query("""SELECT CASE WHEN target IS NULL THEN json_object('caller', caller, 'callee', callee_name, 'confidence', confidence, 'line', line)
  ELSE json_object('caller', caller, 'callee', callee_name, 'resolved_target', target, 'confidence', confidence, 'line', line) END::VARCHAR AS json FROM resolved""")
def call_graph_json(spark, sf_dir):
    return sinks.call_graph_json(_resolved(spark, sf_dir)[1])


@query("""SELECT fqn, '{"fqcn":' || to_json(fqn)::VARCHAR || ',"is_abstract":' || is_abstract || ',"is_final":' || is_final || coalesce(',"extends":' || to_json(extends)::VARCHAR, '') || coalesce(',"methods":' || to_json(methods)::VARCHAR, '') || '}' AS json
  FROM classes LEFT JOIN (SELECT owner, list({'name': name, 'visibility': visibility, 'is_static': is_static, 'return_type': return_type} ORDER BY name) AS methods FROM methods GROUP BY owner) ON owner = fqn""")
def symbol_dump(spark, sf_dir):
    return sinks.symbol_dump(facts(spark, sf_dir))
