"""Code facts derived from star-schema tables by integer arithmetic, so that SQL can derive the same.

Suppliers are classes, parts are methods, line items are calls, nations are
interfaces, regions and even nations are projects; CTES is the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facts import Facts, last_write_wins

#: Types of parameters, results and arguments, by number.
TYPES = ("int", "string", "float", "bool", "mixed", "array", "?int", "int|string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _type(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (number % len(TYPES) + 1).cast("int"))


def class_name(k, nation) -> F.Column:
    return F.concat(F.lit("N"), nation.cast("string"), F.lit("\\S"), k.cast("string"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """All fact tables; plans only, nothing runs."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = t("supplier").select("s_suppkey", "s_nationkey")
    names = suppliers.select(F.col("s_suppkey").alias("k"), class_name(F.col("s_suppkey"), F.col("s_nationkey")).alias("fqn"))
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    k = F.col("s_suppkey")
    parent = F.when((k > 0) & (k % 5 != 0), F.floor((k - 1) / 2).cast("long"))
    classes = (
        suppliers.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("k"),
            class_name(k, F.col("s_nationkey")).alias("fqn"),
            F.concat(F.lit("/mono/"), "r_name", F.lit("/"), "n_name", F.lit("/S"), k.cast("string"), F.lit(".php")).alias("file_path"),
            parent.alias("parent"),
            (k % 13 == 0).alias("is_abstract"),
            (k % 17 == 0).alias("is_final"),
        )
    )
    up = names.select(F.col("k").alias("parent"), F.col("fqn").alias("extends"))
    classes = classes.join(up, "parent", "left").select("k", "fqn", "file_path", "extends", "is_abstract", "is_final")
    interface = lambda j: F.concat(F.lit("I"), j.cast("string"))
    nations = t("nation").select("n_nationkey")
    implements = names.select(F.col("fqn").alias("class"), interface((F.col("k") * 3) % 25).alias("interface"))
    interfaces = nations.select(interface(F.col("n_nationkey")).alias("fqn"), F.lit("/lib/interfaces.php").alias("file_path"))
    traits = nations.where("n_nationkey < 7").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("fqn"), F.lit("/lib/traits.php").alias("file_path"))
    uses = names.where("k % 4 = 0").select(F.col("fqn").alias("class"), F.concat(F.lit("T"), (F.col("k") % 7).cast("string")).alias("trait"), F.lit(0).alias("use_ord"))

    p = F.col("p_partkey")
    params = F.transform(
        F.when(F.col("p_size") % 4 > 0, F.sequence(F.lit(0), F.col("p_size") % 4 - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat(F.lit("p"), i.cast("string")).alias("name"),
            _type(p + i * 3).alias("type"),
            ((p + i * 3) % len(TYPES) == 6).alias("nullable"),
            ((p + i) % 5 == 0).alias("has_default"),
            F.lit(False).alias("is_variadic"),
        ),
    )
    visibility = F.when(p % 7 == 0, "private").when(p % 7 == 1, "protected").otherwise("public")
    common = [visibility.alias("visibility"), (p % 11 == 0).alias("is_static"), _type(p).alias("return_type"), params.alias("params"), p.cast("int").alias("line"), p.alias("ord")]
    # Nobody calls a method whose name begins with u.
    name = F.concat(F.when(p % 9 == 4, "u").otherwise("m"), ((p * 7 + F.col("p_size")) % 41).cast("string"))
    parts = t("part").select("p_partkey", "p_size")
    own = parts.where("p_size % 3 = 0").crossJoin(F.broadcast(n)).select((p % F.col("n")).alias("k"), name.alias("name"), *common).join(names, "k").select(F.col("fqn").alias("owner"), F.lit("class").alias("owner_kind"), "name", *[c.alias(a) for c, a in [(F.col(x), x) for x in ("visibility", "is_static", "return_type", "params", "line", "ord")]])
    of_traits = parts.where("p_size % 3 = 1").select(F.concat(F.lit("T"), (p % 7).cast("string")).alias("owner"), F.lit("trait").alias("owner_kind"), name.alias("name"), *common)
    of_interfaces = parts.where("p_size % 3 = 2").select(interface(p % 25).alias("owner"), F.lit("interface").alias("owner_kind"), name.alias("name"), F.lit("public").alias("visibility"), *common[1:])
    methods = last_write_wins(own.unionByName(of_traits).unionByName(of_interfaces), ["owner", "name"], ["ord"])
    properties = parts.crossJoin(F.broadcast(n)).select((p % F.col("n")).alias("k"), F.concat(F.lit("v"), (p % 9).cast("string")).alias("name"), _type(p).alias("type"), p.cast("int").alias("line"), p.alias("ord")).join(names, "k").select(F.col("fqn").alias("owner"), "name", "type", F.lit("private").alias("visibility"), "line", "ord")
    properties = last_write_wins(properties, ["owner", "name"], ["ord"])

    o, ln = F.col("l_orderkey"), F.col("l_linenumber")
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    mine, theirs = names.select(F.col("k").alias("l_suppkey"), F.col("fqn").alias("caller_class")), names.select(F.col("k").alias("receiver_k"), F.col("fqn").alias("receiver"))
    calls = (
        items.crossJoin(F.broadcast(n))
        .withColumn("receiver_k", F.col("l_partkey") % F.col("n"))
        .join(mine, "l_suppkey")
        .join(theirs, "receiver_k")
        .select(
            (o * 8 + ln).alias("call_id"),
            F.concat("caller_class", F.lit("::m"), (o % 41).cast("string")).alias("caller"),
            "caller_class",
            F.concat(F.lit("m"), ((o + ln) % 41).cast("string")).alias("callee_name"),
            "receiver",
            F.when(F.col("l_returnflag") == "A", "simple").when(F.col("l_returnflag") == "N", "nullable").otherwise("union_type").alias("receiver_kind"),
            (F.when(F.col("l_returnflag") == "A", "parameter_type").when(F.col("l_returnflag") == "N", "property_type").otherwise("return_type_chain")).alias("how"),
            ln.cast("int").alias("line"),
            F.transform(F.when(F.col("l_quantity").cast("int") % 4 > 0, F.sequence(F.lit(0), F.col("l_quantity").cast("int") % 4 - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.when((o + i) % 9 == 0, F.lit(None).cast("string")).when((o + i) % 9 == 1, F.lit("null")).otherwise(_type(o + i * 2))).alias("args"),
        )
    )
    projects = t("region").select(F.concat(F.lit("/mono/"), "r_name").alias("root")).unionByName(places.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/mono/"), "r_name", F.lit("/"), "n_name").alias("root")))
    functions = nations.where("n_nationkey < 10").select(F.concat(F.lit("lib\\f"), F.col("n_nationkey").cast("string")).alias("fqn"), F.lit("/mono/AFRICA/functions.php").alias("file_path"))
    events = t("events").select("event_id", "ts", "user_id", "event_type")
    return Facts(classes, methods, calls, implements, uses, interfaces, traits, functions, properties, projects, {"events": events})


_T = "['int', 'string', 'float', 'bool', 'mixed', 'array', '?int', 'int|string']"
_PARAMS = f"""list_transform(range(0, p_size % 4), lambda i: {{'name': 'p' || i, 'type': {_T}[((p_partkey + i * 3) % 8 + 1)::INT], 'nullable': (p_partkey + i * 3) % 8 = 6, 'has_default': (p_partkey + i) % 5 = 0}})"""

#: The same facts for DuckDB, as the head of a WITH clause.
CTES = f"""
place AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
size_n AS (SELECT count(*) AS n FROM supplier),
names AS (SELECT s_suppkey AS k, 'N' || s_nationkey || chr(92) || 'S' || s_suppkey AS fqn FROM supplier),
classes AS (
  SELECT s_suppkey AS k, c.fqn, '/mono/' || r_name || '/' || n_name || '/S' || s_suppkey || '.php' AS file_path, p.fqn AS extends, s_suppkey % 13 = 0 AS is_abstract, s_suppkey % 17 = 0 AS is_final
  FROM supplier JOIN place ON s_nationkey = n_nationkey JOIN names c ON c.k = s_suppkey
  LEFT JOIN names p ON s_suppkey > 0 AND s_suppkey % 5 <> 0 AND p.k = (s_suppkey - 1) // 2
),
implements AS (SELECT fqn AS class, 'I' || ((k * 3) % 25) AS interface FROM names),
interfaces AS (SELECT 'I' || n_nationkey AS fqn FROM nation),
traits AS (SELECT 'T' || n_nationkey AS fqn FROM nation WHERE n_nationkey < 7),
uses AS (SELECT fqn AS class, 'T' || (k % 7) AS trait, 0 AS use_ord FROM names WHERE k % 4 = 0),
method_rows AS (
  SELECT fqn AS owner, 'class' AS owner_kind, p_partkey, p_size FROM part CROSS JOIN size_n JOIN names ON names.k = p_partkey % n WHERE p_size % 3 = 0
  UNION ALL SELECT 'T' || (p_partkey % 7), 'trait', p_partkey, p_size FROM part WHERE p_size % 3 = 1
  UNION ALL SELECT 'I' || (p_partkey % 25), 'interface', p_partkey, p_size FROM part WHERE p_size % 3 = 2
),
methods AS (
  SELECT owner, owner_kind, CASE WHEN p_partkey % 9 = 4 THEN 'u' ELSE 'm' END || ((p_partkey * 7 + p_size) % 41) AS name,
    CASE WHEN owner_kind = 'interface' THEN 'public' WHEN p_partkey % 7 = 0 THEN 'private' WHEN p_partkey % 7 = 1 THEN 'protected' ELSE 'public' END AS visibility,
    p_partkey % 11 = 0 AS is_static, {_T}[(p_partkey % 8 + 1)::INT] AS return_type, {_PARAMS} AS params, p_partkey AS ord
  FROM method_rows QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY p_partkey DESC) = 1
),
properties AS (
  SELECT fqn AS owner, 'v' || (p_partkey % 9) AS name, {_T}[(p_partkey % 8 + 1)::INT] AS type FROM part CROSS JOIN size_n JOIN names ON names.k = p_partkey % n
  QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY p_partkey DESC) = 1
),
calls AS (
  SELECT l_orderkey * 8 + l_linenumber AS call_id, a.fqn || '::m' || (l_orderkey % 41) AS caller, a.fqn AS caller_class, 'm' || ((l_orderkey + l_linenumber) % 41) AS callee_name, b.fqn AS receiver,
    CASE l_returnflag WHEN 'A' THEN 'simple' WHEN 'N' THEN 'nullable' ELSE 'union_type' END AS receiver_kind,
    CASE l_returnflag WHEN 'A' THEN 'parameter_type' WHEN 'N' THEN 'property_type' ELSE 'return_type_chain' END AS how, l_linenumber AS line,
    list_transform(range(0, l_quantity::INT % 4), lambda i: CASE WHEN (l_orderkey + i) % 9 = 0 THEN NULL WHEN (l_orderkey + i) % 9 = 1 THEN 'null' ELSE {_T}[((l_orderkey + i * 2) % 8 + 1)::INT] END) AS args
  FROM lineitem CROSS JOIN size_n JOIN names a ON a.k = l_suppkey JOIN names b ON b.k = l_partkey % n
),
projects AS (SELECT '/mono/' || r_name AS root FROM region UNION ALL SELECT '/mono/' || r_name || '/' || n_name FROM place WHERE n_nationkey % 2 = 0),
functions AS (SELECT 'lib' || chr(92) || 'f' || n_nationkey AS fqn FROM nation WHERE n_nationkey < 10),
ancestors(class, ancestor, dist) AS (
  SELECT fqn, extends, 1 FROM classes WHERE extends IS NOT NULL
  UNION ALL SELECT a.class, c.extends, a.dist + 1 FROM ancestors a JOIN classes c ON c.fqn = a.ancestor WHERE c.extends IS NOT NULL
),
lineage AS (SELECT fqn AS class, fqn AS ancestor, 0 AS dist FROM classes UNION ALL SELECT * FROM ancestors),
all_methods AS (
  SELECT class, name, owner, visibility, is_static, return_type, params FROM (
    SELECT l.class, m.*, 0 AS rank, dist AS near, 0 AS use_ord FROM lineage l JOIN methods m ON m.owner = l.ancestor
    UNION ALL SELECT l.class, m.*, 1, -dist, u.use_ord FROM lineage l JOIN uses u ON u.class = l.ancestor JOIN methods m ON m.owner = u.trait
  ) QUALIFY row_number() OVER (PARTITION BY class, name ORDER BY rank, near, use_ord) = 1
),
resolved AS (
  SELECT c.*, m.owner || '::' || m.name AS target, CASE WHEN m.owner IS NULL THEN 0.0 ELSE CASE receiver_kind WHEN 'simple' THEN 1.0 WHEN 'nullable' THEN 0.9 ELSE 0.5 END END::DOUBLE AS confidence,
    CASE WHEN m.owner IS NULL THEN 'unresolved' ELSE how END AS method
  FROM calls c LEFT JOIN all_methods m ON m.class = c.receiver AND m.name = c.callee_name
),
owner_file AS (SELECT fqn, file_path FROM classes),
file_project AS (
  SELECT file_path, arg_max(root, length(root)) AS project FROM (SELECT DISTINCT file_path FROM classes) JOIN projects ON starts_with(file_path, root) GROUP BY file_path
),
class_project AS (SELECT fqn, project FROM classes JOIN file_project USING (file_path)),
boundary AS (
  SELECT r.*, p.project AS caller_project, q.project AS callee_project
  FROM resolved r JOIN class_project p ON p.fqn = r.caller_class JOIN class_project q ON q.fqn = split_part(r.target, '::', 1)
)
"""
