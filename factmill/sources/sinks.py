"""Reports as rows of text: DOT, JSON, SARIF, Checkstyle. Rows are written by Spark, one file a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_project
from ..operators.resolve import callee_only

#: SARIF levels by severity (fixed values).
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def document(head: str, body: list[DataFrame], foot: str) -> DataFrame:
    """(section, line): what stands before the lines, the lines of each part under its number, what stands after."""
    out = body[0].sparkSession.createDataFrame([(0, head), (len(body) + 1, foot)], "section int, line string")
    for i, part in enumerate(body):
        out = out.unionByName(part.select(F.lit(i + 1).alias("section"), "line"))
    return out


def dot_lines(resolved: DataFrame, colours: tuple[str, str, str] = ("green", "orange", "red")) -> DataFrame:
    """One line for every distinct edge; the colour tells the confidence."""
    c = F.col("confidence")
    colour = F.when(c >= 0.9, colours[0]).when(c >= 0.5, colours[1]).otherwise(colours[2])
    return resolved.where("target IS NOT NULL").select(F.concat(_quoted(F.col("caller")), F.lit(" -> "), _quoted(F.col("target")), F.lit(" [color="), colour, F.lit("];")).alias("line")).distinct()


#: Fills of callers and of what is only called, and colours of edges by confidence (fixed values).
CALLER_FILL, CALLEE_FILL = "#e1f5fe", "#fff3e0"
EDGE_COLOURS = ('"#4caf50"', '"#ff9800"', '"#f44336"')


def call_graph_dot(resolved: DataFrame) -> DataFrame:
    """The call graph as a document: callers, targets that call nothing, edges."""
    node = lambda df, fill: df.select(F.concat(_quoted(F.col("node")), F.lit(f' [style=filled, fillcolor="{fill}"];')).alias("line"))
    callers = resolved.where("caller IS NOT NULL").select(F.col("caller").alias("node")).distinct()
    return document("digraph CallGraph { rankdir=LR; node [shape=box];", [node(callers, CALLER_FILL), node(callee_only(resolved), CALLEE_FILL), dot_lines(resolved, EDGE_COLOURS)], "}")


def boundary_dot(dependencies: DataFrame) -> DataFrame:
    """Calls between projects as a document, from (caller_project, callee_project, n_calls)."""
    a, b = (_quoted(short_project(F.col(c))) for c in ("caller_project", "callee_project"))
    nodes = dependencies.select(F.explode(F.array(a, b)).alias("x")).distinct().select(F.concat("x", F.lit(";")).alias("line"))
    edges = dependencies.select(F.concat(a, F.lit(" -> "), b, F.lit(' [label="'), F.col("n_calls").cast("string"), F.lit(' calls"];')).alias("line"))
    return document("digraph ProjectDependencies { rankdir=LR; node [shape=box];", [nodes, edges], "}")


def boundary_json(dependencies: DataFrame, surface: DataFrame) -> DataFrame:
    """(section, json): an object for every pair of projects with calls, and one for every method called from elsewhere."""
    pairs = dependencies.select(F.lit("dependencies").alias("section"), F.to_json(F.struct(F.col("caller_project").alias("from"), F.col("callee_project").alias("to"), F.col("n_calls").alias("call_count"))).alias("json"))
    names = F.substring_index("target", "::", 1).alias("class"), F.substring_index("target", "::", -1).alias("method")
    used = F.transform(F.split("callers", ","), short_project).alias("used_by")
    return pairs.unionByName(surface.select(F.lit("api_surface").alias("section"), F.to_json(F.struct(F.col("target").alias("fqn"), *names, used)).alias("json")))


def dead_text(dead: DataFrame) -> DataFrame:
    """(fqn, line): two lines of text for every dead symbol of (fqn, kind, file_path, line)."""
    place = F.concat(F.lit("    at "), F.coalesce("file_path", F.lit("?")), F.lit(":"), F.col("line").cast("string"))
    return dead.select("fqn", F.concat(F.lit("  [DEAD] "), "fqn", F.lit(" ("), "kind", F.lit(")\n"), place).alias("line"))


def dead_json(dead: DataFrame) -> DataFrame:
    """(json): one object for every dead symbol."""
    return dead.select(F.to_json(F.struct("fqn", "kind", F.col("file_path").alias("file"), "line")).alias("json"))


def dead_violations(dead: DataFrame) -> DataFrame:
    """Dead symbols as warnings for sarif_results and checkstyle, ordered by name."""
    return dead.select(F.lit("dead-code").alias("rule"), F.lit("warning").alias("severity"), F.concat(F.lit("Dead "), "kind", F.lit(": "), "fqn").alias("message"), "file_path", "line", F.col("fqn").alias("ord"))


def call_graph_text(resolved: DataFrame) -> DataFrame:
    """(caller, line): what each caller calls, with the confidence in percent or a question mark."""
    mark = F.when(F.col("target").isNull(), "[?]").otherwise(F.concat(F.lit("["), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%]")))
    return resolved.select("caller", F.concat(F.lit("  "), F.coalesce("target", "callee_name"), F.lit(" "), mark).alias("line")).orderBy("caller", "line")


def call_graph_json(resolved: DataFrame) -> DataFrame:
    """(json): one object for every call."""
    return resolved.select(F.to_json(F.struct("caller", F.col("callee_name").alias("callee"), F.col("target").alias("resolved_target"), F.round("confidence", 2).alias("confidence"), "line")).alias("json"))


def sarif_results(violations: DataFrame, *kept: str) -> DataFrame:
    """(json) of violations(rule, severity, message, file_path, line), and columns that are kept."""
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("severity")), F.lit("note"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return violations.select(*kept, F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("json"))


def sarif_rules(violations: DataFrame) -> DataFrame:
    return violations.select("rule").distinct().select(F.to_json(F.struct(F.col("rule").alias("id"))).alias("json"))


def checkstyle(violations: DataFrame) -> DataFrame:
    """(file_path, first, xml): one element a file, files in the order in which they were first seen (column ord)."""
    text = lambda c: F.col(c).cast("string")
    error = F.concat(F.lit('<error line="'), text("line"), F.lit('" severity="'), text("severity"), F.lit('" message="'), text("message"), F.lit('" source="'), text("rule"), F.lit('"/>'))
    rows = violations.groupBy("file_path").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", error.alias("x")))).alias("errors"))
    return rows.select("file_path", "first", F.concat(F.lit('<file name="'), "file_path", F.lit('">'), F.array_join(F.col("errors.x"), ""), F.lit("</file>")).alias("xml")).orderBy("first")


def symbol_dump(facts) -> DataFrame:
    """(fqn, json): classes with their methods in name order."""
    methods = facts.methods.groupBy(F.col("owner").alias("fqn")).agg(F.array_sort(F.collect_list(F.struct("name", "visibility", "is_static", "return_type"))).alias("methods"))
    return facts.classes.join(methods, "fqn", "left").select("fqn", F.to_json(F.struct(F.col("fqn").alias("fqcn"), "is_abstract", "is_final", "extends", "methods")).alias("json")).orderBy("fqn")
