"""Whole documents as ordered rows of lines, and their writer.

A document is a list of parts: text, rows that Spark holds, one after the other.
Rows have a key that orders them within their part. Separators depend on which
row is the first of its part alone, so nothing is collected, and no window runs
over a part; writing sorts by ranges, and part files in order are the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import confidence_shares, type_checks
from .sinks import LEVELS, sarif_results

TOOL = "factmill"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


@dataclass(frozen=True)
class Rows:
    """Lines of rows(key, line), each but the first after a separator; rows that are equal come as often as they are there."""

    rows: DataFrame
    separator: str = ""


def assemble(spark: SparkSession, parts: list[str | Rows]) -> DataFrame:
    """(section, key, line): the document's lines in the order of section, key and line."""
    texts = spark.createDataFrame([(i, "", p) for i, p in enumerate(parts) if isinstance(p, str)], "section int, key string, line string")
    out = [texts]
    for i, p in enumerate(parts):
        if isinstance(p, Rows):
            rows = p.rows.select(F.coalesce("key", F.lit("")).alias("key"), "line")
            if p.separator:
                rows = rows.groupBy("key", "line").agg(F.count(F.lit(1)).alias("n"))
                first = rows.agg(F.min(F.struct("key", "line")).alias("first"))  # one row
                again = F.array_join(F.array_repeat("line", F.col("n").cast("int")), p.separator + "\n")
                rows = rows.crossJoin(F.broadcast(first)).select("key", F.concat(F.when(F.struct("key", "line") == F.col("first"), "").otherwise(p.separator), again).alias("line"))
            out.append(rows.select(F.lit(i).alias("section"), "key", "line"))
    return reduce(DataFrame.unionByName, out)


def write(document: DataFrame, path: str) -> None:
    """The document as text: its part files, one after the other by name, are the whole."""
    document.orderBy("section", "key", "line").select("line").write.text(path)


def place(*columns: str) -> Column:
    """A key that orders by these columns: text as it is, numbers by their size."""
    part = lambda c: F.coalesce(F.lpad(F.col(c).cast("string"), 12, "0") if c in ("line", "after_line") else F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("\x1f", *map(part, columns))


@dataclass(frozen=True)
class Report:
    """What a report tells. coverage: one row of counts. resolved: calls. dead: dead_counts() rows. top: rows of (fqn, kind, file_path, line), bounded. violations: (rule, severity, message, file_path, line)."""

    coverage: DataFrame
    resolved: DataFrame
    dead: DataFrame
    top: DataFrame
    violations: DataFrame


def _one(df: DataFrame, name: str, last: bool = False) -> Rows:
    """A member of an object from the only row of df."""
    return Rows(df.select(F.lit("").alias("key"), F.concat(F.lit(f'"{name}": '), F.to_json(F.struct(*df.columns)), F.lit("" if last else ",")).alias("line")))


#: Kinds of dead symbols and the members that count them (fixed values).
DEAD = {"class": "dead_classes", "interface": "dead_interfaces", "trait": "dead_traits", "function": "dead_functions", "private_method": "dead_private_methods", "other_method": "dead_other_methods", "property": "dead_properties"}


def _dead(report: Report) -> DataFrame:
    counts = report.dead.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(name) for k, name in DEAD.items()))
    top = report.top.agg(F.array_sort(F.collect_list(F.struct("fqn", "kind", F.col("file_path").alias("file"), "line"))).alias("top_dead_candidates"))  # bounded
    return counts.crossJoin(top)


def report_json(report: Report) -> DataFrame:
    """One JSON object: coverage, type checks, dead code, confidence, violations by file and line."""
    v = report.violations
    items = v.select(place("file_path", "line", "rule").alias("key"), F.to_json(F.struct("severity", F.col("file_path").alias("file"), "line", "message")).alias("line"))
    parts = ["{", _one(report.coverage, "coverage"), _one(type_checks(report.resolved), "type_checks"), _one(_dead(report), "dead_code"), _one(confidence_shares(report.resolved), "confidence"), '"violations": [', Rows(items, ","), "]", "}"]
    return assemble(v.sparkSession, parts)


def report_sarif(violations: DataFrame) -> DataFrame:
    """One SARIF log of violations(rule, severity, message, file_path, line): a run with its rules and results."""
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("severity")), F.lit("note"))
    rules = violations.groupBy("rule").agg(F.min(level).alias("level"))
    rules = rules.select(F.col("rule").alias("key"), F.to_json(F.struct(F.col("rule").alias("id"), F.struct(F.col("level")).alias("defaultConfiguration"))).alias("line"))
    keyed = violations.withColumn("key", place("file_path", "line", "rule"))
    results = sarif_results(keyed, "key").withColumnRenamed("json", "line")
    head = f'{{"$schema": "{SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "{TOOL}", "rules": ['
    return assemble(violations.sparkSession, [head, Rows(rules, ","), ']}}, "results": [', Rows(results, ","), "]}]}"])


def xml(c: Column) -> Column:
    """Text for an attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def report_checkstyle(violations: DataFrame) -> DataFrame:
    """One Checkstyle document; a file's element opens, holds and closes by the order of keys, without a group of its rows."""
    file = F.coalesce("file_path", F.lit(""))
    text = lambda c: xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    files = violations.select(file.alias("f")).distinct()
    mark = lambda nth: F.concat("f", F.lit("\x1f" + nth))
    opened = files.select(mark("0").alias("key"), F.concat(F.lit('<file name="'), xml(F.col("f")), F.lit('">')).alias("line"))
    closed = files.select(mark("2").alias("key"), F.lit("</file>").alias("line"))
    error = F.concat(F.lit('<error line="'), text("line"), F.lit('" severity="'), text("severity"), F.lit('" message="'), text("message"), F.lit('" source="'), text("rule"), F.lit('"/>'))
    errors = violations.select(F.concat(file, F.lit("\x1f1"), place("line", "rule")).alias("key"), error.alias("line"))
    return assemble(violations.sparkSession, ['<?xml version="1.0" encoding="UTF-8"?>', '<checkstyle version="8.0">', Rows(opened.unionByName(errors).unionByName(closed)), "</checkstyle>"])


def called_before_json(found, before: str, after: str) -> DataFrame:
    """One JSON object of what called_before.analyse() found for "before must be called before after"."""
    spark = found.violations.sparkSession
    q = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    object_ = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("line")
    bad = found.violations.select(place("context_function", "after_line").alias("key"), object_("context_function", F.col("file_path").alias("file"), "after_line", "before_line", "kind"))
    good = found.matches.select(place("context_function", "after_line").alias("key"), object_("context_function", F.col("file_path").alias("file"), "after_line", "after_callee", "before_line", "before_callee"))
    counts = found.violations.agg(F.count(F.lit(1)).alias("violations")).crossJoin(found.matches.agg(F.count(F.lit(1)).alias("matches"))).crossJoin(found.satisfied_in.agg(F.count(F.lit(1)).alias("satisfied_functions")))
    satisfied = found.violations.agg((F.count(F.lit(1)) == 0).alias("x")).select(F.lit("").alias("key"), F.concat(F.lit('"satisfied": '), F.col("x").cast("string"), F.lit(",")).alias("line"))
    return assemble(spark, ["{", f'"constraint": {{"before": "{q(before)}", "after": "{q(after)}"}},', Rows(satisfied), '"violations": [', Rows(bad, ","), "],", '"matches": [', Rows(good, ","), "],", _one(counts, "summary", last=True), "}"])


def called_before_text(found, before: str, after: str) -> DataFrame:
    """The same to be read: violations with the callers that bring no A, then what is satisfied."""
    spark = found.violations.sparkSession
    text = lambda c: F.col(c).cast("string")
    v = found.violations
    issue = F.when(F.col("kind") == "wrong_order", F.concat(F.lit("called on line "), text("after_line"), F.lit(", first before call on line "), text("before_line"))).otherwise("never called before")
    rows = v.select(F.concat(place("context_function"), F.lit("\x1f0"), place("after_line")).alias("key"), F.concat(F.lit("  "), "context_function", F.lit("\n      File: "), F.coalesce("file_path", F.lit("?")), F.lit(":"), text("after_line"), F.lit("\n      Issue: "), issue).alias("line"))
    paths = found.missing_paths.select(F.concat(place("context_function"), F.lit("\x1f1"), place("caller")).alias("key"), F.concat(F.lit("      Missing in: "), "caller", F.lit(" ("), F.coalesce("file_path", F.lit("?")), F.lit(":"), text("call_line"), F.lit(")")).alias("line"))
    result = v.agg(F.when(F.count(F.lit(1)) == 0, "SATISFIED").otherwise("VIOLATED").alias("x")).select(F.lit("").alias("key"), F.concat(F.lit("Result: "), "x").alias("line"))
    good = found.satisfied_in.select(F.col("context_function").alias("key"), F.concat(F.lit("  "), "context_function").alias("line"))
    return assemble(spark, [f"Constraint: {before} must be called before {after}", Rows(result), "Violations", Rows(rows.unionByName(paths)), "Satisfied in", Rows(good)])
