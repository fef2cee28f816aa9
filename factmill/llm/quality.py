"""Quality rules with risk-controlled thresholds.

Each rule is a ratio that is high for bad documents. Labelled rows that call a
document good are dealt to two parts by the hash of their id. The first part
fixes, for each stratum, a path of settings: every rule is measured in units of
the largest value that these good documents reach, and step k rejects what
exceeds FIRST * SHRINK**k units by any rule. The second part is the holdout. It
walks down the path, from lenient to strict, while the exact (Clopper-Pearson)
upper bound of the share of good documents that a step rejects, by all rules
together, stays within RISK. As the path doesn't depend on the holdout and the
walk stops at the first step that fails, the steps need no correction (fixed
sequence); strata are corrected by Bonferroni. With confidence 1 - DELTA, no
stratum then loses more than RISK of its good documents. About 100 good
documents in the holdout suffice for a first step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, materialize, mix, rolling, slices, word_hashes

#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: Share of good documents that a stratum may lose to the cutoffs, and the chance that it loses more.
RISK, DELTA = 0.05, 0.05
#: Settings from lenient to strict, in units of the largest value among good documents of the first part.
FIRST, SHRINK, STEPS = 8.0, 0.93, 96
GRID = tuple(FIRST * SHRINK**k for k in range(STEPS))
#: Units are no smaller than this: a rule that no good document of the first part touches still has one.
LEAST_UNIT = 0.001
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
_SPACE, _SYMBOLS, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """For each text, its words in windows of width words that occur twice or more in it."""
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    windows = rolling(h, width)
    if not len(windows):
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[: len(windows)] == text[width - 1 :]
    at = np.flatnonzero(inside)
    key = mix(windows[at] + mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[ends] - covered[ends - counts]


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every whole text: doc_id, stratum (lang) and COUNTS. A null text counts as empty."""

    def less(text: bytes, drop: bytes) -> int:
        return len(text) - len(text.translate(None, drop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            strings = batch.column("text").to_pylist()
            texts = [s.encode() for s in strings]
            h, n = word_hashes(texts)
            cols: dict[str, list | np.ndarray] = {c: [] for c in COUNTS} | {"n_words": n, "n_repeat_words": repeated(h, n, WINDOW)}
            for s, t in zip(strings, texts, strict=True):
                lines = [x for x in t.split(b"\n") if x.strip()]
                cols["word_chars"].append(len(s) - less(t, _SPACE))
                cols["n_dup_lines"].append(len(lines) - len(set(lines)))
                cols["n_lines"].append(len(lines))
                for c, drop in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_marks", _MARKS), ("n_digits", _DIGITS)):
                    cols[c].append(less(t, drop))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *(pa.array(cols[c], pa.int64()) for c in COUNTS)], names=["doc_id", "stratum", *COUNTS])

    rows = doc_rows(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("stratum"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


@lru_cache(maxsize=64)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which k or fewer of n have probability delta."""
    if k >= n:
        return 1.0
    fact = _log_factorials(n)
    i = np.arange(k + 1)
    logs = fact[n] - fact[i] - fact[n - i]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = np.exp(logs + i * math.log(max(p, 1e-300)) + (n - i) * math.log1p(-min(p, 1 - 1e-16))).sum()
        low, high = (p, high) if tail > delta else (low, p)
    return high


@lru_cache(maxsize=4096)
def most_rejected(n: int, delta: float, risk: float) -> int:
    """The largest count of rejected among n whose bound stays within risk; -1 if not even none does."""
    low, high = -1, n
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if upper_bound(k, n, delta) <= risk else (low, k)
    return low


def walk(rejecting: np.ndarray, n: int, delta: float, risk: float) -> float | None:
    """The strictest setting reached: rejecting[k] of n good documents are rejected from step k on."""
    allowed = np.flatnonzero(np.minimum.accumulate(np.cumsum(rejecting) <= most_rejected(n, delta, risk)))
    return GRID[allowed[-1]] if len(allowed) else None


def _unit(rule: str) -> str:
    return f"unit_{rule}"


def excess() -> Column:
    """The largest of the rules, in units."""
    return F.greatest(*(F.expr(RULES[r]) / F.col(_unit(r)) for r in RULES))


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cut, a unit for each rule): what is learned from measured rows that labels(doc_id, quality) calls good and the base rules keep.

    Strata whose holdout doesn't allow the first step are left out. Null labels
    and null ids are left out; if a doc_id is labelled twice, the higher label
    counts. One row a stratum, made where its rows are: nothing is collected.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    rows = materialize(rows.withColumn("holdout", F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string")).cast("binary")) % 3 > 0), "quality-good")
    strata = rows.select("stratum").distinct().count()
    units = rows.where("NOT holdout").groupBy("stratum").agg(*(F.greatest(F.max(F.expr(RULES[r])), F.lit(LEAST_UNIT)).alias(_unit(r)) for r in RULES))
    grid = F.array(*map(F.lit, GRID))
    held = rows.where("holdout").alias("h").join(units.alias("u"), F.col("h.stratum").eqNullSafe(F.col("u.stratum"))).drop(F.col("u.stratum"))
    # The grid falls, so what a document exceeds are its last settings: their number tells the first.
    step = STEPS - F.size(F.filter(grid, lambda c: excess() > c))
    counts = held.groupBy("stratum", *map(_unit, RULES), step.alias("step")).count()
    counts = counts.groupBy("stratum", *map(_unit, RULES)).agg(F.collect_list(F.struct("step", "count")).alias("steps"))  # at most STEPS + 1 of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for steps in batch.column("steps").to_pylist():
                at = np.zeros(STEPS + 1, dtype=np.int64)
                for x in steps:
                    at[x["step"]] += x["count"]
                cuts.append(walk(at[:STEPS], int(at.sum()), delta / max(strata, 1), risk))
            yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array(cuts, pa.float64()), *(batch.column(_unit(r)) for r in RULES)], names=["stratum", "cut", *map(_unit, RULES)])

    return counts.mapInArrow(run, "stratum string, cut double, " + ", ".join(f"{_unit(r)} double" for r in RULES)).where("cut IS NOT NULL")


def rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """COUNTS, base_failed, failed_rule and kept for every row of documents(doc_id, text, lang).

    A stratum is a lang, null one of its own; strata without enough labelled
    rows have no cutoffs, so only the base rules apply there. Repeated rows are
    judged one by one.
    """
    measured = materialize(measure(docs), "quality")
    learned = materialize(calibrate(measured, labels, risk, delta), "quality-cutoffs")
    judged = measured.alias("m").join(learned.alias("l"), F.col("m.stratum").eqNullSafe(F.col("l.stratum")), "left").drop(F.col("l.stratum"))
    failed = F.coalesce(*(F.when((excess() > F.col("cut")) & (F.expr(RULES[r]) / F.col(_unit(r)) == excess()), F.lit(r)) for r in RULES))
    return judged.select("doc_id", *COUNTS, base_failed().alias("base_failed"), failed.alias("failed_rule")).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
