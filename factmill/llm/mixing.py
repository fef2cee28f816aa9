"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target
over source size. The whole part is taken at once; the fractional parts are
copy probabilities that a pivotal walk rounds: two documents of one source
meet, word mass moves at random from one to the other until one of them is
integral, and the other goes on. The mass of the pair, and so of the source,
never changes, and each document's expectation stays its probability.

Documents are dealt to blocks by a hash of their id, so a source that holds a
third of all rows is spread like the others. Each block leaves one residual a
source; blocks of residuals meet again in a reduction tree until one residual a
source is left, which is rounded by itself. Long documents meet first, so that residual is
mostly a short one; a source misses its target by less than its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, doc_rows, free, materialize, partitions

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MAX_COPIES = 3
#: Documents that meet in one block; blocks that meet in one block of the next level.
BLOCK, FAN_IN = 4096, 64
SEED = 17


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Shares of the whole go by weight; a share above most times its source stops
    there and the excess goes to the others by weight. The fixed point is
    min(level * weight, cap): sources fill up in the order of cap / weight, and
    the level is found from running sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last()))
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    order = everyone.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("left") / F.col("open") < F.col("fill"), F.col("left") / F.col("open"))).over(everyone))
    )
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _unit(seed: int, *key: object) -> float:
    return xxhash.xxh3_64_intdigest(repr(key), seed) / 2.0**64


ROW = "doc_id long, source string, size long, source_size long, target double, copies long, share double, block long, done boolean"


def pivot(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """Walk through each (block, source); all rows come out, done but for one residual in each.

    At the last level the residual is rounded by its own probability.
    """
    n = partitions(rows.sparkSession)
    names = [c.split(" ")[0] for c in ROW.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the residual's row; at 5 its copies, at 6 its share

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def end() -> list:
            if last:
                held[5] += int(_unit(seed, "end", held[0], held[2]) < held[6])
                held[6], held[8] = 0.0, True
            return held

        for batch in batches:
            types, done = [f.type for f in batch.schema], []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if held is not None and (held[7], held[1]) != (row[7], row[1]):
                    done.append(end())
                    held = None
                if held is None:
                    held = row
                    continue
                # The pair's mass stays: what one gains in words the other loses.
                (p, a), (q, b) = (held[6], held[2]), (row[6], row[2])
                up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
                if _unit(seed, level, held[0], row[0], held[2], row[2]) * (up + down) < down:
                    p, q = (1.0, q - (1 - p) * a / b) if 1 - p <= q * b / a else (p + q * b / a, 0.0)
                else:
                    p, q = (0.0, q + p * a / b) if p <= (1 - q) * b / a else (p - (1 - q) * b / a, 1.0)
                held[6], row[6] = p, q
                keep = None
                for x in (held, row):
                    if x[6] <= 1e-12 or x[6] >= 1 - 1e-12:
                        x[5] += x[6] > 0.5
                        x[6], x[8] = 0.0, True
                        done.append(x)
                    else:
                        keep = x
                held = keep
            if done:
                yield out(done)
        if held is not None:
            yield out([end()])

    dealt = rows.repartition(n, "block").sortWithinPartitions("block", "source", F.desc("size"), "doc_id", "share")
    return dealt.mapInArrow(walk, ROW)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for documents(doc_id, text, source).

    copies is how often the mix takes the document, taken the words this adds.
    A null text has no words; a null source is a source of its own, the last; a
    null doc_id is dealt like any other. Documents without words are taken at
    the whole part of their expectation and add nothing. Repeated rows are
    rounded one by one. The same table gives the same result in any layout.
    """
    rows = materialize(doc_rows(docs, "doc_id", "text", "source").select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(rows, weights, most), "targets")
    found = targets.count()
    if found <= 100_000:  # a few MB; beyond that Spark joins by shuffle and splits skewed sources
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    blocks = max(1, -(-rows.count() // block))
    whole = F.floor(rate + F.lit(1e-12))
    share = F.greatest(rate - whole, F.lit(0.0))
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    rows = (
        rows.join(t, rows["source"].eqNullSafe(t["of"]))
        .select("doc_id", "source", "size", "source_size", "target", whole.cast("long").alias("copies"), share.alias("share"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)))
        .withColumn("done", (F.col("size") == 0) | (F.col("share") <= 1e-12))
    )
    out = [rows.where("done")]
    rows, level = rows.where("NOT done"), 0
    while True:
        last = blocks == 1
        rows = materialize(pivot(rows, level, last, seed), f"pivot{level}")
        out.append(rows.where("done"))
        if last:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        rows = rows.where("NOT done").withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)).cast("long"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say, with the columns of docs, whatever their names.

    Rows that share id, source and size are told apart by their rank: by text,
    then by all columns, so rows that differ anywhere have one order in any layout.
    """
    id_, source_, size_, copies_, rank_, words_, nth_, copy_ = free(docs, "id", "source", "size", "copies", "rank", "words", "nth", "copy")
    counts = mixed.select(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_), F.col("copies").alias(copies_))
    counts = counts.withColumn(rank_, F.row_number().over(Window.partitionBy(id_, source_, size_).orderBy(F.desc(copies_))))
    rows = docs.withColumn(words_, words(F.col("text")))
    rows = rows.withColumn(nth_, F.row_number().over(Window.partitionBy("doc_id", "source", words_).orderBy(F.xxhash64("text"), *(F.col(f"`{c}`") for c in sorted(docs.columns)))))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.col(words_) == F.col(size_)) & (F.col(nth_) == F.col(rank_))
    joined = rows.join(counts, same).where(F.col(copies_) > 0)
    return joined.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
