"""Helpers that the training-data operators share: scratch tables, words, Arrow batches, components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import delete, scratch_folder

#: ASCII white space separates words; the same set that bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task, so that numpy scratch space stays small.
SLICE_BYTES = 4 << 20

# ---------------------------------------------------------------- scratch tables


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, one folder for each value of by, and read it back.

    This cuts the lineage: a lost executor costs a re-read of a file and not a
    recomputation of everything before it. operators.fixpoint.release() removes the files.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def materialize_buckets(df: DataFrame, name: str, by: str, *folders: str) -> DataFrame:
    """The same in buckets, as many as shuffles have partitions: a join by that column doesn't shuffle it. discard() forgets the table's name."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/{unique}"
    return _to_buckets(df, unique.replace("-", "_"), path, by, df.write.option("path", path).partitionBy(*folders))


def add_buckets(table: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """What materialize_buckets() wrote, and the rows of df."""
    return _to_buckets(df, table.scratch_table, table.scratch_path, by, df.write.mode("append"))


def _to_buckets(df: DataFrame, table: str, path: str, by: str, writer: DataFrameWriter) -> DataFrame:
    spark = df.sparkSession
    writer.format("parquet").option("compression", "zstd").bucketBy(partitions(spark), by).saveAsTable(table)
    out = spark.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


def discard_part(table: DataFrame, **folder: int) -> None:
    """Delete one folder of a table that was written in folders; only others may be read from then on."""
    for name, value in folder.items():
        delete(table.sparkSession, f"{table.scratch_path}/{name}={value}")


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() or materialize_buckets() wrote and that nothing reads any more."""
    for df in tables:
        if table := getattr(df, "scratch_table", None):
            df.sparkSession.sql(f"DROP TABLE {table}")
        delete(df.sparkSession, df.scratch_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_rows(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can't clash with an operator's own."""
    return docs.select(*(F.col(c) for c in cols))


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_bytes() -> Column:
    """UTF-8 bytes of the text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def held_out(doc_id: Column) -> Column:
    """The fold that no operator learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(_lengths(batch.column(text)).astype(np.int64))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words in each text."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum())), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): equal inputs, equal outputs; otherwise well spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of q consecutive values (len(h) - q + 1 of them), by doubling."""
    if len(h) < q:
        return np.zeros(0, dtype=np.uint64)
    done, width, out, power, base = 0, 1, None, h.copy(), BASE
    todo = q
    while True:  # binary decomposition: power holds runs of length width
        if todo & 1:
            n = len(h) - (done + width) + 1
            out = power[:n].copy() if out is None else out[:n] * _pow(width) + power[done : done + n]
            done += width
        todo >>= 1
        if not todo:
            return mix(out)
        power = power[:-width] * _pow(width) + power[width:]
        width *= 2


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in edges(a, b): component is the smallest node of its connected component.

    Hook-and-contract: every node hooks to the smallest of its neighbours and
    itself, chains are shortened by pointer jumping, edges are rewritten to the
    roots and the survivors are contracted again. Only grouped minima (combined
    map-side) and joins are used, so a node with many links costs no more than
    its links; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), name)
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = materialize(hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), name)
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        ra, rb = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(ra, "a").join(rb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()
        edges = materialize(edges, name)
        if label is None:
            label = hook.select("node", F.col("root").alias("component"))
        else:
            label = label.join(hook.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        label = materialize(label, name)
    return label if label is not None else spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("component")).schema)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark's cleaner deletes the shuffle files of finished steps.

    Spark does this every half hour by itself (spark.cleaner.periodicGC.interval);
    between the steps of one operator that is too rare for its disk.
    """
    gc.collect()  # Python's handles keep the driver's objects alive
    time.sleep(1.1)  # and are let go by a thread that looks for them once a second
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()  # the last job's shuffles outlive one collection
    time.sleep(0.5)  # the cleaner works in a thread of its own
