"""Reachability by semi-naive iteration, and closures by doubling.

Every round joins only the newest rows and drops what is known, so each pair is
derived once. Rounds are cut by writing their rows to the shared folder of
spark.checkpoint.dir; a round's files are kept until the end and read together.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Roots of local sessions that name no folder, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Only a local session may do without, in a folder of its machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _LOCAL.get(sc.applicationId)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="factmill-"))
    return f"{root.rstrip('/')}/factmill-{sc.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """Where intermediate tables of running operators go; release() deletes it."""
    return f"{shared_folder(spark)}/scratch"


def hadoop(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it once what was computed with them is written."""
    delete(spark, scratch_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage replaced by files that all executors share."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """df for the side of a join where a set grows with the input: it meets the other by key among the executors, and never goes through the driver for a broadcast."""
    return df.hint("merge")


def reach(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000, known: DataFrame | None = None) -> DataFrame:
    """(node) reachable from seeds(node) over edges(src, dst), seeds included; nodes of known(node) are neither returned nor walked."""
    return _closed(edges, seeds if known is None else seeds.join(grown(known), "node", "left_anti"), ["node"], rounds, known)


def reach_pairs(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(origin, node): reach() from each row of seeds(origin, node), kept apart by origin."""
    return _closed(edges, seeds, ["origin", "node"], rounds)


def _closed(edges: DataFrame, seeds: DataFrame, columns: list[str], rounds: int, known: DataFrame | None = None) -> DataFrame:
    """Raises if the frontier isn't empty after so many rounds: a partial closure is never returned."""
    frontier = cut(seeds.select(*columns).distinct())
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    parts = [frontier]
    for _ in range(rounds):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(*columns[:-1], F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts if known is None else [*parts, known.select(*columns)])
        frontier = cut(new.join(grown(seen), columns, "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
        if len(parts) > 32:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    raise RuntimeError(f"not closed after {rounds} rounds")


def nearest(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """seeds(node, depth, *payload) and what they reach over edges(src, dst, *rank), each node at its least depth.

    A node's payload is its predecessor's; via is the least struct (src, *rank)
    among edges from nodes one step nearer, null for seeds. Seeds may have
    different depths. One set for all seeds: rows grow with nodes, not with paths.
    """
    rank = [c for c in edges.columns if c != "dst"]
    payload = [c for c in seeds.columns if c not in ("node", "depth")]
    edges = cut(edges.where("src <> dst"))
    kind = edges.select(F.struct(*rank).alias("via")).schema["via"].dataType
    waiting = cut(seeds.withColumn("via", F.lit(None).cast(kind)))
    starts = sorted(r[0] for r in waiting.select("depth").distinct().collect())  # as many as there are depths, not nodes
    depth = starts[0] if starts else None
    done: list[DataFrame] = []
    frontier = None
    for _ in range(rounds):
        if depth is None:
            break
        new = waiting.where(F.col("depth") == depth)
        if frontier is not None:
            step = frontier.select(F.col("node").alias("src"), *payload).join(edges, "src").select(F.col("dst").alias("node"), F.lit(depth).cast(seeds.schema["depth"].dataType).alias("depth"), *payload, F.struct(*rank).alias("via"))
            new = new.unionByName(step)
        first = new.groupBy("node").agg(F.min(F.struct("depth", F.col("via").isNotNull().alias("stepped"), "via", *payload)).alias("x"))
        new = first.select("node", "x.depth", *(F.col(f"x.{c}").alias(c) for c in payload), "x.via")
        for known in done:
            new = new.join(known.select("node"), "node", "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            depth, frontier = next((d for d in starts if d > depth), None), None
            continue
        done.append(frontier)
        if len(done) > 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
        depth += 1
    else:
        raise RuntimeError(f"not closed after {rounds} rounds")
    return reduce(DataFrame.unionByName, done) if done else waiting.where("false")


def nearest_by(sites: DataFrame, means: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """nearest() over the edges that sites(src, key, *rank) and means(key, dst) stand for: from each src of a key to each of its dst.

    The edges are never made. A round brings a key its least predecessor, then
    every dst of the key that one; a key is passed once, since all it means is known
    afterwards. So rows grow with both tables, not with the product of a key's.
    """
    rank = [c for c in sites.columns if c != "key"]
    payload = [c for c in seeds.columns if c not in ("node", "depth")]
    sites = cut(sites.join(means.select("key").distinct(), "key", "left_semi"))
    means = cut(means.select("key", F.col("dst").alias("node")).distinct())
    via = F.struct(*rank).alias("via")
    waiting = cut(seeds.withColumn("via", F.lit(None).cast(sites.select(via).schema["via"].dataType)))
    starts = sorted(r[0] for r in waiting.select("depth").distinct().collect())  # as many as there are depths, not nodes
    depth = starts[0] if starts else None
    done: list[DataFrame] = []
    passed: list[DataFrame] = []
    frontier = None
    for _ in range(rounds):
        if depth is None:
            break
        new = waiting.where(F.col("depth") == depth)
        if frontier is not None:
            met = frontier.select(F.col("node").alias("src"), *payload).join(sites, "src").groupBy("key").agg(F.min(F.struct(via, *payload)).alias("x"))
            for known in passed:
                met = met.join(known.select("key"), "key", "left_anti")
            met = cut(met)
            passed.append(met)
            if len(passed) > 16:
                passed = [cut(reduce(DataFrame.unionByName, [k.select("key") for k in passed]))]
            new = new.unionByName(met.join(means, "key").select("node", F.lit(depth).cast(seeds.schema["depth"].dataType).alias("depth"), *(F.col(f"x.{c}").alias(c) for c in payload), "x.via"))
        first = new.groupBy("node").agg(F.min(F.struct("depth", F.col("via").isNotNull().alias("stepped"), "via", *payload)).alias("x"))
        new = first.select("node", "x.depth", *(F.col(f"x.{c}").alias(c) for c in payload), "x.via")
        for known in done:
            new = new.join(known.select("node"), "node", "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            depth, frontier = next((d for d in starts if d > depth), None), None
            continue
        done.append(frontier)
        if len(done) > 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
        depth += 1
    else:
        raise RuntimeError(f"not closed after {rounds} rounds")
    return reduce(DataFrame.unionByName, done) if done else waiting.where("false")


def chains(parents: DataFrame) -> DataFrame:
    """(node, ancestor, dist) from parents(node, parent), one parent a node; a chain stops where it would repeat a node.

    Distances double in every round, so a chain of depth d takes log2(d) rounds.
    """
    known = cut(parents.where("parent IS NOT NULL AND node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")))
    reached = 1
    while True:
        a = known.where(F.col("dist") == reached).select("node", F.col("ancestor").alias("via"), F.col("dist").alias("d"))
        b = known.select(F.col("node").alias("via"), "ancestor", "dist")
        new = a.join(grown(b), "via").where("node <> ancestor").groupBy("node", "ancestor").agg(F.min(F.col("d") + F.col("dist")).alias("dist"))
        new = cut(new.join(grown(known), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
        reached *= 2


def simple_paths(edges: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """(graph, path) of all paths without a repeated node, from starts(graph, node) to nodes without successors, over edges(graph, src, dst)."""
    edges = cut(edges.select("graph", "src", "dst").distinct())
    last = F.element_at("path", -1)
    open_ = starts.select("graph", F.array("node").alias("path"))
    done = None
    for _ in range(most):
        step = open_.withColumn("src", last).join(edges, ["graph", "src"], "left")
        ends = step.where("dst IS NULL").select("graph", "path")
        done = cut(ends if done is None else done.unionByName(ends))
        open_ = cut(step.where("dst IS NOT NULL AND NOT array_contains(path, dst)").select("graph", F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"paths are open after {most} steps")
