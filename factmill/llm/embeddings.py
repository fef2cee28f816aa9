"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors become one, with a weight.
2. Centroids are fitted on a bounded sample; each vector joins the shards of its
   OVERLAP nearest centroids. A shard above CAP is dealt to blocks by hash.
3. Each block builds a graph: from its nearest neighbours a vector keeps those
   that no kept one is much nearer to (robust pruning). Edges go both ways, and
   those of a maximum spanning tree join what the lists leave apart, such as a
   group of near copies that fills its members' lists. The lists that a vector
   got in its shards are united.
4. Every vector searches its shards' blocks: greedily with a beam from the
   medoid and from itself, then range-expanding, which goes on from every vector
   found within the range (and a slack below it) until nothing new turns up.
   The other blocks of an oversized shard, which have no node of the vector to
   start from, are compared with it exactly.
5. Links are verified in double precision. A pair with several common shards
   counts in the first, so links are summed without listing pairs; each task
   gives a spanning forest of what it found, and the forests are contracted.
6. Recall between different vectors is audited against brute force on bounded
   query samples, as the mean over queries with about equally many links, of
   which the smallest counts. Below RECALL everything is done again with more
   overlap, and below it at MOST_OVERLAP all vectors are compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, doc_rows, materialize, tidy

COSINE = 0.9
#: Vectors that the centroids are fitted on, at most about so many, and centroids, at most so many.
SAMPLE, MOST_CENTROIDS = 20_000, 4096
#: Vectors a shard should have, and may have before it is dealt to blocks.
SHARD, CAP = 1000, 2500
OVERLAP, MOST_OVERLAP = 3, 8
#: Neighbours considered and kept; pruning factor; beam; slack below the range.
NEAREST, DEGREE, ALPHA, BEAM, SLACK = 64, 24, 1.2, 12, 0.1
#: Audited queries (of each stratum) and the recall asked for.
QUERIES, RECALL = 400, 0.97
SEED = 9


def unit_rows(rows: DataFrame) -> DataFrame:
    """vec_id, dim, unit (doubles) and two hashes of every usable vector of rows(vec_id, embedding)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, dtype=np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                data = (x + 0.0).tobytes()
                x = x / top  # no overflow, no underflow
                out.append((i, len(x), x / np.sqrt(x @ x), xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh3_64_intdigest(data, 1) - (1 << 63)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int64()), strict=True)], names=["vec_id", "dim", "unit", "h", "h2"])

    return doc_rows(rows, "vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, unit array<double>, h long, h2 long")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def centroids(sample: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means with a few rounds."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(6):
        near = np.concatenate([(sample[a : a + 2000] @ c.T).argmax(1) for a in range(0, len(sample), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def build(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbour lists (rows of indices, -1 fills up) of the block's unit vectors."""
    n = len(x)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    if n < 2:
        return out
    m = min(NEAREST, n - 1)
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        d = 1 - np.take_along_axis(s, near, 1)
        order = np.argsort(d, axis=1)
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        y = x[near]
        between = 1 - np.einsum("qid,qjd->qij", y, y)
        alive = np.ones(near.shape, dtype=bool)
        kept = np.zeros(len(near), dtype=np.int64)
        for j in range(m):
            take = np.flatnonzero(alive[:, j] & (kept < DEGREE))
            out[a + take, kept[take]] = near[take, j]
            kept[take] += 1
            alive[take] &= ALPHA * between[take, j, :] > d[take]
    return out


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Each unit vector's parent in a maximum spanning tree of the cosines, -1 for the root (Prim's method)."""
    parent, best = np.full(len(x), -1, dtype=np.int64), np.full(len(x), -9.0)
    outside = np.ones(len(x), dtype=bool)
    last = 0
    for _ in range(len(x) - 1):
        outside[last] = False
        s = x @ x[last]
        nearer = outside & (s > best)
        best[nearer], parent[nearer] = s[nearer], last
        last = int(np.where(outside, best, -99.0).argmax())
    return parent


def both_ways(lists: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the lists and the tree in both directions: node i's are ends[starts[i] : starts[i + 1]]."""
    n = len(lists)
    i, j = np.nonzero(lists >= 0)
    child = np.flatnonzero(parent >= 0)
    a, b = np.concatenate([i, child]), np.concatenate([lists[i, j], parent[child]])
    a, b = np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), n)
    return np.searchsorted(a, np.arange(n + 1)), b


def search(q: np.ndarray, x: np.ndarray, lists: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs with cosine >= least that the graph search finds; q is x, so that query i starts from node i too."""
    found_q, found_x = [], []
    medoid = int((x @ x.mean(0)).argmax())
    starts, ends = both_ways(lists, spanning_tree(x))
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        n = len(part)
        sims = np.full((n, len(x)), -9.0)
        done = np.zeros((n, len(x)), dtype=bool)
        sims[:, medoid] = part @ x[medoid]
        sims[np.arange(n), np.arange(a, a + n)] = np.einsum("pd,pd->p", part, x[a : a + n])

        def visit(who: np.ndarray, nodes: np.ndarray, part=part, sims=sims, done=done) -> None:
            done[who, nodes] = True
            degree = starts[nodes + 1] - starts[nodes]
            edge = np.arange(degree.sum()) + np.repeat(starts[nodes] - (np.cumsum(degree) - degree), degree)
            flat = np.repeat(who * len(x), degree) + ends[edge]
            flat = np.unique(flat[sims.ravel()[flat] < -8])
            for b in range(0, len(flat), 50_000):
                i, j = np.divmod(flat[b : b + 50_000], len(x))
                sims[i, j] = np.einsum("pd,pd->p", part[i], x[j])

        who = np.arange(n)
        beam = min(BEAM, len(x))
        while len(who):  # the best of each beam that isn't expanded, until all of the beam is
            s = sims[who]
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            value = np.where(done[who[:, None], top] | (np.take_along_axis(s, top, 1) < -8), -99.0, np.take_along_axis(s, top, 1))
            best = value.argmax(1)
            go = value[np.arange(len(who)), best] > -8
            who, nodes = who[go], top[np.arange(len(top)), best][go]
            if len(who):
                visit(who, nodes)
        while True:
            i, j = np.nonzero((sims >= least - SLACK) & ~done)
            if not len(i):
                break
            for b in range(0, len(i), 20_000):
                visit(i[b : b + 20_000], j[b : b + 20_000])
        i, j = np.nonzero(sims >= least)
        found_q.append(i + a)
        found_x.append(j)
    return np.concatenate(found_q), np.concatenate(found_x)


def compare(q: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, vector) pairs with cosine >= least."""
    found = [np.nonzero(q[a : a + 256] @ x.T >= least) for a in range(0, len(q), 256)]
    return np.concatenate([i + 256 * k for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by links i-j."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


FOUND = "vec_id long, links long, pairs long, root long"
MEMBER = "shard int, block int, blocks int, vec_id long, weight long, unit array<double>, shards array<int>"


def assign(reps: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """A row for each of a vector's shards: its nearest centroids."""
    shared = reps.sparkSession.sparkContext.broadcast(c)
    o = min(overlap, len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                near = np.argpartition(-(matrix(part.column("unit")) @ shared.value.T), o - 1, axis=1)[:, :o].astype(np.int32)
                near.sort(axis=1)
                row = np.repeat(np.arange(len(near)), o)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(part.column(k).take(pa.array(row)) for k in ("vec_id", "weight", "unit")), pa.array(list(near[row]), pa.list_(pa.int32()))], names=["shard", "vec_id", "weight", "unit", "shards"])

    return reps.select("vec_id", "weight", "unit").mapInArrow(run, "shard int, vec_id long, weight long, unit array<double>, shards array<int>")


def _build_block(t: pa.Table) -> pa.Table:
    t = t.sort_by("vec_id")
    ids = t.column("vec_id").to_numpy()
    lists = build(matrix(t.column("unit")))
    return pa.table({"vec_id": t.column("vec_id"), "lists": pa.array([ids[r[r >= 0]] for r in lists], pa.list_(pa.int64()))})


def _search_blocks(t: pa.Table, least: float) -> pa.Table:
    """Links and forest roots from the search of one block in itself, or of two blocks in each other."""
    t = t.sort_by([("block", "ascending"), ("vec_id", "ascending")])
    ids, weight, block, shard = (t.column(c).to_numpy() for c in ("vec_id", "weight", "block", "shard"))
    x, shards = matrix(t.column("unit")), matrix(t.column("shards"))
    cut = int(np.searchsorted(block, block[0], "right"))
    if cut < len(ids):
        i, j = compare(x[:cut], x[cut:], least)
        j = j + cut
    else:
        place = {int(v): k for k, v in enumerate(ids)}
        inside = [[place[v] for v in row if v in place] for row in t.column("neighbours").to_pylist()]
        lists = np.full((len(ids), max(1, max(map(len, inside)))), -1, dtype=np.int64)
        for k, row in enumerate(inside):
            lists[k, : len(row)] = row
        i, j = search(x, x, lists, least)
    i, j = i[i != j], j[i != j]
    pair = np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j))  # found from either side
    i, j = np.divmod(pair, len(ids))
    common = np.where((shards[i][:, :, None] == shards[j][:, None, :]).any(2), shards[i], 1 << 30).min(1) if len(i) else i
    i, j = i[common == shard[0]], j[common == shard[0]]
    links = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
    pairs = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    return _found(ids, links, pairs, forest(len(ids), i, j))


def _found(ids: np.ndarray, links: np.ndarray, pairs: np.ndarray, root: np.ndarray) -> pa.Table:
    some = np.flatnonzero(pairs > 0)
    return pa.table({"vec_id": ids[some], "links": links[some].astype(np.int64), "pairs": pairs[some].astype(np.int64), "root": ids[root[some]]})


def _compare_blocks(t: pa.Table, least: float) -> pa.Table:
    """Like _search_blocks, but of all pairs in one block or between two, a part of the rows at a time."""
    t = t.sort_by([("block", "ascending"), ("vec_id", "ascending")])
    ids, weight, block = (t.column(c).to_numpy() for c in ("vec_id", "weight", "block"))
    x = matrix(t.column("unit"))
    cut = int(np.searchsorted(block, block[0], "right"))
    low = cut if cut < len(ids) else 0
    links, pairs = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
    root = everyone = np.arange(len(ids))
    for a in range(0, cut, 256):
        b = min(cut, a + 256)
        near = x[a:b] @ x[low:].T >= least
        if not low:
            near[np.arange(b - a), np.arange(a, b)] = False
        links[a:b] += near @ weight[low:]
        pairs[a:b] += near.sum(1)
        if low:
            links[low:] += weight[a:b] @ near
            pairs[low:] += near.sum(0)
        i, j = np.nonzero(near)
        root = forest(len(ids), np.concatenate([i + a, everyone]), np.concatenate([j + low, root]))
    return _found(ids, links, pairs, root)


def exact_pairs(reps: DataFrame, n: int, dim: int, least: float) -> DataFrame:
    """near_pairs() without a loss: every block of vectors against every other."""
    blocks = max(1, -(-n // max(1000, 500_000 // dim)))
    dealt = reps.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 3), "vec_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "weight", "unit")
    return dealt.groupBy("low", "high").applyInArrow(lambda t: _compare_blocks(t, least), FOUND)


def near_pairs(reps: DataFrame, n: int, dim: int, overlap: int, least: float, name: str) -> DataFrame:
    """(vec_id, links, pairs, root) as each search task found them, links weighted; reps(vec_id, weight, unit) has n rows of one dimension."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / n) * (1 << 40))
    sample = matrix(reps.where(draw).select("vec_id", "unit").orderBy("vec_id").toArrow().column("unit")) if n else np.zeros((0, dim))
    k = max(1, min(MOST_CENTROIDS, -(-n * overlap // SHARD), len(sample)))
    c = centroids(sample, k) if len(sample) else np.eye(1, dim)
    members = materialize(assign(reps, c, overlap), f"{name}-members")
    sizes = {r[0]: r[1] for r in members.groupBy("shard").count().toLocalIterator()}  # MOST_CENTROIDS at most
    blocks = F.element_at(F.create_map(*(F.lit(v) for s, m in sorted(sizes.items()) for v in (s, -(-m // CAP)))), F.col("shard")) if any(m > CAP for m in sizes.values()) else F.lit(1)
    members = members.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "vec_id"), F.col("blocks")).cast("int"))
    lists = members.select("shard", "block", "vec_id", "unit").groupBy("shard", "block").applyInArrow(_build_block, "vec_id long, lists array<long>")
    lists = materialize(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("neighbours")), f"{name}-graph")  # overlap x DEGREE at most
    linked = members.join(lists, "vec_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    linked = linked.select("shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "weight", "unit", "shards", "neighbours")
    return linked.groupBy("shard", "low", "high").applyInArrow(lambda t: _search_blocks(t, least), FOUND)


def true_links(units: DataFrame, queries: np.ndarray, ids: np.ndarray, least: float) -> dict[int, int]:
    """Links of the query vectors by brute force against all rows."""
    shared = units.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = shared.value
        count = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                near = (q @ matrix(part.column("unit")).T >= least) & (ids[:, None] != part.column("vec_id").to_numpy()[None])
                count += near.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count)], names=["vec_id", "n"])

    got = units.select("vec_id", "unit").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n")).collect()  # QUERIES rows
    return {r[0]: r[1] for r in got}


def audit(units: DataFrame, links: DataFrame, least: float = COSINE, most: int = QUERIES) -> float:
    """Mean recall of links(vec_id, n_links) between units(vec_id, unit), all different, over sampled vectors that have links.

    About most vectors are sampled of those with no link found and with one digit,
    two digits, ... of them; means are taken by the digits of the true number,
    with the samples' weights, and the smallest is returned.
    """
    digits = F.when(F.col("n_links") > 0, F.length(F.col("n_links").cast("string"))).otherwise(0)
    held = units.join(links, "vec_id", "left").select("vec_id", "unit", F.coalesce("n_links", F.lit(0)).alias("n_links")).withColumn("stratum", digits)
    sizes = {r[0]: r[1] for r in held.groupBy("stratum").count().collect()}  # a row for each number of digits
    if not sizes:
        return 1.0
    share = F.element_at(F.create_map(*(F.lit(v) for s, m in sizes.items() for v in (s, int(min(1.0, most / m) * (1 << 40))))), F.col("stratum"))
    asked = held.where(F.pmod(F.xxhash64(F.lit(SEED + 2), "vec_id"), F.lit(1 << 40)) < share).toArrow()
    if not asked.num_rows:
        return 1.0
    true = true_links(units, matrix(asked.column("unit")), asked.column("vec_id").to_numpy(), least)
    strata = asked.column("stratum").to_pylist()
    drawn = Counter(strata)
    found, total = Counter(), Counter()
    for i, n, s in zip(asked.column("vec_id").to_pylist(), asked.column("n_links").to_pylist(), strata, strict=True):
        if true[i]:
            weight = sizes[s] / drawn[s]
            found[len(str(true[i]))] += weight * min(n, true[i]) / true[i]
            total[len(str(true[i]))] += weight
    return min((found[k] / total[k] for k in total), default=1.0)


def near_duplicates(rows: DataFrame, least: float = COSINE, overlap: int = OVERLAP, name: str = "vectors") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows(vec_id, embedding).

    A vector that is null, empty, zero or has a null or non-finite component
    links with nothing, and so does one with a null vec_id (component null, kept
    true). Vectors of different dimensions don't link. vec_id is meant to be
    unique; rows that repeat one are separate vectors with that id.
    """
    units = materialize(unit_rows(rows), f"{name}-units")
    everything: DataFrame | None = None
    for dim in sorted(r[0] for r in units.select("dim").distinct().collect()):  # embedding sizes: a handful
        own = units.where(F.col("dim") == dim)
        classes = materialize(own.groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")), f"{name}-classes")
        reps = classes.select(F.col("rep").alias("vec_id"), "weight", "unit")
        n = classes.count()
        wide = overlap
        while True:
            found = materialize(near_pairs(reps, n, dim, wide, least, name), f"{name}-found")
            tidy(rows.sparkSession)
            if audit(reps, found.groupBy("vec_id").agg(F.sum("pairs").alias("n_links")), least) >= RECALL:
                break
            if wide >= MOST_OVERLAP:
                found = materialize(exact_pairs(reps, n, dim, least), f"{name}-found")
                break
            wide = min(MOST_OVERLAP, 2 * wide)
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        members = own.select("vec_id", "h", "h2").join(classes.select("h", "h2", "rep", "weight"), ["h", "h2"])
        counted = members.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        counted = materialize(counted, f"{name}-counted")
        edges = found.select(F.col("root").alias("a"), F.col("vec_id").alias("b"))
        merged = components(edges, f"{name}-cc")
        done = counted.join(merged, F.col("rep") == F.col("node"), "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
        everything = done if everything is None else everything.unionByName(done)
    ids = doc_rows(rows, "vec_id")
    if everything is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = units.select("vec_id").distinct().withColumn("usable", F.lit(True))
    rest = ids.join(usable, "vec_id", "left").where("usable IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return everything.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
