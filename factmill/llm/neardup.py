"""Exact n-gram Jaccard self-join by parity sketches.

A document is the set of its word shingles. The shingles are dealt by hash to P
parts and each part keeps the XOR of its shingles' hashes. Common shingles
cancel, and each shingle that only one of two sets has changes one part, so the
number of parts that differ (the Hamming distance of the sketches) is at most
the symmetric difference. Sets of similarity t or more and sizes a <= b <= a/t
differ in at most D = (1-t)/(1+t) * (a+b) shingles. With P > D parts, P - D of
them must be equal: the pigeonhole join. P depends on a band of sizes; a set
takes part in its own band and, if it may be the larger of a pair, in the band
below.

Light parts (fewer than LIGHT shingles) are shared by many unrelated sets, so
they are no join keys. A set with L light parts still meets each of its
partners at P - D - L others, its slack. A set with a slack below SPARE takes
part again in the next of TRIES dealings of its shingles; after the last one
all of its parts are keys. So no link is lost.

Sets that meet are candidates, and their bit sketches are compared next: a
sketch holds the parity of the shingles dealt to each of B bits, so its Hamming
distance is a lower bound of the symmetric difference, and candidates that are
further apart than D go without their texts being read. Each group of equal
keys compares its pivot with the others and joins components where the
similarity is verified on the texts. The pivot is the set that shares the most
keys with others, which is the one that copies were made of, so few rounds do.
In the first, each set meets the best of its pivots only. Groups that are then
of one component are done: a group of copies costs its size, not its square.

Groups of up to SMALL members then compare the sketches of all of them, and
larger ones their pivot with each. A set that is in fewer large groups of a
band than its slack there shares a key of a small group with each partner, so
large groups are needed for the others only, the exposed ones: few of them
compare their sketches with the whole group's. Where there are more, the
group's members go through a sharper filter, which isn't part of the sketch
method:
with the shingles of all that is left ordered from rare to common, linked sets
share one of their first (1-t) * size + 1 shingles, and the first one that they
share leaves room for the overlap that they need behind it. Groups of equal
prefix shingles compare more and more pivots with the members of other
components; positions and sketches are part of that join's condition, so sets
that can't be linked never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, doc_rows, materialize, mix, rolling, signed, slices, text_bytes, tidy, word_hashes

@dataclass(frozen=True)
class Similarity:
    """words in a shingle; percent: linked if 100 * intersection >= percent * union.

    ratio: sizes of a band; light, tries and spare: see above; passes: the texts are
    picked and the keys joined in so many slices of their hash, one after the other,
    which divides the disk that a shuffle takes and repeats the hashing of shingles.
    """

    words: int = 5
    percent: int = 80
    ratio: float = 1.2
    light: int = 2
    tries: int = 6
    spare: int = 3
    passes: int = 3

    def most_apart(self, a: int) -> int:
        """Largest symmetric difference of a set of a shingles with a linked set that isn't smaller."""
        b = a * 100 // self.percent
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @cached_property
    def edges(self) -> np.ndarray:
        """First size of every band."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * self.ratio)))
        return np.array(out, dtype=np.int64)

    @cache  # noqa: B019  the instances are few and small
    def parts(self, band: int) -> tuple[int, int]:
        """(P, D) of a band."""
        d = self.most_apart(int(self.edges[band + 1]) - 1)
        # Room for the light parts to be expected of the band's smallest sets, and some more for chance.
        p = d + self.spare
        for _ in range(20):
            mean = max(float(self.edges[band]), 1.0) / p
            light = p * sum(np.exp(-mean) * mean**k / (1, 1, 2, 6, 24)[k] for k in range(self.light))
            p = max(p, d + self.spare + int(min(0.5 * d, 1.25 * light) + 0.5))
        return p, d


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text by text, and the size of each set."""
    h, n = word_hashes([t.lower() for t in texts])  # of bytes: A-Z only
    grams = rolling(h, width)
    out, end = [], 0
    for k in n.tolist():
        start, end = end, end + k
        if k >= width:
            one = np.sort(grams[start : end - width + 1])
            new = np.ones(len(one), dtype=bool)
            np.not_equal(one[1:], one[:-1], out=new[1:])
            out.append(one[new])
        else:
            out.append(mix(rolling(h[start:end], k) + np.uint64(k)) if k else h[:0])
    return np.concatenate([h[:0], *out]), np.fromiter(map(len, out), dtype=np.int64, count=len(out))


#: Bits of a sketch: eight for each shingle that may differ, in powers of two between these bounds. Beyond the
#: larger one, sketches of very long texts tell less apart; what they let through is verified all the same.
LEAST_BITS, MOST_BITS = 128, 4096
SET = "doc_id long, n_shingles long, set_hash long, set_hash2 long, sketch array<long>"


def set_hashes(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(s)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def sketches(s: np.ndarray, n: np.ndarray, sim: Similarity) -> pa.Array:
    """The parity sketch of each set, as an array of 64-bit numbers."""
    size, of = np.unique(n, return_inverse=True)
    bits = np.array([min(max(1 << (max(8 * sim.most_apart(int(k)), 1) - 1).bit_length(), LEAST_BITS), MOST_BITS) if k else 0 for k in size], dtype=np.int64)[of]
    offset = np.cumsum(bits) - bits
    bit = (mix(s ^ np.uint64(0x3C6EF372FE94F82B)) & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(np.repeat(offset, n) + bit, minlength=int(bits.sum())) & 1
    longs = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bits) // 64]), pa.int32()), pa.array(longs))


def alike(x: str, nx: str, y: str, ny: str, sim: Similarity) -> Column:
    """Whether two sets may be linked, by their sizes and the Hamming distance of their sketches x and y.

    The larger sketch of two is folded to the smaller one's bits; folding keeps the parities.
    """
    m = F.least(F.size(x), F.size(y))
    fold = lambda c: F.when(F.size(c) == m, F.col(c)).otherwise(F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), lambda p, q: p.bitwiseXOR(q)))
    apart = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    near = (100 + sim.percent) * apart <= (100 - sim.percent) * (F.col(nx) + F.col(ny))
    return (100 * F.least(nx, ny) >= sim.percent * F.greatest(nx, ny)) & ((F.greatest(F.size(x), F.size(y)) > 2 * m) | near)


def sets(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Size, 128-bit fingerprint and sketch of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            s, n = shingles(batch.column("text").to_pylist(), sim.words)
            h, h2 = set_hashes(s, n), set_hashes(mix(s ^ np.uint64(0x5555)), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(signed(h)), pa.array(signed(h2)), sketches(s, n, sim)], names=["doc_id", "n_shingles", "set_hash", "set_hash2", "sketch"])

    return docs.mapInArrow(run, SET)


def dealt_keys(grams: np.ndarray, band: int, sim: Similarity) -> tuple[np.ndarray, int]:
    """Join keys of one set in one band, and its slack: so many of them it shares with each of its partners there,
    unless the partner's slack sufficed in an earlier dealing, and then the partner does."""
    p, d = sim.parts(band)
    keys = []
    for attempt in range(sim.tries):
        salt = np.uint64((band * 64 + attempt + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        dealt = mix(grams ^ salt)
        part = ((dealt >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=p)
        total = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(dealt[order])])
        ends = np.cumsum(count)
        value = mix(mix((total[ends] ^ total[ends - count]) + np.arange(p, dtype=np.uint64)) ^ salt)
        heavy = count >= sim.light
        slack = int(heavy.sum()) - d
        if attempt + 1 == sim.tries:
            keys.append(value)
            return np.concatenate(keys), p - d
        keys.append(value[heavy])
        if slack >= sim.spare:
            break
    return np.concatenate(keys), slack


def part_keys(grams: np.ndarray, band: int, sim: Similarity) -> np.ndarray:
    return dealt_keys(grams, band, sim)[0]


def keys(docs: DataFrame, sim: Similarity, turn: int = 0) -> DataFrame:
    """(key, doc_id, place, set_hash): the join keys of every non-empty set, those of one slice.

    place holds the size of the set, the band and the slack there, see placed().
    """
    edges, least = sim.edges, sim.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            s, n = shingles(batch.column("text").to_pylist(), sim.words)
            ids, hashes = batch.column("doc_id").to_numpy(), set_hashes(s, n)
            ends = np.cumsum(n)
            got, of, places = [], [], []
            for i in np.flatnonzero(n):
                grams = s[ends[i] - n[i] : ends[i]]
                band = int(np.searchsorted(edges, n[i], "right")) - 1
                # The smaller of a linked pair has at least percent of the larger's size.
                low = int(np.searchsorted(edges, -(-int(n[i]) * least // 100), "right")) - 1
                for b in range(low, band + 1):
                    k, slack = dealt_keys(grams, b, sim)
                    k = k[k % np.uint64(sim.passes) == turn]
                    got.append(k)
                    of.append(np.full(len(k), i))
                    places.append(np.full(len(k), (int(n[i]) << 20) + (b << 8) + min(slack, 255), dtype=np.int64))
            if got:
                at = np.concatenate(of)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(got))), pa.array(ids[at]), pa.array(np.concatenate(places)), pa.array(signed(hashes[at]))], names=["key", "doc_id", "place", "set_hash"])

    return docs.mapInArrow(run, "key long, doc_id long, place long, set_hash long")


def placed(rows: DataFrame) -> DataFrame:
    """place taken apart: n, band, slack (255: so many or more)."""
    return rows.withColumn("n", F.expr("place DIV 1048576")).withColumn("band", F.expr("place DIV 256 % 4096").cast("int")).withColumn("slack", F.expr("place % 256").cast("int")).drop("place")


def prefixes(docs: DataFrame, sim: Similarity, name: str) -> DataFrame:
    """(key, doc_id, n, set_hash, nth): the first shingles of every set, from rare to common among docs, as many as linked sets must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            s, n = shingles(batch.column("text").to_pylist(), sim.words)
            at = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([pa.array(signed(s)), pa.array(batch.column("doc_id").to_numpy()[at]), pa.array(n[at]), pa.array(signed(set_hashes(s, n))[at])], names=["key", "doc_id", "n", "set_hash"])

    rows = materialize(docs.mapInArrow(run, "key long, doc_id long, n long, set_hash long").distinct(), f"{name}-shingles")
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("doc_id", "set_hash").orderBy("df", "key")
    need = F.ceil(F.col("n") * sim.percent / 100)
    first = rows.join(common, "key").withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= F.col("n") - need + 1) & (F.col("df") > 1))
    return first.select("key", "doc_id", "n", "set_hash", "nth")


def verify(pairs: DataFrame, texts: DataFrame, sim: Similarity, name: str) -> DataFrame:
    """Those of pairs(a, b) that are linked, by the sets of their texts.

    Texts go through the shuffle, compressed, and not their shingles; a's text
    is read and cut once for all of the pairs that follow one another.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in slices(batches, text="y", limit=2 << 20):
            s, n = shingles(batch.column("y").to_pylist(), sim.words)
            ends = np.cumsum(n)
            keep = []
            for x, e, k in zip(batch.column("x"), ends, n, strict=True):
                x = x.as_py()
                if x not in seen:
                    if held > 4 << 20:
                        seen, held = {}, 0
                    seen[x], held = shingles([x], sim.words)[0], held + len(x)
                mine, theirs = seen[x], s[e - k : e]
                both = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum()) if len(mine) else 0
                keep.append(both > 0 and 100 * both >= sim.percent * (len(mine) + int(k) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), f"{name}-links")


def link(docs: DataFrame, sim: Similarity | None = None, name: str = "neardup") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents(doc_id, text).

    Null and empty texts have no shingles and are linked with nothing, like rows
    with a null doc_id, whose component is null. Rows with one doc_id are one
    node of the graph: the rows' own sets count, and what any of them links.
    """
    sim = sim or Similarity()
    spark = docs.sparkSession
    rows = doc_rows(docs, "doc_id", "text").withColumn("text", text_bytes())
    sized = materialize(sets(rows, sim), f"{name}-sizes")
    fingerprint = ["n_shingles", "set_hash", "set_hash2"]
    # Equal sets are one class; its smallest document stands for it.
    known = sized.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy(*fingerprint).agg(F.min("doc_id").alias("rep"))
    member = materialize(known.select("doc_id", *fingerprint).distinct().join(classes, fingerprint).select("doc_id", "rep"), f"{name}-classes")

    # The text of each class: its smallest document's rows. All texts are shuffled here, so this goes in slices as well.
    reps = member.where("doc_id = rep").select("doc_id").distinct()
    slices_read = []
    for turn in range(sim.passes):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(sim.passes)) == turn
        slices_read.append(materialize(rows.where(mine).hint("merge").join(reps.where(mine), "doc_id", "left_semi"), f"{name}-texts"))
        tidy(spark)
    texts = spark.read.schema(slices_read[0].schema).parquet(*(part.scratch_path for part in slices_read))
    once = Window.partitionBy("key")
    met: DataFrame | None = None
    slices_met = []
    for turn in range(sim.passes):
        part = keys(texts, sim, turn).withColumn("lo", F.min("doc_id").over(once)).withColumn("hi", F.max("doc_id").over(once)).withColumn("sharing", F.count(F.lit(1)).over(once)).where("lo < hi")
        slices_met.append(materialize(placed(part.drop("lo", "hi")), f"{name}-met"))
        met = slices_met[-1] if met is None else met.unionByName(slices_met[-1])
        tidy(spark)
    nodes = met.groupBy("doc_id").agg(F.sum("sharing").alias("pop")).select("doc_id", F.col("doc_id").alias("component"), "pop")
    nodes = materialize(nodes, f"{name}-nodes")
    # From here on only documents that share a key matter.
    near = materialize(texts.join(nodes.select("doc_id"), "doc_id", "left_semi"), f"{name}-near")
    sketch = materialize(known.select("doc_id", "set_hash", "sketch").join(nodes.select("doc_id"), "doc_id", "left_semi").distinct(), f"{name}-sketches")
    discard(*slices_read)
    tidy(spark)
    found = _linked(met, _State(nodes, near, sketch, sim, name))
    discard(*slices_met, near, sketch)
    edges = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    merged = components(edges if found is None else edges.unionByName(found), f"{name}-cc")
    return sized.select("doc_id", "n_shingles").join(merged, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


#: Members of the groups of equal keys that compare all their sketches at once; larger ones go through the prefix filter.
SMALL = 64


@dataclass
class _State:
    """What is known between rounds: nodes(doc_id, component, pop), texts and sketches of the nodes, verified pairs, links."""

    nodes: DataFrame
    texts: DataFrame
    sketch: DataFrame
    sim: Similarity
    name: str
    done: DataFrame | None = None
    found: DataFrame | None = None

    def settle(self, pairs: DataFrame) -> None:
        """Verify pairs(a, b) and join components."""
        pairs = pairs.where("a <> b").select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"])
        pairs = materialize(pairs if self.done is None else pairs.join(self.done, ["lo", "hi"], "left_anti"), f"{self.name}-pairs")
        if pairs.isEmpty():
            return
        linked = verify(pairs.select("a", "b"), self.texts, self.sim, self.name)
        self.done = pairs.select("lo", "hi") if self.done is None else self.done.unionByName(pairs.select("lo", "hi"))
        if not linked.isEmpty():
            self.found = linked if self.found is None else self.found.unionByName(linked)
            merged = components(self.found, f"{self.name}-cc")
            new = self.nodes.select("doc_id", "pop").join(merged, F.col("doc_id") == F.col("node"), "left")
            old, self.nodes = self.nodes, materialize(new.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "pop"), f"{self.name}-nodes")
            discard(old)
        tidy(pairs.sparkSession)

    def open(self, group: DataFrame, least: int = 1) -> DataFrame:
        """The rows of group whose key joins several components and more than least rows, with their component,
        their key's pivot, and the number of its rows. group may be what open() returned; it is discarded then."""
        live = materialize(group.select("key", "doc_id", "n", "set_hash", "band", "slack").join(self.nodes, "doc_id"), f"{self.name}-placed")
        if hasattr(group, "scratch_path"):
            discard(group)
        top = F.struct((-F.col("pop")).alias("order"), "doc_id", "set_hash", "n", "component")
        span = live.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(top).alias("pivot"), F.count(F.lit(1)).alias("members")).where(f"lo < hi AND members > {least}").select("key", "pivot", "members")
        out = materialize(live.hint("merge").join(span, "key"), f"{self.name}-live")
        discard(live)
        return out

    def with_sketch(self, rows: DataFrame, of: str = "doc_id", set_: str = "set_hash", to: str = "sk") -> DataFrame:
        return rows.join(self.sketch.select(F.col("doc_id").alias(of), F.col("set_hash").alias(set_), F.col("sketch").alias(to)), [of, set_])

    def to_pivots(self, live: DataFrame) -> DataFrame:
        """(doc_id, p, order): documents and those of their pivots that they may be linked to."""
        apart = live.where("component <> pivot.component").select("doc_id", "set_hash", "n", F.col("pivot.doc_id").alias("p"), F.col("pivot.set_hash").alias("ps"), F.col("pivot.n").alias("pn"), F.col("pivot.order").alias("order")).distinct()
        pairs = self.with_sketch(self.with_sketch(apart), "p", "ps", "psk")
        return pairs.where(alike("sk", "n", "psk", "pn", self.sim)).select("doc_id", "p", "order")

    def within(self, live: DataFrame, exposed: bool = False) -> DataFrame:
        """(doc_id, p): members of one key's group that may be linked and are of different components; with exposed, pairs that have an exposed member."""
        rows = self.with_sketch(live.select("key", "doc_id", "set_hash", "n", "component", *(["exposed"] if exposed else []))).drop("set_hash")
        if not exposed:
            rows = rows.repartition("key")  # once for both sides
        other = rows.where("exposed") if exposed else rows
        other = other.select("key", F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"), F.col("sk").alias("psk"))
        each = F.lit(True) if exposed else F.col("p") < F.col("doc_id")
        return rows.join(other, "key").where(each & (F.col("pc") != F.col("component")) & alike("sk", "n", "psk", "pn", self.sim)).select("doc_id", "p")


def _linked(met: DataFrame, state: _State) -> DataFrame | None:
    """Links(a, b) that join all documents which have a link; None if there are none."""
    met = met.groupBy("key", "doc_id", "n", "set_hash", "band").agg(F.min("slack").alias("slack"))
    as_pairs = lambda df: df.select(F.col("p").alias("a"), F.col("doc_id").alias("b"))
    live = state.open(met)
    best = state.to_pivots(live).groupBy("doc_id").agg(F.min(F.struct("order", "p")).alias("first"))
    state.settle(as_pairs(best.select("doc_id", "first.p")))
    live = state.open(live)
    large = live.where(f"members > {SMALL}")
    state.settle(as_pairs(state.within(live.where(f"members <= {SMALL}")).unionByName(state.to_pivots(large).drop("order"))))
    live = state.open(live, SMALL)
    mine = Window.partitionBy("doc_id", "set_hash", "band")  # as many rows as a set has keys in a band
    live_ = live.withColumn("exposed", F.count(F.lit(1)).over(mine) >= F.min("slack").over(mine))
    some = live_.groupBy("key").agg(F.count_if("exposed").alias("n_exposed")).where("n_exposed > 0")
    marked = materialize(live_.join(some, "key"), f"{state.name}-exposed")
    discard(live)
    state.settle(as_pairs(state.within(marked.where(f"n_exposed <= {SMALL}"), exposed=True)))
    rest = materialize(state.texts.join(marked.where(f"n_exposed > {SMALL}").select("doc_id").distinct(), "doc_id", "left_semi"), f"{state.name}-rest")
    discard(marked)
    if not rest.isEmpty():
        _sharp(rest, state)
    discard(rest)
    return state.found


def _sharp(rest: DataFrame, state: _State) -> None:
    """Join the components of documents(doc_id, text) by their prefixes."""
    sim, name = state.sim, state.name
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pop"), "doc_id", "set_hash"))
    group = prefixes(rest, sim, name).join(state.nodes.select("doc_id", "pop"), "doc_id").withColumn("rank", rank).drop("pop")
    held = group = materialize(state.with_sketch(group), f"{name}-groups")
    first, width = 1, 1
    while True:
        placed = group.join(state.nodes.select("doc_id", "component"), "doc_id")
        span = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("rank").alias("last")).where(f"lo < hi AND last > {first}").select("key")
        live = materialize(placed.join(span, "key", "left_semi"), f"{name}-live")
        discard(held)
        if live.isEmpty():
            return
        held, group = live, live.drop("component")
        pivots = live.where(f"rank >= {first} AND rank < {first + width}").select("key", F.col("doc_id").alias("p"), F.col("component").alias("pc"), F.col("rank").alias("pr"), F.col("n").alias("pn"), F.col("nth").alias("pnth"), F.col("sk").alias("psk"))
        # The first shingle that two sets share leaves at most this overlap.
        room = 1 + F.least(F.col("n") - F.col("nth"), F.col("pn") - F.col("pnth"))
        fits = (100 + sim.percent) * room >= sim.percent * (F.col("n") + F.col("pn"))
        pairs = live.join(pivots, "key").where((F.col("pr") < F.col("rank")) & (F.col("pc") != F.col("component")) & fits & alike("sk", "n", "psk", "pn", sim))
        state.settle(pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")))
        first, width = first + width, width * 32
