"""Phrase collocations from vertical positional inverted lists.

Texts fall into blocks of a bounded number of slots: words, and separators
where a piece ends. A block keeps, for every frequent word and phrase, the list
of positions where it starts. Phrases of k words grow by a merge join of their
positions, moved by k, with the postings of words; where the phrase without its
first word isn't frequent either, nothing is listed. The lengths of lists, summed
over blocks, are the exact frequencies; lists of infrequent phrases go.

Positions never leave their block, and blocks are stored in buckets, so that no
level shuffles them. What is shuffled between levels are a
block's different candidates with their counts, packed into one row for each group
of keys, so the commonest word has one entry a block, like any other, and no key
is hot. A block can deal its candidates again in the same order, so a group answers
with their places in that order. Blocks overlap by the longest phrase
less one word: a phrase counts in the block that owns its first slot. So a long
text needs no more memory than a block.

A phrase's id is its number within its group, times the groups, plus the group's:
ids are exact within a number of words and leave few gaps, no hashes are compared.

Defined results. A null text is empty; a null lang is `und`, together with rows
that say so. Repeated rows count as often as they are there. doc_id and other
columns aren't looked at. Words that aren't UTF-8 are shown with U+FFFD, and
bytes FE and FF, which UTF-8 lacks, count as the same. An empty
table, or one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_buckets, discard, discard_part, materialize, materialize_buckets, mix, partitions, text_bytes, tidy

#: Slots that a block owns, and the bits of a candidate's place in its block.
BLOCK, PLACE = 1 << 19, 21
#: A long text is split into words so many bytes at a time.
WINDOW = 1 << 20
#: Candidates that meet in a group; groups are as many as that takes.
GROUP = 1 << 19
#: Parts of the blocks that become lists one after the other, so that both don't stand on disk whole.
SLICES = 4
#: Parts into which a language's phrases are dealt for the first ranking.
PARTS = 64
UNDETERMINED = "und"

#: Ends of pieces become FF, a byte that UTF-8 doesn't have; tabs become spaces; A-Z are lowered.
END = b"\xff"
_PLAIN = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b in b" \t" else b + 32 if 65 <= b <= 90 else min(b, 254) for b in range(256))

def slots(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, and END where a piece ends, in bounded lists."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text) and _PLAIN[text[end]] not in (255, 32):
            end += 1
        yield text[at:end].translate(_PLAIN).replace(END, b" \xff ").split()
        at = end


class _Block:
    """Slots in order as codes of words of this block; -1 ends a piece."""

    def __init__(self) -> None:
        self.codes, self.number = array("i"), count()
        self.coded: dict[str, dict[bytes, int]] = {}

    def of(self, lang: str) -> dict[bytes, int]:
        if lang not in self.coded:
            self.coded[lang] = defaultdict(self.number.__next__, {END: -1})
        return self.coded[lang]

    def words(self) -> list[tuple[str, bytes]]:
        out: list = [None] * sum(len(d) - 1 for d in self.coded.values())
        for lang, d in self.coded.items():
            for w, c in d.items():
                if c >= 0:
                    out[c] = lang, w
        return out

    def rest(self, at: int) -> _Block:
        """A block that begins with the slots from at on."""
        out, words = _Block(), self.words()
        out.codes.extend(c if c < 0 else out.of(words[c][0])[words[c][1]] for c in self.codes[at:])
        return out


def blocks(docs: DataFrame, longest: int, size: int = BLOCK) -> DataFrame:
    """(block, own, codes, n, langs, lang, words, counts, sums): codes of slots, packed; slots from own on are looked ahead at. The n words come by falling count; lang is an index of langs for each, sums are those of languages."""

    def row(number: int, own: int, block: _Block) -> pa.RecordBatch:
        codes = np.array(block.codes[: own + longest - 1], dtype=np.int32)
        words = block.words()[: codes.max(initial=-1) + 1]  # words come in order of their first slot
        owned = codes[:own]
        counts = np.bincount(owned[owned >= 0], minlength=len(words)).astype(np.int32)
        langs = pa.array([lang for lang, _ in words], pa.string()).dictionary_encode()
        shown = pa.array([w.decode("utf-8", "replace") for _, w in words], pa.string())
        lang = langs.indices.to_numpy().astype(np.int32)
        order = pc.sort_indices(pa.table([counts, lang, shown], ["c", "lang", "word"]), [("c", "descending"), ("lang", "ascending"), ("word", "ascending")]).to_numpy().astype(np.int64)
        code = np.empty(len(words) + 1, dtype=np.int32)
        code[order], code[-1] = np.arange(len(words)), -1
        sums = [{"lang": x, "n": int(n)} for x, n in zip(langs.dictionary.to_pylist(), np.bincount(lang, counts, len(langs.dictionary)))]
        values = [[number], [own], [_planes(code[codes])], [len(words)], [langs.dictionary.to_pylist()], [_steps(lang[order])], [_joined(shown.take(pa.array(order)).to_pylist())], [_steps(counts[order])], [sums]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    names = ["block", "own", "codes", "n", "langs", "lang", "words", "counts", "sums"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nth, block = TaskContext.get().partitionId() << 20, 0, _Block()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for words in slots(text.as_py()):
                    block.codes.extend(map(block.of(lang).__getitem__, words))
                    while len(block.codes) >= size + longest:
                        yield row(first + nth, size, block)
                        nth, block = nth + 1, block.rest(size)
                block.codes.append(-1)
        if block.codes:
            yield row(first + nth, len(block.codes), block)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "block long, own int, codes binary, n long, langs array<string>, lang binary, words binary, counts binary, sums array<struct<lang:string,n:long>>")


# ---------------------------------------------------------------- what meets between levels
#
# A block deals its different candidates over groups by a hash of their key: one row for each
# group, with arrays. A group sums the counts of a key, which has one entry a block at most, and
# sends the numbers of frequent ones back to their blocks, again as one row for each. A place is
# one in the order in which a block has dealt its candidates, which it can repeat.


def _groups(candidates: DataFrame, n: str) -> int:
    spark = candidates.sparkSession
    return max(partitions(spark), (candidates.agg(F.sum(n)).head()[0] or 0) // GROUP)


def _planes(values: np.ndarray) -> bytes:
    """Compressed numbers: all lowest bytes first, all highest last, so that zeros stand together."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes(), 1)


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    """What _planes() has compressed."""
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Numbers as compressed steps, which are small where they ascend."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _unsteps(data: bytes, kind: type) -> np.ndarray:
    """What _steps() has compressed."""
    return np.cumsum(_unplanes(data, kind), dtype=kind)


def _joined(words: list) -> bytes:
    """Compressed words; none has a line's end."""
    return zstandard.compress("\n".join(words).encode(), 3)


def _split(data: bytes) -> list[bytes]:
    """What _joined() has compressed, in UTF-8."""
    return zstandard.decompress(data).split(b"\n")


def _values(column: pa.Array, kind: type, unpack=_unsteps) -> np.ndarray:
    """What has been packed, of all rows in a row."""
    parts = [unpack(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _dealt(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidates in the order in which they are dealt, groups, their bounds in it)."""
    order = np.argsort(group, kind="stable")
    groups, at = np.unique(group[order], return_index=True)
    return order, groups, np.append(at, len(group)).astype(np.int32)


def _packed(values: np.ndarray, bounds: np.ndarray, pack=_steps) -> pa.Array:
    """One value for each part."""
    return pa.array([pack(values[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of n places, one row after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _met(key: np.ndarray, c: np.ndarray, least: int, ranked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates with key indexes from 0 on: (rows of frequent keys, the numbers of those rows, one row of each frequent key, frequencies). Numbers follow the keys, or their falling frequencies."""
    n = int(key.max(initial=-1)) + 1
    f, some, number = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
    np.add.at(f, key, c)
    some[key] = np.arange(len(key))
    good = np.flatnonzero(f >= least)
    if ranked:
        good = good[np.argsort(-f[good], kind="stable")]
    number[good] = np.arange(len(good))
    rows = np.flatnonzero((f >= least)[key])
    return rows, number[key[rows]], some[good], f[good]


def _said(bucket: int, groups: int, block: np.ndarray, place: np.ndarray, number: np.ndarray, lists: dict[str, list]) -> pa.Table:
    """A group's rows: one for each block, with places and the numbers of what is there, and one of lists."""
    order = np.lexsort((place, block))
    each, at = np.unique(block[order], return_index=True)
    bounds, none = np.append(at, len(block)), pa.nulls(1, pa.binary())
    packed = [pa.concat_arrays([_packed(x[order].astype(np.int32), bounds), none]) for x in (place, number)]
    lists = {"id": (np.arange(len(lists["f"])) * groups + bucket).tolist()} | lists
    named = [pa.array([None] * len(each) + [x], pa.list_(pa.string() if name in ("lang", "word") and "lang" in lists else pa.int64())) for name, x in lists.items()]
    return pa.table([pa.array([*each.tolist(), None], pa.int64()), pa.array([bucket] * (len(each) + 1), pa.int64()), *packed, *named], ["block", "bucket", "places", "numbers", *lists])


_SAID = "block long, bucket long, places binary, numbers binary, id array<long>, f array<long>, "


def _dealt_words(row: dict, groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, and _dealt() of them, by language within a group."""
    words = _split(row["words"])[: row["n"]]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return words, *_dealt((hashes % np.uint64(groups)).astype(np.int64) * len(row["langs"]) + _unsteps(row["lang"], np.int32))


def frequent_words(text: DataFrame, least: int, groups: int) -> DataFrame:
    """What groups of words say: rows of a block (block, bucket, places, numbers), and rows without one, of lists (id, f, lang, word)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["n"]:
                words, order, each, bounds = _dealt_words(row, groups)
                wide, counts = len(row["langs"]), _unsteps(row["counts"], np.int32)[order]
                some = [_joined([words[i].decode() for i in order[a:b]]) for a, b in zip(bounds, bounds[1:])]
                langs = pa.array(row["langs"], pa.string()).take(pa.array(each % wide))  # a row for each language of a group
                yield pa.RecordBatch.from_arrays([pa.array(each // wide), pa.array(np.full(len(each), row["block"])), langs, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(some, pa.binary()), _packed(counts, bounds)], ["bucket", "block", "lang", "first", "n", "words", "c"])

    def meet(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        row = np.repeat(np.arange(len(t)), n)
        words = pa.concat_arrays([pa.array(_split(x), pa.binary()).cast(pa.string()) for x in t.column("words").to_pylist()])
        block, langs = t.column("block").to_numpy()[row], t.column("lang").combine_chunks().take(pa.array(row))
        key = pc.binary_join_element_wise(langs, words, "\n").dictionary_encode().indices.to_numpy()
        rows, number, some, f = _met(key, _values(t.column("c"), np.int32), least, ranked=True)
        at, place = pa.array(some), _places(t.column("first").to_numpy(), n)
        return _said(t.column("bucket")[0].as_py(), groups, block[rows], place[rows], number, {"f": f.tolist(), "lang": langs.take(at).to_pylist(), "word": words.take(at).to_pylist()})

    dealt = text.select("block", "n", "langs", "lang", "words", "counts").mapInArrow(deal, "bucket long, block long, lang string, first int, n int, words binary, c binary")
    return dealt.groupBy("bucket").applyInArrow(meet, _SAID + "lang array<string>, word array<string>")


def _turn(prefix: np.ndarray, groups: int) -> np.ndarray:
    """Where the groups of a prefix's candidates begin; the last word's id tells how far on one is."""
    return (mix(prefix.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _dealt_phrases(row: dict, prefix: np.ndarray, word: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the prefixes and words of a block's candidates, and _dealt() of these. A group and a prefix leave the word's remainder by the number of groups no choice, so it isn't sent."""
    p_ids, w_ids = (_unsteps(row[c], np.int64) for c in ("p_ids" if row["p_ids"] else "w_ids", "w_ids"))
    prefix, word = p_ids[prefix], w_ids[word]
    return prefix, word, *_dealt((_turn(prefix, groups) + word) % groups)


def frequent_phrases(lists: DataFrame, k: int, least: int, groups: int) -> DataFrame:
    """The same for candidates of k + 1 words: lists (id, f, prefix, word)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, candidate, prefix, word = _grown(row, k)
            if len(prefix):
                owned = np.bincount(candidate[at < row["own"]], minlength=len(prefix)).astype(np.int32)
                prefix, word, order, each, bounds = _dealt_phrases(row, prefix, word, groups)
                packed = [_packed(prefix[order], bounds), _packed(word[order] // groups, bounds, _planes), _packed(owned[order], bounds, _planes)]
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.full(len(each), row["block"])), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), *packed], ["bucket", "block", "first", "n", "prefix", "word", "c"])

    def meet(t: pa.Table) -> pa.Table:
        n, bucket = t.column("n").to_numpy(), t.column("bucket")[0].as_py()
        prefix, word, c = _values(t.column("prefix"), np.int64), _values(t.column("word"), np.int64, _unplanes), _values(t.column("c"), np.int32, _unplanes)
        word = word * groups + (bucket - _turn(prefix, groups)) % groups
        block, place = np.repeat(t.column("block").to_numpy(), n), _places(t.column("first").to_numpy(), n)
        order = np.lexsort((word, prefix))
        new = np.append(True, (np.diff(prefix[order]) != 0) | (np.diff(word[order]) != 0))
        key = np.empty(len(order), dtype=np.int64)
        key[order] = np.cumsum(new) - 1
        rows, number, some, f = _met(key, c, least)
        return _said(bucket, groups, block[rows], place[rows], number, {"f": f.tolist(), "prefix": prefix[some].tolist(), "word": word[some].tolist()})

    dealt = lists.mapInArrow(deal, "bucket long, block long, first int, n int, prefix binary, word binary, c binary")
    return dealt.groupBy("bucket").applyInArrow(meet, _SAID + "prefix array<long>, word array<long>")


def _listed(found: DataFrame, *columns: str) -> DataFrame:
    """The rows of lists that groups give."""
    return found.where("block IS NULL").select(F.explode(F.arrays_zip("id", "f", *columns)).alias("x")).select("x.*")


def _by_block(found: DataFrame) -> DataFrame:
    """What all groups say of a block, in one row; a block bounds it."""
    return found.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "places", "numbers")).alias("found"))


# ---------------------------------------------------------------- inverted lists of a block


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(name)[i].as_py() for name in b.schema.names}


def _lists(ids: np.ndarray, which: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Inverted lists by _steps(): ids, their lengths and positions in order, from the index of an id at each of some ascending positions."""
    order = np.argsort(which, kind="stable")
    return [_steps(ids.astype(np.int64)), _steps(np.bincount(which, minlength=len(ids)).astype(np.int32)), _steps(at[order].astype(np.int32))]


def _merged(lengths: bytes, at: bytes, size: int) -> np.ndarray:
    """The lists merged by position: the index of the list that has it, for each slot of the block; -1 for none."""
    lengths, at = _unsteps(lengths, np.int32), _unsteps(at, np.int32)
    out = np.full(size, -1, dtype=np.int64)
    out[at] = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    return out


def _grown(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of k + 1 words in a block: start positions, the candidate of each, and the candidates' prefix and word as indexes."""
    size = row["size"] + k + 1
    words = _merged(row["w_len"], row["w_at"], size)
    starts = words if row["p_ids"] is None else _merged(row["p_len"], row["p_at"], size)
    at = np.flatnonzero(starts[: row["size"]] >= 0)
    at = at[(words[at + k] >= 0) & (starts[at + 1] >= 0)]
    wide = np.int64(max(1, len(_unsteps(row["w_len"], np.int32))))
    different, candidate = np.unique(starts[at] * wide + words[at + k], return_inverse=True)
    return at, candidate, different // wide, different % wide


_COLUMNS = ["w_ids", "w_len", "w_at", "p_ids", "p_len", "p_at"]
_STORED = "block long, own int, size int, n_p long, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _stored(row: dict, words: list[bytes], lists: list[bytes | None]) -> pa.RecordBatch:
    n = int(_unsteps(words[1] if lists[1] is None else lists[1], np.int32).sum())
    head = [pa.array([row["block"]]), pa.array([row["own"]], pa.int32()), pa.array([row["size"]], pa.int32()), pa.array([n], pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.binary()) for x in [*words, *lists])], ["block", "own", "size", "n_p", *_COLUMNS])


def _numbered(row: dict, order: np.ndarray, groups: int) -> np.ndarray:
    """The id of each of a block's candidates, dealt in this order; -1 for infrequent ones."""
    out = np.full(len(order), -1, dtype=np.int64)
    for x in row["found"]:
        out[order[_unsteps(x["places"], np.int32)]] = _unsteps(x["numbers"], np.int32).astype(np.int64) * groups + x["bucket"]
    return out


def _kept(ids: np.ndarray, which: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Lists of those whose id isn't -1, by ascending id."""
    order = np.argsort(ids, kind="stable")
    order = order[np.searchsorted(ids[order], 0) :]
    number = np.full(len(ids), -1, dtype=np.int64)
    number[order] = np.arange(len(order))
    stay = ids[which] >= 0
    return _lists(ids[order], number[which[stay]], at[stay])


def word_lists(text: DataFrame, found: DataFrame, groups: int) -> DataFrame:
    """A block's lists of frequent words, which are its phrases of one word as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes = _unplanes(row["codes"], np.int32)
            at = np.flatnonzero(codes >= 0)
            ids = _numbered(row, _dealt_words(row, groups)[1], groups)
            yield _stored(row | {"size": len(codes)}, _kept(ids, codes[at].astype(np.int64), at), [None] * 3)

    return text.select("block", "own", "codes", "n", "langs", "lang", "words").join(_by_block(found), "block").mapInArrow(run, _STORED)


def _slice_of(block: str) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(SLICES)).cast("int")


def all_word_lists(text: DataFrame, found: DataFrame, groups: int) -> DataFrame:
    """word_lists() of all blocks, written; text is deleted."""
    lists = None
    for i in range(SLICES):
        rows = word_lists(text.where(F.col("slice") == i), found.where(_slice_of("block") == i), groups)
        lists = materialize_buckets(rows, "phrases-lists-1", "block") if lists is None else add_buckets(lists, rows, "block")
        discard_part(text, slice=i)
    discard(text)
    return lists


def extended(lists: DataFrame, found: DataFrame, k: int, groups: int) -> DataFrame:
    """The lists of frequent phrases of k + 1 words in place of those of k words, and the postings that may follow them; blocks without one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, candidate, prefix, word = _grown(row, k)
            ids = _numbered(row, _dealt_phrases(row, prefix, word, groups)[2], groups)
            words = _merged(row["w_len"], row["w_at"], row["size"] + k + 2)
            follow = at[ids[candidate] >= 0] + k + 1
            follow = follow[words[follow] >= 0]
            yield _stored(row, _lists(_unsteps(row["w_ids"], np.int64), words[follow], follow), _kept(ids, candidate, at))

    return lists.join(_by_block(found), "block").mapInArrow(run, _STORED)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of 2 to longest words, and the words of each language.

    The first has lang, phrase, m (words), f, lefts and rights (the frequencies of
    its first and last 1, 2 ... m - 1 words), and inner: whether a longer frequent
    phrase holds it that is as frequent. The second has lang and n, all its words.
    """
    text = materialize_buckets(blocks(docs, longest, size).withColumn("slice", _slice_of("block")), "phrases-blocks", "block", "slice")
    totals = materialize(text.select(F.explode("sums").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n")), "phrases-totals")
    groups = _groups(text, "n")
    found = materialize(frequent_words(text, least, groups), "phrases-1")
    tidy(docs.sparkSession)  # the shuffle of words goes before lists stand beside texts
    none = F.array().cast("array<long>")
    words = _listed(found, "lang", "word").select("id", F.lit(0).cast("long").alias("suffix"), F.lit(0).cast("long").alias("prefix"), F.col("id").alias("word"), "lang", F.col("word").alias("phrase"), "f", none.alias("lefts"), none.alias("rights"))
    known, out = words, []
    lists = all_word_lists(text, found, groups)
    for k in range(1, longest):
        groups = _groups(lists, "n_p")
        found = materialize(frequent_phrases(lists, k, least, groups), f"phrases-{k + 1}")
        known = materialize(_named(_listed(found, "prefix", "word"), known, words), f"phrases-named-{k + 1}")
        out.append(known.withColumn("m", F.lit(k + 1)))
        if k + 1 < longest:
            tidy(docs.sparkSession)
            longer = materialize_buckets(extended(lists, found, k, groups), f"phrases-lists-{k + 1}", "block")
            discard(lists)
            lists = longer
    discard(lists)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    holders = whole.where("m > 2")
    held = [holders.where(f"f = element_at({side}, -1)").select((F.col("m") - 1).alias("m"), F.col(part).alias("id")) for side, part in (("lefts", "prefix"), ("rights", "suffix"))]
    inner = held[0].unionByName(held[1]).distinct().withColumn("inner", F.lit(True))
    whole = whole.join(inner, ["m", "id"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return whole.select("lang", "phrase", "m", "f", "lefts", "rights", "inner"), totals


def _named(new: DataFrame, known: DataFrame, words: DataFrame) -> DataFrame:
    """new(id, prefix, word, f) with language, phrase, the frequencies of first and last parts, and the id of the phrase without its first word.

    That one has the same last word, and for its own prefix what the new one's
    prefix has for a suffix. Before one word stands the empty phrase, 0.
    """
    first = known.select(F.col("id").alias("prefix"), F.col("suffix").alias("before"), "lang", F.col("phrase").alias("start"), F.array_append("lefts", F.col("f")).alias("lefts"))
    last = known.select(F.col("prefix").alias("before"), "word", F.col("id").alias("suffix"), F.array_append("rights", F.col("f")).alias("rights"))
    one = words.select(F.col("id").alias("word"), F.col("phrase").alias("end"))
    met = new.join(first, "prefix").join(last, ["before", "word"]).join(one, "word")
    return met.select("id", "prefix", "suffix", "word", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "f", "lefts", "rights")


def scored(whole: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase that isn't inner: its lowest-scoring cut, the first of equal ones."""

    def number(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    top = F.lit(1000).cast("decimal(4,0)") * number(F.col("f")) * number(F.col("n"))
    whole = whole.where("NOT inner").join(totals, "lang").withColumn("top", top)
    cut = "transform(sequence(1, m - 1), k -> struct(top div (cast(lefts[k - 1] as decimal(19,0)) * cast(rights[m - k - 1] as decimal(19,0))) as score, k as k, lefts[k - 1] as l, rights[m - k - 1] as r))"
    best = whole.withColumn("cut", F.array_min(F.expr(cut)))
    return best.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def first(rows: DataFrame, most: int) -> DataFrame:
    """rows with rank, the first of each language; a language's rows are ranked in parts, and the parts' first ones together."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, size: int = BLOCK) -> DataFrame:
    """Each language's first phrases by score; see the module for odd rows."""
    return first(scored(*phrases(docs, least, longest, size)), most)
