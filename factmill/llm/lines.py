"""Line deduplication within one word edit, by a deletion-neighbourhood join; DataFrame functions only.

A line is its words (white space doesn't count). Lines of at least MIN_WORDS
words are near duplicates if one inserted, deleted or replaced word turns one
into the other; shorter ones only if they are equal. A line is removed if an
earlier one, by (doc_id, line number), is equal or near; the earliest stays,
whether or not the line that it resembles was removed itself.

Two lines within one edit have equal variants: the longer one without one word
is the shorter, or both without the word at one position are equal. Emitting
the variants of all lines would multiply the corpus, so two filters that lose
nothing come first: equal lines are one, and as an edit leaves the first or the
second half of a line as it is, only lines that share a half with another emit
variants. Groups of equal variants are reduced to their earliest line (combined
before the shuffle), each other member meets that one, and the edit distance
is verified on the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free, materialize, tidy

#: Words of the shortest lines that are compared within an edit; a default, see removed_lines().
MIN_WORDS = 5
#: Bits of the summed hashes; sums of millions stay far below 2**63.
_MASK = (1 << 40) - 1
_ID = ["doc_id", "text_hash", "line_no"]


def line_words(line: Column) -> Column:
    """Words of a line. One character to split at needs no regular expression, which would be compiled for each line."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\f\r", "    "), " "), "")


def has_word(line: Column) -> Column:
    """Whether a line has a word; told by its first character that is no space, without cutting it."""
    return line.rlike("[^ \\t\\x0B\\f\\r]")


def _lines(rows: DataFrame) -> DataFrame:
    """Every line with a word: id, words and their number n."""
    each = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(has_word(F.col("line")))
    return each.withColumn("words", line_words(F.col("line"))).withColumn("n", F.size("words")).drop("line")


def _half(side: str, shorter: Column, min_words: int) -> Column:
    """Key of a line's first or last half, as a member of pairs whose shorter line has so many words."""
    k = F.floor(shorter / 2).cast("int")
    part = F.slice("words", F.lit(1), k) if side == "first" else F.slice("words", F.col("n") - k + 1, k)
    return F.when(shorter >= min_words, F.xxhash64(F.lit(side), shorter, part))


def removed_lines(docs: DataFrame, name: str = "lines", min_words: int = MIN_WORDS, turns: int = 3) -> DataFrame:
    """(doc_id, text_hash, line_no, near) of the lines to remove from documents(doc_id, text).

    min_words: lines of fewer words are near nothing, only equal. turns: groups
    of equal variants are gathered in so many slices of their key, one after
    the other, which divides the disk that their shuffle takes.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    n = F.col("n")
    halves = [_half(side, size, min_words).alias(f"{side}{i}") for i, size in enumerate((n, n - 1)) for side in ("first", "last")]
    hashed = materialize(_lines(rows).select(*_ID, "n", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("h2"), *halves), f"{name}-hashed")

    # Equal lines have equal halves, so any of a group's will do.
    keys = [f"{side}{i}" for i in (0, 1) for side in ("first", "last")]
    once = hashed.groupBy("h", "h2").agg(F.min(F.struct(*_ID)).alias("first"), F.count(F.lit(1)).alias("lines"), *(F.any_value(k).alias(k) for k in ("n", *keys)))
    once = materialize(once, f"{name}-once")
    tidy(spark)
    several = once.where("lines > 1").select("h", "h2", "first")
    equal = hashed.select(*_ID, "h", "h2").join(several, ["h", "h2"]).where(F.struct(*_ID) != F.col("first"))
    equal = materialize(equal.select(*_ID, F.lit(False).alias("near")), f"{name}-equal")
    discard(hashed)
    tidy(spark)

    # Lines that share a half with another line.
    half = once.where(n >= min_words).select("first.*", F.explode(F.array(*keys)).alias("half")).where("half IS NOT NULL")
    common = half.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half")
    some = half.join(common, "half", "left_semi").select(*_ID).distinct()
    wanted = materialize(some.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("wanted")), f"{name}-wanted")
    discard(once)
    tidy(spark)
    texts = rows.hint("merge").join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    chosen = texts.withColumn("split", F.split("text", "\n")).select("doc_id", "text_hash", F.explode(F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.element_at("split", i + 1).alias("line")))).alias("x"))
    chosen = materialize(chosen.select("doc_id", "text_hash", "x.line_no", line_words(F.col("x.line")).alias("words")), f"{name}-chosen")
    discard(wanted)
    tidy(spark)

    losers = _near(chosen, name, turns)
    discard(chosen)
    tidy(spark)
    return equal.unionByName(losers.select(*_ID, F.lit(True).alias("near")))


def _near(chosen: DataFrame, name: str, turns: int) -> DataFrame:
    """Ids of the chosen lines with an earlier one within one edit."""
    # A line's hash is the sum of its words' hashes, each taken with the word's position. Without word
    # number i the words before it keep their positions and those behind it move up by one.
    at = lambda seed, shift: F.xxhash64(F.lit(seed), "word", F.col("pos") - shift).bitwiseAND(F.lit(_MASK))
    words = chosen.select(*_ID, F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    words = words.select(*_ID, "n", "pos", *(at(s, d).alias(f"w{s}{d}") for s in (1, 2) for d in (0, 1)))
    line = Window.partitionBy(*_ID).orderBy("pos")
    total = Window.partitionBy(*_ID)
    before, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    rest = lambda s: F.coalesce(F.sum(f"w{s}0").over(before), F.lit(0)) + F.sum(f"w{s}1").over(total) - F.sum(f"w{s}1").over(upto)
    variants = words.select(*_ID, "n", "pos", F.xxhash64(rest(1), rest(2)).alias("rest"))
    whole = words.groupBy(*_ID, "n").agg(F.xxhash64(F.sum("w10"), F.sum("w20")).alias("rest"))
    # Role 0: the line itself among lines that lose a word to become it; 1: such a line; 2: one that differs at pos.
    emitted = whole.select(*_ID, F.lit(0).alias("role"), F.xxhash64(F.lit("cut"), "n", "rest").alias("key"))
    emitted = emitted.unionByName(variants.select(*_ID, F.explode(F.array(F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit("cut"), F.col("n") - 1, F.col("rest")).alias("key")), F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit("same"), "n", "pos", "rest").alias("key")))).alias("x")).select(*_ID, "x.role", "x.key"))
    emitted = materialize(emitted.withColumn("turn", F.pmod("key", F.lit(turns)).cast("int")), f"{name}-variants", "turn")
    tidy(chosen.sparkSession)

    me = F.struct(*_ID)
    found = []
    for turn in range(turns):
        some = emitted.where(F.col("turn") == turn).drop("turn")
        group = some.groupBy("key").agg(F.min(F.when(F.col("role") == 1, me)).alias("longer"), F.min(F.when(F.col("role") != 1, me)).alias("other"), F.max(me).alias("last")).where("other IS NOT NULL AND (other < last OR longer < last)")
        met = some.join(group, "key").withColumn("winner", F.when(F.col("role") == 0, F.col("longer")).otherwise(F.col("other"))).where("winner IS NOT NULL").where(F.col("winner") < me)
        found.append(materialize(met.select(*_ID, *(F.col(f"winner.{c}").alias(f"w_{c}") for c in _ID)).distinct(), f"{name}-pairs"))
        tidy(chosen.sparkSession)
    discard(emitted)
    pairs = reduce(DataFrame.unionByName, found).distinct()

    a = chosen.select(*_ID, F.col("words").alias("a"))
    b = chosen.select(*(F.col(c).alias(f"w_{c}") for c in _ID), F.col("words").alias("b"))
    both = pairs.join(a, _ID).join(b, [f"w_{c}" for c in _ID])
    losers = materialize(both.where(within_one_edit("a", "b")).select(*_ID).distinct(), f"{name}-near")
    discard(*found)
    return losers


def within_one_edit(a: str, b: str) -> Column:
    """Whether one inserted, deleted or replaced word turns array a into array b (or they are equal)."""
    long, short = F.when(F.size(a) >= F.size(b), F.col(a)).otherwise(F.col(b)), F.when(F.size(a) >= F.size(b), F.col(b)).otherwise(F.col(a))
    gap = F.size(long) - F.size(short)
    differ = F.array_position(F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y), True).cast("int")
    same = F.when(differ == 0, F.size(short)).otherwise(differ - 1)  # equal words at the start
    tail = F.greatest(F.size(long) - same - 1, F.lit(0))
    replaced = F.slice(long, same + 2, tail) == F.slice(short, same + 2, tail)
    cut = F.slice(long, same + 2, tail) == F.slice(short, same + 1, tail)
    return F.when(gap == 0, (differ == 0) | replaced).when(gap == 1, cut).otherwise(F.lit(False))


def dedup_lines(docs: DataFrame, name: str = "lines", min_words: int = MIN_WORDS, counts: tuple[str, str, str] = ("n_lines", "n_removed", "n_near")) -> DataFrame:
    """documents with the kept lines as text, and three counts: lines with a word, those removed, those of them that were near.

    Lines without a word stay. A null text stays null, and a row with a null
    doc_id stays as it is; rows that are equal in id and text count as one, so
    each keeps what the first occurrence keeps. All columns of docs come back;
    a column that has the name of a count gives way to the count.
    """
    id_, hash_, gone_, near_, split_, text_ = free(docs, "id", "hash", "gone", "near", "split", "text")
    gone = removed_lines(docs.select("doc_id", "text"), name, min_words)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"), F.count_if("near").alias("near"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("gone").alias(gone_), F.col("near").alias(near_))
    joined = docs.join(gone, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split_) - 1), F.col(gone_))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(split_), i)), "\n"))
    counted = joined.withColumn(split_, F.split("text", "\n")).withColumn(text_, text)
    n_lines = F.coalesce(F.size(F.filter(split_, has_word)), F.lit(0))
    return counted.select(
        *(F.col(text_).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias(counts[0]),
        F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias(counts[1]),
        F.coalesce(near_, F.lit(0)).cast("long").alias(counts[2]),
    )
