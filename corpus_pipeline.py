"""The training-corpus pipeline: language ID, line dedup, near-duplicate documents, mixing, packing.

Each stage takes all that its predecessor kept and returns the columns of
documents, but for the last, which returns packed pieces. Missing texts, ids
and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.llm import langid, lines, mixing, neardup, packing
from factmill.llm.common import free, materialize

#: Below this share the nearest codeword is a guess; such documents are rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or without a clear codeword go."""
    lang, score, ambiguous = free(docs, "lang_pred", "score", "ambiguous")
    told = langid.annotate(docs, langid.train(docs), (lang, score, ambiguous))
    return told.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their kept lines; one that loses every line goes."""
    counts = free(docs, "n_lines", "n_removed", "n_near")
    kept = lines.dedup_lines(docs, counts=tuple(counts)).where(F.col(counts[1]) < F.greatest(counts[0], F.lit(1)))
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows equal in id and text are one document, of which the row least in all
    columns stays, in any layout; rows without an id stay.
    """
    linked = neardup.link(docs).where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(linked, "doc_id", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    (nth,) = free(docs, "nth")
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(F.col(f"`{c}`") for c in sorted(docs.columns))))
    once = kept.where("doc_id IS NOT NULL").withColumn(nth, first).where(F.col(nth) == 1).select(*columns)
    return once.unionByName(kept.where("doc_id IS NULL").select(*columns))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: The first stage is a trained model and the last a packing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
