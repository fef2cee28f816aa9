"""The stages one after the other, on given rows and on odd ones."""

import corpus_pipeline
from pyspark.sql import functions as F

from factmill.llm import langid


def test_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    real.write.parquet(f"{folder}/documents.parquet")
    df, sizes = real, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, folder)
        assert out.columns == real.columns, name
        out.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        sizes.append(df.count())
    told = langid.predict(real, langid.train(real))
    assert sizes[0] == told.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).count()
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    packed = corpus_pipeline.STAGES[4][1](spark, df, folder)
    assert packed.select("doc_id", "piece").where("piece = 0").count() == sizes[3]


def test_odd_rows(spark, docs, empty):
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = stage(spark, df, "").persist()
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert df.count() > 0
    df = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0


CLASHING = ("__nth", "__rank", "__words", "__copy", "__lang_pred", "__score", "__ambiguous", "__size", "__id", "copies", "size", "block")


def test_columns_of_the_callers_come_back(spark):
    text = "the quick brown fox and the lazy dog are both here again today "
    rows = [(i, text * (1 + i % 3), "en", "ab"[i % 2], 5, *(f"{c}{i}" for c in CLASHING)) for i in range(12)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == names, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING), name


def test_ties_are_broken_alike_in_any_layout(spark):
    """Rows of one id and text that differ in source: one stays, and the mix after it is the same."""
    rows = [(i % 6, f"some words of text number {i % 6} and more of them here", "en", f"s{i}", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = []
    for layout in (docs.coalesce(1), docs.orderBy("n_chars", ascending=False).repartition(5), docs.repartition(3, "source")):
        once = corpus_pipeline.near_duplicate_stage(spark, layout, "").persist()
        mixed = corpus_pipeline.mix_stage(spark, layout, "")
        found.append((sorted(map(tuple, once.collect())), sorted(map(tuple, mixed.collect()))))
    assert found[0] == found[1] == found[2] and len(found[0][0]) < 30
