"""What the deduplicators leave on disk while they run."""

import re

from factmill.llm import neardup
from factmill.llm.common import tidy


def test_tidy_drops_the_shuffle_of_a_finished_step(spark):
    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    mine = spark.sparkContext._jsc.sc().newShuffleId() + 1  # the one after an id that nothing uses
    spark.range(1000).repartition(3, "id").write.format("noop").mode("overwrite").save()
    assert held.contains(mine)
    tidy(spark)
    assert not held.contains(mine)


def test_jaccard_texts_are_shuffled_in_slices(spark, monkeypatch):
    parts, write = [], neardup.materialize

    def note(df, name, *by):
        out = write(df, name, *by)
        if name.endswith("-texts"):
            parts.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", note)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k}" for k in range(1, 30))) for i in range(1, 41)], "doc_id long, text string")
    assert neardup.link(docs, neardup.Similarity(words=4, percent=85, passes=2)).count() == 40
    assert len(parts) == 2 and sum(parts) == 40 and max(parts) < 40


def test_jaccard_groups_are_shuffled_once_for_both_sides(spark):
    """The members of a group meet one another; their rows with sketches are the largest of that step."""
    live = spark.createDataFrame([(7, 1, 5, 11, 1), (7, 2, 5, 12, 2)], "key long, doc_id long, n long, set_hash long, component long")
    sketch = spark.createDataFrame([(1, 11, [3, 0]), (2, 12, [3, 0])], "doc_id long, set_hash long, sketch array<long>")
    state = neardup._State(None, None, sketch, neardup.Similarity(words=4, percent=85), "test")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = state.within(live)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"- Exchange hashpartitioning\(key#", plan)) == 1, plan
        assert [tuple(r) for r in met.collect()] == [(2, 1)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
