"""Steps whose memory, or what they send the driver, must not grow faster than their input."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from codelens.operators import naive_bayes as NB
from codelens.plans import q_neighbours as QN


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_base_of_a_search_is_written_once(spark):
    assert "FileScan" not in plan(QN.recommendations(spark, SF_SMALL))
    assert "FileScan" not in plan(QN._trial_rows(spark, SF_SMALL))


def test_scoring_counts_words_in_their_row_and_deals_pairs_to_tasks(spark, monkeypatch):
    model = NB.fit(spark.createDataFrame([("cats purr", "cat"), ("dogs bark", "dog")], "text string, label string"), "text", "label")
    docs = spark.createDataFrame([(i, "cats cats bark") for i in range(50)] + [(7, "dogs purr"), (None, "cats"), (99, None)], "id long, text string")
    rows = lambda: sorted((str(r["id"]), r["pred_code"], r["score"], r["rank"]) for r in NB.score_top_n(model, docs, "id", "text", 2).collect())
    found = NB.score_top_n(model, docs, "id", "text", 2)
    assert "term" not in "".join(x for x in plan(found).split("\n") if "HashAggregate(keys" in x)
    assert "BroadcastHashJoin [id" not in plan(found)
    few = rows()
    monkeypatch.setattr(NB, "PAIRS_PER_TASK", 2)
    many = NB.score_top_n(model, docs, "id", "text", 2)
    assert many.rdd.getNumPartitions() > found.rdd.getNumPartitions() and rows() == few
    monkeypatch.setattr(NB, "BROADCAST_MAX_TERMS", 0)
    monkeypatch.setattr(NB, "BROADCAST_MAX_PAIRS", 0)
    assert rows() == few and len(few) == 2 * docs.count()
    assert {s for i, c, s, _ in few if i in ("None", "99") and c == "cat"} == {0.5}
