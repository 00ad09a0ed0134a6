"""TF-IDF with one row per document, and the relational naive Bayes."""

from __future__ import annotations

import collections
import math
import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from codelens.operators import naive_bayes as NB
from codelens.operators import tfidf as TF
from codelens.plans import q_ml
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table

ODD = [(1, "b a a b_a, B! ccc aa aa"), (2, None), (3, ""), (4, "é É éé ÉÉ éé\tx éé-éé"), (5, "aa " * 400 + "bb"), (6, "... !!! 12 3")]


def plain_bag(text: str | None, first: int) -> dict:
    words = re.split(r"[ \t\n\x0b\f\r]+", text or "")
    tokens = [t for t in re.split(r"[^a-zéÉ]+", (text or "").lower()) if len(t) >= 2]
    return {t: (n, [i for i, w in enumerate(words) if w == t][:first]) for t, n in collections.Counter(tokens).items()}


def test_bags_count_in_the_row(spark):
    docs = spark.createDataFrame(ODD, "id long, t string")
    rows = TF.bags(docs, "id", TF.word_tokens("t"), 3).collect()
    got = {r["id"]: {e["term"]: (e["tf"], e["places"]) for e in r["bag"]} for r in rows}
    assert got == {i: plain_bag(t, 3) for i, t in ODD}
    assert all([e["term"] for e in r["bag"]] == sorted(e["term"] for e in r["bag"]) for r in rows)


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_and_rows_move_once(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("t"))
    weights = final_plan(TF.tfidf(docs, "doc_id", "t"))
    assert weights.count("Exchange hashpartitioning") == weights.count("ObjectHashAggregate") // 2 > 0
    assert "FileScan" not in weights  # from the written bags on, no text is read
    condensed = final_plan(TF.condense(docs, "doc_id", "t"))
    assert "FileScan" not in condensed and "Window" not in condensed


def test_condense_and_summary_equal_the_forms_with_given_weights(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("t")).unionByName(
        spark.createDataFrame([(10**6 + i, t) for i, t in ODD], "doc_id long, t string")).where("t is not null")
    weights = TF.tfidf(docs, "doc_id", "t")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(TF.condense(docs, "doc_id", "t")) == rows(TF.condense_text(docs, "doc_id", "t", weights))
    assert rows(TF.summarise(docs, "doc_id", "t")) == rows(TF.extractive_summary(docs, "doc_id", "t", weights))


def test_weights_without_broadcast_are_the_same(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("t"))
    bag = TF.bags(docs, "doc_id", TF.plain_tokens("t"))
    flat = lambda b: sorted((r["doc_id"], t["term"], t["weight"]) for r in TF.weighted_bags(bag, "doc_id", broadcast=b).collect() for t in r["terms"])
    assert flat(True) == flat(False)


def test_a_text_without_a_word_has_the_zero_vector(spark):
    corpus = spark.createDataFrame([(1, "some words here"), (2, ""), (3, "7 ! 8")], "doc_id long, text string")
    rows = {r["doc_id"]: r["embedding"] for r in q_ml._text_vectors(corpus).collect()}
    assert set(rows) == {1, 2, 3} and any(rows[1]) and rows[2] == rows[3] == [0.0] * q_ml.DIMS


TRAIN = [("cats purr softly cats", "cat"), ("cats sleep", "cat"), ("dogs bark loudly", "dog"), ("", "dog"), (None, "fox"), ("no label", None)]


def plain_scores(text: str) -> dict:
    by = collections.defaultdict(list)
    for t, label in TRAIN:
        if label:
            by[label].append([w for w in (t or "").split() if w != "no"])
    vocabulary = {w for texts in by.values() for t in texts for w in t}
    n = sum(len(t) for t in by.values())
    out = {}
    for label, texts in by.items():
        counts = collections.Counter(w for t in texts for w in t)
        total = sum(counts.values()) + len(vocabulary)
        out[label] = math.log(len(texts) / n) + sum(math.log((counts[w] + 1) / total) for w in text.split() if w in vocabulary)
    return out


@pytest.mark.parametrize("text", ["cats bark", "dogs dogs sleep unknown", "", "unknown words alone"])
def test_naive_bayes_equals_the_formula(spark, text):
    model = NB.fit(spark.createDataFrame(TRAIN, "text string, label string"), "text", "label")
    docs = spark.createDataFrame([(1, text, "kept")], "id long, text string, extra string")
    rows = NB.score_top_n(model, docs, "id", "text", 5, keep=["extra"]).orderBy("rank").collect()
    want = plain_scores(text)
    top = max(want.values())
    share = {k: math.exp(v - top) / sum(math.exp(x - top) for x in want.values()) for k, v in want.items()}
    assert [r["pred_code"] for r in rows] == sorted(want, key=lambda k: (-round(want[k], 6), k))
    assert all(abs(r["score"] - share[r["pred_code"]]) < 1e-5 and r["extra"] == "kept" for r in rows)


def test_naive_bayes_odd_tables(spark, tmp_dir):
    train = spark.createDataFrame(TRAIN, "text string, label string")
    model = NB.fit(train, "text", "label")
    docs = spark.createDataFrame([(1, None), (2, "cats")], "id long, text string")
    assert NB.score_top_n(model, docs, "id", "text", 1).count() == 2
    assert NB.score_top_n(model, docs.where("1 = 0"), "id", "text", 1).count() == 0
    assert NB.score_top_n(NB.fit(train.where("1 = 0"), "text", "label"), docs, "id", "text", 1).count() == 0
    model.save(f"{tmp_dir}/model")
    again = NB.Model.load(spark, f"{tmp_dir}/model")
    rows = lambda m: sorted(tuple(r) for r in NB.score_top_n(m, docs, "id", "text", 3).collect())
    assert rows(model) == rows(again)


def test_held_out_accuracy_is_above_chance(spark):
    from codelens.plans import catalog

    catalog.load_all()
    rows = catalog.QUERIES["classifier_accuracy"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) >= 4 and sum(r["n_right"] for r in rows) / sum(r["n"] for r in rows) > 0.9


def test_fit_needs_no_matrix_on_the_driver(spark):
    model = NB.fit(q_ml.stacked_training(spark, SF_SMALL), "text", "label")
    docs = FX.company_text(spark, SF_SMALL).select("doc_id", "text")
    plan = NB.score_top_n(model, docs, "doc_id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cluster_vectors_are_the_own_weights(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from codelens.operators import ml as ML

    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").checkpoint()
    rows = ML.weighted_vectors(docs, "text", 50)
    got = {r["doc_id"]: sorted(round(float(x), 6) for x in r["_features"].values) for r in rows.collect()}
    want = collections.defaultdict(list)
    for r in TF.tfidf(docs, "doc_id", "text", max_features=50).collect():
        want[r["doc_id"]].append(r["weight"])
    assert {i: v for i, v in got.items() if v} == {i: sorted(v) for i, v in want.items()}
    clusters = ML.kmeans_clusters(docs, "text", k=4, vocab=50)
    assert clusters.count() == docs.count() and clusters.select("cluster").distinct().count() <= 4
    model = KMeans(featuresCol="_features", k=4, seed=0).fit(rows)
    again = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster")
    mine = clusters.join(rows.select("doc_id", "_features"), "doc_id")
    assert again.evaluate(mine) >= 0.99 * ClusteringEvaluator(featuresCol="_features").evaluate(model.transform(rows))


def test_cross_validation_uses_the_given_folds(spark):
    from codelens.operators import ml as ML
    from codelens.operators import split as S

    docs = S.with_fold(read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang"), "doc_id", 3).checkpoint()
    (_, accuracy), = ML.cross_validate(docs, "text", "lang", "fold", 3, [1.0], num_features=1 << 12)
    each = []
    for fold in range(3):
        model = ML.train_text_classifier(docs.where(F.col("fold") != fold), "text", "lang", num_features=1 << 12)
        top = ML.score_top_n(model, docs.where(F.col("fold") == fold), "doc_id", "text", 1, keep=["lang"])
        each.append(top.agg(F.avg((F.col("pred_code") == F.col("lang")).cast("int"))).first()[0])
    assert abs(accuracy - sum(each) / 3) < 1e-9


def test_cross_validation_reads_each_text_once(spark):
    from codelens.operators import ml as ML

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    rows = [(i, "apfel birne" if i % 2 else "pear apple", "de" if i % 2 else "en", i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, fold int").withColumn("text", read.asNondeterministic()("text"))
    found = ML.cross_validate(docs, "text", "lang", "fold", 3, [0.1, 1.0], num_features=1 << 10)
    assert [a for _, a in found] == [1.0, 1.0] and reads.value == 60


def test_only_rare_terms_are_shuffled_beyond_the_bound(spark, monkeypatch):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("t")).unionByName(
        spark.createDataFrame([(10**6 + i, t) for i, t in ODD], "doc_id long, t string"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(TF.tfidf(docs, "doc_id", "t"))
    monkeypatch.setattr(TF, "BROADCAST_MAX_TERMS", 200)
    threshold = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # nothing is broadcast for being small
    try:
        df = TF.tfidf(docs, "doc_id", "t")
        assert rows(df) == want
        # the frequent terms' idf is broadcast, their rows meet it where they are
        assert "BroadcastHashJoin" in final_plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)


def test_places_of_odd_texts(spark):
    odd = [*ODD, (7, " lead\u0001mark mark"), (8, "One two.  two THREE! \u0001 two? four"), (9, "ΣΑΣ σας Straße")]
    docs = spark.createDataFrame(odd, "id long, t string")
    words = {r["id"]: {e["term"]: (e["tf"], e["places"]) for e in r["bag"]} for r in TF.bags(docs, "id", TF.word_tokens("t"), None).collect()}
    assert words[7] == {"lead": (1, []), "mark": (2, [2])}
    assert words[9] == {"σας": (2, [1]), "straße": (1, [])}
    places = {r["id"]: {e["term"]: e["places"] for e in r["bag"]} for r in TF.bags(docs, "id", TF.sentence_tokens("t"), None).collect()}
    assert places[8] == {"one": [0], "two": [0, 1, 3], "three": [1], "four": [4]}
    assert places[2] == places[3] == {} and places[5] == {"aa": [0] * 400, "bb": [0]}


def test_one_score_a_sentence_meets_the_texts(spark):
    docs = spark.createDataFrame([(1, "aa bb aa. cc! 7. bb dd"), (2, ""), (3, None)], "id long, t string")
    found = TF._gathered(TF.bags(docs, "id", TF.sentence_tokens("t"), None), "id")
    (row,) = TF._place_sums(found, "id").collect()
    weight = {r["term"]: r["weight"] for r in TF.tfidf(docs, "id", "t").collect()}
    want = [(0, 2 * weight["aa"] + weight["bb"]), (1, weight["cc"]), (3, weight["bb"] + weight["dd"])]
    assert row["id"] == 1 and [(e["place"], e["w"]) for e in row["_each"]] == [(p, pytest.approx(w)) for p, w in want]
