"""Operator properties on literal tables and fixtures."""

from __future__ import annotations

import random

from conftest import SF_SMALL
from pyspark.sql import functions as F

from codelens.operators import judge as J
from codelens.operators import ranking as R
from codelens.operators import reconcile as RC
from codelens.operators import split as S
from codelens.operators import taxonomy as TX
from codelens.operators import tfidf as TF
from codelens.operators.neighbours import SIM_DECIMALS, nearest_neighbours
from codelens.sources import fixtures as FX


def cosine_join_form(query, ref, q_id, r_id, vec_col="embedding"):
    """All pairs as a join: the plain version of the neighbour search."""
    a = query.select(F.col(q_id).alias("_qid"), F.col(vec_col).cast("array<double>").alias("a"))
    b = ref.select(F.col(r_id).alias("_rid"), F.col(vec_col).cast("array<double>").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(F.transform("a", lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))
    nb = F.sqrt(F.aggregate(F.transform("b", lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))
    return a.crossJoin(b).select("_qid", "_rid", F.round(dot / (na * nb), SIM_DECIMALS).alias("sim"))


def test_reconcile_one_pass_equals_two_pass(spark):
    truth = spark.createDataFrame(
        [("ACME.", "01111"), ("ACME", None), ("BETA LTD.", "02222"), ("BETA LTD.", "01000"), ("GAMMA", "03333"),
         ("DELTA.", "04444"), ("DELTA", "05555")],
        "company string, ssic_code string")
    texts = spark.createDataFrame([("ACME",), ("BETA LTD",), ("GAMMA",), ("DELTA",), ("ZETA",)], "company string")
    one = {r["company"]: r["ssic_code"] for r in RC.reconcile(texts, truth).collect()}
    # two-pass: exact match, then re-match the misses on the stripped truth names
    exact = RC.name_lookup(truth)
    first = texts.join(exact, "company", "left")
    loose = RC.name_lookup(truth, strip_dot=True)
    second = first.where(F.col("ssic_code").isNull()).drop("ssic_code").join(loose, "company", "left")
    two = {r["company"]: r["ssic_code"] for r in first.where(F.col("ssic_code").isNotNull()).unionByName(second).collect()}
    assert one == two
    assert one == {"ACME": "01111", "BETA LTD": "01000", "GAMMA": "03333", "DELTA": "05555", "ZETA": None}


def test_split_disjoint_and_complete(spark):
    df = FX.company_text(spark, SF_SMALL)
    train, test = S.train_test_split(df, "company", 70)
    a = {r[0] for r in train.select("company").collect()}
    b = {r[0] for r in test.select("company").collect()}
    assert not (a & b)
    assert len(a) + len(b) == df.select("company").distinct().count()
    anti = {r[0] for r in S.anti_split_test(df, train, "company").select("company").collect()}
    assert anti == b


def test_top_k_within_equals_sort_then_limit(spark):
    rows = [(g, i, random.Random(g * 100 + i).randint(0, 5)) for g in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, i int, s int")
    top = R.top_k_within(df, ["g"], [F.col("s").desc(), F.col("i")], 3)
    got = sorted((r["g"], r["i"]) for r in top.collect())
    want = []
    for g in range(5):
        grp = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:3]
        want += [(g, r[1]) for r in grp]
    assert got == sorted(want)


def test_top_rows_distributed_path_equals_limit(spark, monkeypatch):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 7).alias("s"))
    order = [F.col("s").desc(), F.col("id")]
    small = [tuple(r) for r in R.top_rows(df, 123, order).collect()]
    monkeypatch.setattr(R, "SMALL_TOP_K", 10)
    big = [tuple(r) for r in R.top_rows(df, 123, order).collect()]
    assert sorted(small) == sorted(big) and len(big) == 123


def test_dedupe_keeps_smallest_order(spark):
    df = spark.createDataFrame([("t", 3, "c"), ("t", 1, "a"), ("u", 2, "b")], "text string, k int, v string")
    out = {r["text"]: (r["k"], r["v"]) for r in R.dedupe(df, ["text"], order="k").collect()}
    assert out == {"t": (1, "a"), "u": (2, "b")}


def test_blocked_knn_equals_join_form(spark):
    rnd = random.Random(7)
    q = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    r = [(1000 + i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(90)]
    r += [(2000, r[0][1]), (2001, r[0][1])]  # exact ties
    qd = spark.createDataFrame(q, "qid long, embedding array<double>")
    rd = spark.createDataFrame(r, "rid long, embedding array<double>")
    k = 5
    blocked = nearest_neighbours(qd, rd, k, "qid", "rid", block_rows=16, min_query_blocks=3)
    got = sorted((x["qid"], x["rid"], x["nb_rank"]) for x in blocked.collect())
    pairs = cosine_join_form(qd, rd, "qid", "rid").collect()
    want = []
    for qi in range(60):
        c = sorted([p for p in pairs if p["_qid"] == qi], key=lambda p: (-p["sim"], p["_rid"]))[:k]
        want += [(qi, p["_rid"], n + 1) for n, p in enumerate(c)]
    assert got == sorted(want)


def test_knn_by_group_stays_in_group(spark):
    rows = [(t, i, [float(i % 3), 1.0, float(t)]) for t in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "trial int, id long, embedding array<double>")
    nb = nearest_neighbours(df, df.withColumnRenamed("id", "rid"), 2, "id", "rid", by=["trial"])
    assert nb.count() == 40
    assert nb.where(F.col("trial").isNull()).count() == 0


def test_scores(spark):
    df = spark.createDataFrame(
        [(1, "A", 1, "A", "B"), (1, "B", 2, "A", "B"), (2, "C", 1, "A", None), (2, "A", 4, "A", None),
         (3, "X", 1, "A", "B")],
        "e int, code string, rank int, p string, s string")
    out = {r["e"]: r for r in J.judge_entities(df, "e", "code", "rank", "p", "s", 15, 3).collect()}
    assert (out[1]["score"], out[1]["score2"], out[1]["t_score"], out[1]["within_top_n"]) == (0.0, 0.1, 0.03, "Y")
    assert (out[2]["score"], out[2]["score2"], out[2]["t_score"], out[2]["within_top_n"]) == (0.27, None, 0.27, "N")
    assert (out[3]["score"], out[3]["score2"], out[3]["t_score"]) == (1.0, 1.0, 1.0)
    for r in out.values():
        assert 0.0 <= r["t_score"] <= 1.0


def test_split_bullets_keeps_null_lists(spark):
    df = spark.createDataFrame([("A", "•01 x\n•02 y"), ("B", None)], "code string, groups string")
    rows = TX.split_bullets(df, "groups").select("code", "item").collect()
    assert [(r["code"], r["item"]) for r in rows] == [("A", "01 x"), ("A", "02 y"), ("B", None)]


def test_flatten_is_one_row_per_subclass(spark):
    flat = TX.flatten(FX.dictionary(spark, SF_SMALL))
    n = flat.count()
    assert n == flat.select("code").distinct().count()
    assert flat.where(F.col("section").isNull()).count() == 0


def test_tfidf_weights_are_unit_norm(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry date")],
                                 "doc_id long, t string")
    w = TF.tfidf(docs, "doc_id", "t")
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    for r in norms:
        assert abs(r["n"] - 1.0) < 1e-5
    cond = {r["doc_id"]: r["condensed"] for r in TF.condense_text(docs, "doc_id", "t", w, 0.5).collect()}
    assert cond[1] == "apple apple"


def test_level_counts_cover_every_level(spark):
    flat = TX.flatten(FX.dictionary(spark, SF_SMALL))
    counts = {r["level"]: r["s"] for r in TX.level_counts(flat).groupBy("level").agg(F.sum("n").alias("s")).collect()}
    n = flat.count()
    assert counts == {lvl: n for lvl in ("Section", "Division", "Group", "Class", "Sub-class")}


def test_seeded_ml_is_repeatable(spark):
    import __spark_entry__ as E

    q = E.queries()
    for name in ("kmeans_pages", "score_companies"):
        a = sorted(tuple(r) for r in q[name](spark, SF_SMALL).collect())
        b = sorted(tuple(r) for r in q[name](spark, SF_SMALL).collect())
        assert a == b, name
    labels = {r["pred_code"] for r in q["score_companies"](spark, SF_SMALL).collect()}
    divisions = {r[0] for r in TX.flatten(FX.dictionary(spark, SF_SMALL)).select("division").distinct().collect()}
    assert labels <= divisions


def test_knn_skips_null_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, embedding array<double>")
    r = spark.createDataFrame([(10, [1.0, 0.1]), (11, None), (12, [0.0, 1.0])], "rid long, embedding array<double>")
    out = [(x["qid"], x["rid"]) for x in nearest_neighbours(q, r, 5, "qid", "rid").orderBy("nb_rank").collect()]
    assert out == [(1, 10), (1, 12)]


def test_tfidf_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    docs = FX.company_text(spark, SF_SMALL).select("doc_id", F.col("text").alias("t"))
    small = sorted(tuple(r) for r in TF.tfidf(docs, "doc_id", "t").collect())
    monkeypatch.setattr(TF, "BROADCAST_MAX_TERMS", 0)  # vocabulary "too large": shuffle join by term
    df = TF.tfidf(docs, "doc_id", "t")
    assert sorted(tuple(r) for r in df.collect()) == small


def test_neighbour_payload_keeps_large_nullable_integers(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 9007199254740993), (2, [0.0, 1.0], None)], "qid long, embedding array<double>, big long")
    r = spark.createDataFrame([(7, [1.0, 0.1], -9007199254740993), (8, [0.0, 1.0], None)], "rid long, embedding array<double>, other long")
    got = nearest_neighbours(q, r, 1, "qid", "rid", q_payload=["big"], r_payload=["other"])
    assert dict(got.dtypes)["big"] == "bigint"
    assert sorted((x.qid, x.big, x.other) for x in got.collect()) == [(1, 9007199254740993, -9007199254740993), (2, None, None)]


def test_rank_runs_over_all_documents_of_a_company(spark):
    from codelens.operators import recommend as RM

    test = spark.createDataFrame([(1, "c", "11111", [1.0, 0.0]), (2, "c", "11111", [0.0, 1.0])], "id long, company string, code string, embedding array<double>")
    train = spark.createDataFrame([(i, f"t{i}", f"2222{i}", [1.0, 0.2 * i]) for i in range(3)], "id long, company string, code string, embedding array<double>")
    got = RM.recommend(train, test, 2, "id", "company", "code").orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 2, 3, 4] and [x.score for x in got] == sorted((x.score for x in got), reverse=True)


def test_duplicate_counts_of_an_empty_table(spark):
    from codelens.operators import profile as PR

    row = PR.duplicate_counts(spark.createDataFrame([], "a string, b int"), ["a", "b"]).first()
    assert (row.dup_a, row.dup_b) == (0, 0)


def test_summary_keeps_documents_without_text(spark):
    from codelens.operators import tfidf as TF

    docs = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "")], "doc_id long, t string")
    got = {x.doc_id: x.summary for x in TF.extractive_summary(docs, "doc_id", "t", TF.tfidf(docs, "doc_id", "t")).collect()}
    assert got == {1: "One two. Three four.", 2: "", 3: ""}


def test_classifier_tells_held_out_languages_apart_and_survives_saving(spark, tmp_dir):
    from codelens.operators import ml as ML
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    train, test = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    model = ML.train_text_classifier(train, "text", "lang")
    top = ML.score_top_n(model, test, "doc_id", "text", 1, keep=["lang"])
    shares = top.agg(F.avg((F.col("pred_code") == F.col("lang")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert shares.n > 50 and shares.right > 0.9, "chance is the largest language's share, about 0.6"
    ML.save_model(model, f"{tmp_dir}/model")
    again = ML.score_top_n(ML.load_model(f"{tmp_dir}/model"), test, "doc_id", "text", 1, keep=["lang"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, top.collect()))


def test_union_stacks_every_part(spark):
    from codelens.sources import fixtures as FX
    from conftest import SF_SMALL

    assert FX.index(spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/part.parquet").count()
