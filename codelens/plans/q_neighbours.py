"""Registered nearest-document recommender queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import codes as C
from codelens.functions import text as X
from codelens.operators import recommend as RM
from codelens.operators import reconcile as RC
from codelens.operators import split as S
from codelens.plans import judge as PJ
from codelens.plans.catalog import register
from codelens.plans.oracle import bucket_sql, cosine_sql, with_views
from codelens.plans.q_judge import _RANKED_CTES
from codelens.plans.q_taxonomy import FLAT_CTES
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table

K_RECOMMEND = 5
TRAIN_PCT = 70
TRIALS = 10
FOLDS = 5


def recommend_base(spark, sf_dir):
    """(vec_id, company, ssic_code, embedding): document vectors of companies
    whose name reconciles to a declared code (code padded, text present)."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # only the presence of text is needed: project it to a flag before any shuffle
    ct = FX.company_text(spark, sf_dir, {"has_text": F.col("text").isNotNull()})
    b = v.join(ct, v.vec_id == ct.doc_id).drop("doc_id")
    b = RC.reconcile(b, FX.truth(spark, sf_dir))
    b = b.where(F.col("ssic_code").isNotNull() & F.col("has_text"))
    b = b.select("vec_id", "company", C.pad_code("ssic_code").alias("ssic_code"), "embedding")
    # written once: every step of a search reads it, and each would run the joins, and send
    # the driver what they broadcast, again
    return b.checkpoint(eager=True)


def _split(base, seed=None):
    train, _ = S.train_test_split(base, "company", TRAIN_PCT, seed)
    test = S.anti_split_test(base, train, "company")
    return train, test


def recommendations(spark, sf_dir, k=K_RECOMMEND):
    base = recommend_base(spark, sf_dir)
    train, test = _split(base)
    test = test.checkpoint(eager=True)
    return RM.recommend(train, test, k, "vec_id", "company", "ssic_code")


_BASE_CTES = (
    ("ex", "SELECT company, min(ssic_code) AS c1 FROM truth WHERE ssic_code IS NOT NULL GROUP BY company"),
    ("lo", "SELECT regexp_replace(company, '\\.\\z', '') AS company, min(ssic_code) AS c2 FROM truth "
           "WHERE ssic_code IS NOT NULL GROUP BY 1"),
    ("base0", "SELECT e.vec_id, e.embedding, c.company, c.text, coalesce(ex.c1, lo.c2) AS code "
              "FROM embeddings e JOIN company_text c ON e.vec_id = c.doc_id "
              "LEFT JOIN ex ON c.company = ex.company LEFT JOIN lo ON c.company = lo.company"),
    ("base", "SELECT vec_id, company, CASE WHEN length(code) < 5 THEN lpad(code, 5, '0') ELSE code END AS ssic_code, "
             "CAST(embedding AS DOUBLE[]) AS e FROM base0 WHERE code IS NOT NULL AND text IS NOT NULL"),
)


def _rec_ctes(k=K_RECOMMEND):
    return _BASE_CTES + (
        ("tr", f"SELECT * FROM base WHERE {bucket_sql('company')} < {TRAIN_PCT}"),
        ("te", "SELECT * FROM base WHERE company NOT IN (SELECT company FROM tr)"),
        ("pairs", f"SELECT te.vec_id, te.company, te.ssic_code AS actual_code, tr.vec_id AS ref_id, "
                  f"tr.ssic_code AS rec_code, {cosine_sql('te.e', 'tr.e')} AS score FROM te CROSS JOIN tr"),
        ("nb", f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ref_id) AS nb_rank "
               f"FROM pairs QUALIFY nb_rank <= {k}"),
        ("recs", "SELECT company, actual_code, rec_code, score, "
                 "CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, vec_id, nb_rank) AS INTEGER) AS rank FROM nb"),
    )


def _rec_sql(body, k=K_RECOMMEND, *extra):
    return with_views(["truth", "company_text"], *_rec_ctes(k), *extra, body=body)


@register("nearest_documents", _rec_sql("SELECT * FROM recs"))
def nearest_documents(spark, sf_dir):
    """Top-5 most similar training documents per test document, with codes."""
    return recommendations(spark, sf_dir)


@register("recommend_eval", _rec_sql("""
    SELECT company, substr(actual_code, 1, 2) AS actual_ssic, substr(rec_code, 1, 2) AS rec_ssic, score, rank,
           CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER) AS match FROM recs"""))
def recommend_eval(spark, sf_dir):
    """Whole recommender job on the given vectors: reconcile names to codes,
    pad, hash split by company, anti-join test, top-5 neighbours, rank, and the
    Division match flag per recommendation."""
    r = recommendations(spark, sf_dir)
    return r.select(
        "company",
        F.substring("actual_code", 1, 2).alias("actual_ssic"),
        F.substring("rec_code", 1, 2).alias("rec_ssic"),
        "score", "rank",
        RM.match_flag(F.col("actual_code"), F.col("rec_code"), 2).alias("match"),
    )


@register("match_flag", _rec_sql("SELECT company, rec_code, rank, "
    "CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER) AS match FROM recs"))
def match_flag(spark, sf_dir):
    r = recommendations(spark, sf_dir)
    return r.select("company", "rec_code", "rank", RM.match_flag(F.col("actual_code"), F.col("rec_code"), 2).alias("match"))


_ACC_SQL = """SELECT count(*) AS n_entities, round(avg(m), 6) AS accuracy, round(avg(mc), 6) AS accuracy_code
    FROM (SELECT company, max(CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER)) AS m,
                 max(CAST(actual_code = rec_code AS INTEGER)) AS mc FROM recs GROUP BY company) x"""


@register("match_accuracy", _rec_sql(_ACC_SQL))
def match_accuracy(spark, sf_dir):
    return RM.match_accuracy(recommendations(spark, sf_dir), "company")


@register("hit_rate", _rec_sql("""
    SELECT round(avg(hit) * 100, 6) AS hit_rate
    FROM (SELECT company, max(CASE WHEN substr(rec_code, 1, 2) = substr(actual_code, 1, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit
          FROM recs GROUP BY company) x"""))
def hit_rate(spark, sf_dir):
    """% of companies whose declared Division is in their recommendation list."""
    r = recommendations(spark, sf_dir)
    hit = RM.match_flag(F.col("actual_code"), F.col("rec_code"), 2).cast("double")
    per = r.groupBy("company").agg(F.max(hit).alias("hit"))
    return per.agg(F.round(F.avg("hit") * 100, 6).alias("hit_rate"))


@register("recommendation_stats", _rec_sql("""
    SELECT company, round(avg(d), 1) AS mean, round(stddev_samp(d), 1) AS std
    FROM (SELECT company, TRY_CAST(substr(rec_code, 1, 2) AS BIGINT) AS d FROM recs) x GROUP BY company"""))
def recommendation_stats(spark, sf_dir):
    return RM.recommendation_stats(recommendations(spark, sf_dir), "company")


@register("overall_stats", _rec_sql("""
    SELECT round(avg(m), 6) AS mean_of_means, round(avg(s), 6) AS mean_of_stds, round(sum(ss) / sum(n), 6) AS mean_score
    FROM (SELECT company, avg(d) AS m, stddev_samp(d) AS s, sum(score) AS ss, count(*) AS n
          FROM (SELECT company, score, TRY_CAST(substr(rec_code, 1, 2) AS BIGINT) AS d FROM recs) x GROUP BY company) y"""))
def overall_stats(spark, sf_dir):
    return RM.overall_stats(recommendations(spark, sf_dir), "company")


@register("best_row_per_company", _rec_sql("""
    SELECT * FROM (SELECT company, actual_code, rec_code, score, rank,
             CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER) AS match,
             CAST(actual_code = rec_code AS INTEGER) AS match_code FROM recs) x
    QUALIFY row_number() OVER (PARTITION BY company ORDER BY match DESC, rank) = 1"""))
def best_row_per_company(spark, sf_dir):
    return RM.best_row_per_entity(recommendations(spark, sf_dir), "company")


@register("top_k_after_dedupe", _rec_sql("""
    SELECT company, actual_code, rec_code, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, rec_code) AS INTEGER) AS rank
      FROM (SELECT company, actual_code, rec_code, max(score) AS score FROM recs
            GROUP BY company, actual_code, rec_code) x) y
    WHERE rank <= 3""", 50))
def top_k_after_dedupe(spark, sf_dir):
    """Take 50 neighbours, keep the best per (company, code), re-rank, keep 3."""
    return RM.top_k_after_dedupe(recommendations(spark, sf_dir, k=50), "company", 3).select(
        "company", "actual_code", "rec_code", "score", "rank")


@register("top_predictions", _rec_sql("SELECT * FROM recs ORDER BY score DESC, company, rank LIMIT 15"))
def top_predictions(spark, sf_dir):
    """The 15 strongest recommendations overall (a top-k report)."""
    return recommendations(spark, sf_dir).orderBy(F.col("score").desc(), "company", "rank").limit(15)


@register("describe_recommendations", with_views(["truth", "company_text", "dictionary"], *_rec_ctes(), *FLAT_CTES,
    ("descr", "SELECT code, title || '.' || definition || '.' || examples AS text FROM flat"),
    body="""SELECT r.company, r.actual_code, r.rec_code, r.score, r.rank,
                   coalesce(a.text, '') AS actual_description, coalesce(b.text, '') AS rec_description
            FROM recs r LEFT JOIN descr a ON r.actual_code = a.code LEFT JOIN descr b ON r.rec_code = b.code"""))
def describe_recommendations(spark, sf_dir):
    """Text of the declared and the recommended code next to each row; codes
    without a description get ''. Descriptions are one row per code but of any
    length: AQE broadcasts them if their measured bytes are few."""
    from codelens.operators import taxonomy as TX

    f = TX.flatten(FX.dictionary(spark, sf_dir))
    d = f.select("code", X.build_description(F.col("title"), F.col("definition"), F.col("examples")).alias("text"))
    r = recommendations(spark, sf_dir)
    a = d.select(F.col("code").alias("actual_code"), F.col("text").alias("actual_description"))
    b = d.select(F.col("code").alias("rec_code"), F.col("text").alias("rec_description"))
    out = r.join(a, "actual_code", "left").join(b, "rec_code", "left")
    return out.select("company", "actual_code", "rec_code", "score", "rank",
                      F.coalesce("actual_description", F.lit("")).alias("actual_description"),
                      F.coalesce("rec_description", F.lit("")).alias("rec_description"))


# ---- repeated trials and folds: one job each, keyed by trial / fold

def _trial_rows(spark, sf_dir):
    base = recommend_base(spark, sf_dir)
    return S.with_trials(base, "company", TRIALS, TRAIN_PCT, packed=True)


@register("repeat_trials", with_views(["truth", "company_text"], *_BASE_CTES,
    ("tb", f"SELECT t.trial, b.*, CAST(('0x' || substr(md5(b.company || '#' || CAST(t.trial AS VARCHAR)), 1, 7)) AS BIGINT) "
           f"% 100 < {TRAIN_PCT} AS is_train FROM base b CROSS JOIN (SELECT CAST(unnest(range(1, {TRIALS + 1})) AS INTEGER) AS trial) t"),
    ("pairs", f"SELECT q.trial, q.vec_id, q.company, q.ssic_code AS actual_code, r.vec_id AS ref_id, "
              f"r.ssic_code AS rec_code, {cosine_sql('q.e', 'r.e')} AS score "
              f"FROM tb q JOIN tb r ON q.trial = r.trial AND NOT q.is_train AND r.is_train"),
    ("recs", f"SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY trial, vec_id ORDER BY score DESC, ref_id) <= {K_RECOMMEND}"),
    ("acc", """SELECT trial, count(*) AS n_entities, round(avg(m), 6) AS accuracy FROM (
                 SELECT trial, company, max(CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER)) AS m
                 FROM recs GROUP BY trial, company) x GROUP BY trial"""),
    body="SELECT trial, n_entities, accuracy, round(avg(accuracy) OVER (), 6) AS mean_accuracy FROM acc"))
def repeat_trials(spark, sf_dir):
    """Ten seeded train/test splits scored in one job; accuracy per trial and
    their mean (no keep-until-good loop). A vector is one row with its trials."""
    from pyspark.sql import Window

    t = _trial_rows(spark, sf_dir)
    train = t.where(F.size("train_trials") > 0).withColumnRenamed("train_trials", "trial")
    test = t.where(F.size("test_trials") > 0).withColumnRenamed("test_trials", "trial")
    recs = RM.recommend(train, test, K_RECOMMEND, "vec_id", "company", "ssic_code", by=["trial"])
    acc = RM.match_accuracy(recs, "company", by=["trial"]).select("trial", "n_entities", "accuracy")
    # the window spans one row per trial (ten rows)
    return acc.withColumn("mean_accuracy", F.round(F.avg("accuracy").over(Window.partitionBy()), 6))


@register("cross_validate", with_views(["truth", "company_text"], *_BASE_CTES,
    ("fb", f"SELECT *, {bucket_sql('company', buckets=FOLDS)} AS fold FROM base"),
    ("pairs", f"SELECT q.fold, q.vec_id, q.company, q.ssic_code AS actual_code, r.vec_id AS ref_id, "
              f"r.ssic_code AS rec_code, {cosine_sql('q.e', 'r.e')} AS score FROM fb q JOIN fb r ON q.fold <> r.fold"),
    ("recs", f"SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY fold, vec_id ORDER BY score DESC, ref_id) <= {K_RECOMMEND}"),
    ("acc", """SELECT fold, count(*) AS n_entities, round(avg(m), 6) AS accuracy FROM (
                 SELECT fold, company, max(CAST(substr(actual_code, 1, 2) = substr(rec_code, 1, 2) AS INTEGER)) AS m
                 FROM recs GROUP BY fold, company) x GROUP BY fold"""),
    body="SELECT fold, n_entities, accuracy, round(avg(accuracy) OVER (), 6) AS mean_accuracy FROM acc"))
def cross_validate(spark, sf_dir):
    """5-fold evaluation: each fold is scored against the other four, all
    folds in one job (training rows are replicated to the 4 folds they serve)."""
    from pyspark.sql import Window

    base = S.with_fold(recommend_base(spark, sf_dir), "company", FOLDS)
    test = base
    train = base.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where(F.col("_f") != F.col("fold"))
    train = train.drop("fold").withColumnRenamed("_f", "fold")
    recs = RM.recommend(train, test, K_RECOMMEND, "vec_id", "company", "ssic_code", by=["fold"])
    acc = RM.match_accuracy(recs, "company", by=["fold"]).select("fold", "n_entities", "accuracy")
    return acc.withColumn("mean_accuracy", F.round(F.avg("accuracy").over(Window.partitionBy()), 6))


# ---- scores on the flagship's ranked candidates

@register("softmax_scores", with_views(["vectors"], *_RANKED_CTES, body="""
    SELECT vec_id, code, sim, rank, round(ex / sum(ex) OVER (PARTITION BY vec_id), 6) AS prob
    FROM (SELECT *, exp(sim - max(sim) OVER (PARTITION BY vec_id)) AS ex FROM ranked) x"""))
def softmax_scores(spark, sf_dir):
    r = PJ.ranked_candidates(spark, sf_dir).select("vec_id", "code", "sim", "rank")
    return RM.softmax(r, "vec_id", "sim")


@register("class_weighted_scores", with_views(["vectors"], *_RANKED_CTES,
    ("wt", "SELECT DISTINCT label AS code, CASE WHEN label % 4 = 0 THEN 0.5 ELSE 1.0 END AS weight FROM embeddings"),
    body="SELECT r.vec_id, r.code, r.sim, r.sim * CAST(coalesce(w.weight, 1.0) AS DOUBLE) AS weighted_score "
         "FROM ranked r LEFT JOIN wt w ON r.code = w.code"))
def class_weighted_scores(spark, sf_dir):
    """Scores times a per-class weight (classes derived from the labels:
    every fourth class down-weighted to 0.5)."""
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("code")).distinct()
    weights = labels.select("code", F.when(F.col("code") % 4 == 0, F.lit(0.5)).otherwise(F.lit(1.0)).alias("weight"))
    r = PJ.ranked_candidates(spark, sf_dir).select("vec_id", "code", "sim")
    return RM.class_weighted(r, weights, "code", "sim").select("vec_id", "code", "sim", "weighted_score")
