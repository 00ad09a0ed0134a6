"""Registered text-classifier queries: naive Bayes as counts, joins and sums, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelens.functions import text as X
from codelens.functions.codes import code_prefix
from codelens.operators import judge as J
from codelens.operators import naive_bayes as NB
from codelens.operators import split as S
from codelens.operators import taxonomy as TX
from codelens.operators import tfidf as TF
from codelens.plans import q_ml as M
from codelens.plans.catalog import register
from codelens.plans.oracle import bucket_sql, clean_sql, exp_score_sql, preprocess_domain_sql, with_views
from codelens.plans.q_judge import _judged_sql
from codelens.plans.q_taxonomy import FLAT_CTES
from codelens.plans.q_tfidf import CONDENSE_CTES, _tfidf_ctes
from codelens.session import shared_path
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table

TRAIN_PCT = 70
TOP_N = 3
TOP_N_PREDICTIONS = 15
VIEWS = ["truth", "company_text", "dictionary", "index_entries"]


def _training_sql(label: str = "Division") -> tuple[tuple[str, str], ...]:
    """(code, text, label) of the dictionary and of both together, as the training tables of ``q_ml``."""
    of_code = "substr(code, 1, 2)" if label == "Division" else "section"
    index = f"SELECT code, {clean_sql('definition')} AS text"
    if label == "Division":
        entries = f"{index}, substr(code, 1, 2) AS label FROM index_entries"
    else:
        entries = (f"{index}, s.section AS label FROM index_entries i "
                   "JOIN (SELECT DISTINCT division, section FROM flat) s ON substr(i.code, 1, 2) = s.division")
    return (
        ("described", f"SELECT code, title || '.' || {clean_sql('definition')} || '.' || {clean_sql('examples')} AS text, {of_code} AS label FROM flat"),
        ("stacked", f"SELECT * FROM described WHERE label IS NOT NULL UNION ALL {entries}"),
    )


def _fit(spark, sf_dir, level="Division"):
    return NB.fit(M.stacked_training(spark, sf_dir, level), "text", "label")


@register("train_text_classifier", with_views(VIEWS, *FLAT_CTES, *_training_sql(),
    ("learned", f"SELECT text, label FROM stacked WHERE {bucket_sql('code')} < {TRAIN_PCT}"),
    ("held", f"SELECT * FROM described WHERE label IS NOT NULL AND {bucket_sql('code')} >= {TRAIN_PCT}"),
    *NB.fit_sql("learned"), *NB.score_sql("held", "code", "text", 1),
    body="SELECT h.code, h.label, t.label AS pred_code, t.score FROM held h JOIN nb_top t ON h.code = t.code"))
def train_text_classifier(spark, sf_dir):
    """Fit the Division classifier on 70% of the codes; predictions for the dictionary rows of the others."""
    learned, _ = S.train_test_split(M.stacked_training(spark, sf_dir), "code", TRAIN_PCT)
    _, held = S.train_test_split(M.training_table(spark, sf_dir), "code", TRAIN_PCT)
    return NB.score_top_n(NB.fit(learned, "text", "label"), held, "code", "text", 1, keep=["label"]).drop("rank")


@register("score_companies", with_views(VIEWS, *FLAT_CTES, *_training_sql(), *NB.fit_sql("stacked"),
    *NB.score_sql("company_text", "doc_id", "text", TOP_N),
    body="""SELECT t.doc_id, c.company, t.label AS pred_code, t.score, t.rank, d.division_title
            FROM nb_top t JOIN company_text c ON t.doc_id = c.doc_id LEFT JOIN tx_div d ON t.label = d.division"""))
def score_companies(spark, sf_dir):
    """Top-3 Division codes with probabilities and titles for every company
    text (titles from the Division table, bounded by the code domain)."""
    ct = FX.company_text(spark, sf_dir).select("doc_id", "company", "text")
    top = NB.score_top_n(_fit(spark, sf_dir), ct, "doc_id", "text", TOP_N, keep=["company"])
    titles = TX.level_table(FX.dictionary(spark, sf_dir), "Division").withColumnRenamed("division", "pred_code")
    return top.join(F.broadcast(titles), "pred_code", "left")


@register("save_load_model", with_views(VIEWS, *FLAT_CTES, *_training_sql("Section"), *NB.fit_sql("stacked"),
    *NB.score_sql("company_text", "doc_id", "text", 1), body="SELECT doc_id, label AS pred_code, score, rank FROM nb_top"))
def save_load_model(spark, sf_dir):
    """Fit, save under the shared folder, load, score with the loaded model: the scores of the SQL's unsaved one."""
    path = shared_path(spark, f"models/section-{uuid.uuid4().hex}")
    _fit(spark, sf_dir, "Section").save(path)
    ct = FX.company_text(spark, sf_dir).select("doc_id", "text")
    return NB.score_top_n(NB.Model.load(spark, path), ct, "doc_id", "text", 1)


@register("classifier_accuracy", with_views([],
    ("learned", f"SELECT text, lang AS label FROM documents WHERE {bucket_sql('doc_id')} < {TRAIN_PCT}"),
    ("held", f"SELECT doc_id, text, lang FROM documents WHERE lang IS NOT NULL AND {bucket_sql('doc_id')} >= {TRAIN_PCT}"),
    *NB.fit_sql("learned"), *NB.score_sql("held", "doc_id", "text", 1),
    body="""SELECT h.lang, count(*) AS n, count(*) FILTER (t.label = h.lang) AS n_right, round(count(*) FILTER (t.label = h.lang) / count(*)::DOUBLE, 6) AS accuracy
            FROM held h JOIN nb_top t ON h.doc_id = t.doc_id GROUP BY h.lang"""))
def classifier_accuracy(spark, sf_dir):
    """Accuracy by class on documents that were not learned from (their language, 70/30 by an md5 bucket of the id)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned, held = S.train_test_split(docs, "doc_id", TRAIN_PCT)
    top = NB.score_top_n(NB.fit(learned, "text", "lang"), held.where(F.col("lang").isNotNull()), "doc_id", "text", 1, keep=["lang"])
    right = F.count_if(F.col("pred_code") == F.col("lang"))
    n = F.count(F.lit(1))
    return top.groupBy("lang").agg(n.alias("n"), right.alias("n_right"), F.round(right / n, 6).alias("accuracy"))


_REPORT_SRC = f"SELECT c.doc_id, {preprocess_domain_sql('c.text')} AS t FROM truth r JOIN company_text c ON r.uen = c.doc_id::VARCHAR"


@register("judge_classifier_report", with_views(VIEWS, *FLAT_CTES, *_training_sql(), *NB.fit_sql("stacked"),
    *_tfidf_ctes(_REPORT_SRC), *CONDENSE_CTES,
    ("condensed", "SELECT s.doc_id, coalesce(c.condensed, '') AS text FROM src s LEFT JOIN cond c ON s.doc_id = c.doc_id"),
    *NB.score_sql("condensed", "doc_id", "text", TOP_N_PREDICTIONS),
    ("ranked", "SELECT r.uen, t.label AS code, t.rank, substr(r.ssic_code, 1, 2) AS primary_code, substr(r.ssic_code2, 1, 2) AS secondary_code "
               "FROM nb_top t JOIN truth r ON r.uen = t.doc_id::VARCHAR"),
    *[(name, sql.replace("vec_id", "uen")) for name, sql in _judged_sql(exp_score_sql)[-3:]],
    body="SELECT * FROM judged"))
def judge_classifier_report(spark, sf_dir):
    """The classifier route of the judge: report text joined to declared codes
    by UEN -> domain cleaning -> TF-IDF condense (first 10 weighty words) ->
    Division classifier top-15 -> rank -> exp scores for the declared primary
    and secondary Division -> per-company min, weighted total, top-3 flag."""
    truth = FX.truth(spark, sf_dir)
    ct = FX.company_text(spark, sf_dir, {"t": X.preprocess_domain("text")})
    reports = truth.join(ct.select("doc_id", "t"), truth.uen == ct.doc_id.cast("string"), "inner")
    reports = reports.checkpoint(eager=True)  # feeds the weights, the word positions and the declared codes
    condensed = TF.condense(reports.select("doc_id", "t"), "doc_id", "t")
    declared = reports.select("doc_id", "uen", code_prefix("ssic_code", 2).alias("primary_code"), code_prefix("ssic_code2", 2).alias("secondary_code"))
    preds = NB.score_top_n(_fit(spark, sf_dir), condensed, "doc_id", "condensed", TOP_N_PREDICTIONS)
    return J.judge_entities(preds.join(declared, "doc_id"), "uen", "pred_code", "rank", "primary_code", "secondary_code",
                            top_n_predictions=TOP_N_PREDICTIONS, n=3)


@register("classifier_hit_rate", with_views(VIEWS, *FLAT_CTES, *M._CORPUS_CTES[:3], *_training_sql(), *NB.fit_sql("stacked"),
    *NB.score_sql("docs", "doc_id", "text", TOP_N),
    ("per", "SELECT d.doc_id, max(CAST(t.label = substr(d.ssic_code, 1, 2) AS INTEGER)) AS hit FROM docs d JOIN nb_top t ON d.doc_id = t.doc_id GROUP BY d.doc_id"),
    body="SELECT count(*) AS n_companies, round(avg(hit) * 100, 2) AS hit_rate FROM per"))
def classifier_hit_rate(spark, sf_dir):
    """% of companies whose declared Division is among the classifier's top 3
    (held out: the classifier is fitted on the dictionary and index only)."""
    docs = M._company_docs(spark, sf_dir)
    top = NB.score_top_n(_fit(spark, sf_dir), docs, "doc_id", "text", TOP_N, keep=["ssic_code"])
    per = top.groupBy("doc_id").agg(F.max((F.col("pred_code") == code_prefix("ssic_code", 2)).cast("int")).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("n_companies"), F.round(F.avg("hit") * 100, 2).alias("hit_rate"))
