"""Registered learned-model queries: MLlib (seeded, checked rows-only) and document vectors (exact)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelens.functions import html as H
from codelens.functions import text as X
from codelens.operators import docvec as DV
from codelens.operators import ml as ML
from codelens.operators import recommend as RM
from codelens.operators import split as S
from codelens.operators import taxonomy as TX
from codelens.operators import tfidf as TF
from codelens.plans.catalog import register
from codelens.plans.oracle import bucket_sql, clean_sql, cosine_sql, normalize_sql, with_views
from codelens.plans.q_taxonomy import FLAT_CTES
from codelens.plans.q_tfidf import _tfidf_ctes
from codelens.session import shared_path
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table

FOLDS = 5
LEVEL_PREFIX = {"Section": None, "Division": 2, "Group": 3, "Class": 4}


def training_table(spark, sf_dir, level: str = "Division"):
    """Dictionary descriptions labelled with the code at ``level``."""
    f = TX.flatten(FX.dictionary(spark, sf_dir))
    text = X.build_description(F.col("title"), X.clean_text("definition"), X.clean_text("examples"))
    n = LEVEL_PREFIX[level]
    label = F.col("section") if n is None else F.substring("code", 1, n)
    return f.select("code", text.alias("text"), label.alias("label")).where(F.col("label").isNotNull())


def stacked_training(spark, sf_dir, level: str = "Division"):
    """The training table with the alphabetical index below it, labelled the same way."""
    dictionary = training_table(spark, sf_dir, level)
    entries = FX.index(spark, sf_dir).select("code", X.clean_text("definition").alias("text"))
    if LEVEL_PREFIX[level] is None:
        sections = TX.flatten(FX.dictionary(spark, sf_dir)).select("division", F.col("section").alias("label")).distinct()
        entries = entries.withColumn("division", F.substring("code", 1, 2)).join(sections, "division").drop("division")
    else:
        entries = entries.withColumn("label", F.substring("code", 1, LEVEL_PREFIX[level]))
    return dictionary.unionByName(entries)


def fit_classifier(spark, sf_dir, level="Division"):
    return ML.train_text_classifier(stacked_training(spark, sf_dir, level), "text", "label", model="nb")


@register("save_load_mllib_model", "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents")
def save_load_mllib_model(spark, sf_dir):
    """Round trip of the MLlib pipeline: how many texts get the same class and probability before and after saving."""
    model = fit_classifier(spark, sf_dir, "Section")
    path = shared_path(spark, f"models/section-{uuid.uuid4().hex}")
    ML.save_model(model, path)
    ct = FX.company_text(spark, sf_dir).select("doc_id", "text")
    before = ML.score_top_n(model, ct, "doc_id", "text", 1).select("doc_id", F.struct("pred_code", "score").alias("was"))
    after = ML.score_top_n(ML.load_model(path), ct, "doc_id", "text", 1).select("doc_id", F.struct("pred_code", "score").alias("now"))
    return before.join(after, "doc_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("was") == F.col("now")).alias("n_same"))


def _page_clean(spark, sf_dir):
    """All pages, cleaned once: every step of the fit reads the written table."""
    cleaned = {"cleaned": X.preprocess_tags(H.html_to_text("html"))}
    pt = FX.page_text(spark, sf_dir, cleaned).select("page_id", "company", F.coalesce("cleaned", F.lit("")).alias("cleaned"))
    return pt.checkpoint(eager=True)


@register("kmeans_pages")
def kmeans_pages(spark, sf_dir):
    """10 clusters of page TF-IDF vectors (seed 0), main and sub pages."""
    return ML.kmeans_clusters(_page_clean(spark, sf_dir), "cleaned", k=10, seed=0).select("page_id", "company", "cluster")


@register("cluster_members")
def cluster_members(spark, sf_dir):
    """Companies per cluster, as (cluster, company) rows with the cluster size.
    A list per cluster would put an unbounded group in one row."""
    c = ML.kmeans_clusters(_page_clean(spark, sf_dir), "cleaned", k=10, seed=0).select("cluster", "company")
    # sizes by partial aggregate; the size table has k rows, so it is broadcast
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"))
    return c.join(F.broadcast(sizes), "cluster")


@register("cluster_totals", "SELECT count(*) AS n_pages, sum(page_id)::BIGINT AS ids, CASE WHEN count(*) > 0 THEN true ELSE NULL END AS within_k FROM pages")
def cluster_totals(spark, sf_dir):
    """Every page is in one cluster: pages, the sum of their ids, and whether there are at most 10 clusters."""
    c = kmeans_pages(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("n_pages"), F.sum("page_id").alias("ids"), F.max(F.col("cluster") < 10).alias("within_k"))


@register("cross_validate_classifier")
def cross_validate_classifier(spark, sf_dir):
    """Mean accuracy of the naive Bayes pipeline on documents' languages for three smoothings, five folds by the id's md5 bucket."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").where(F.col("lang").isNotNull())
    folded = S.with_fold(docs, "doc_id", FOLDS)
    found = ML.cross_validate(folded, "text", "lang", "fold", FOLDS, [0.1, 1.0, 10.0])
    return spark.createDataFrame([(s, round(float(a), 6)) for s, a in found], "smoothing double, mean_accuracy double")


def _company_docs(spark, sf_dir):
    """Company texts (lower-cased) with their reconciled, padded code."""
    from codelens.functions.codes import pad_code
    from codelens.operators.reconcile import reconcile

    ct = FX.company_text(spark, sf_dir).select("doc_id", "company", "text")
    r = reconcile(ct, FX.truth(spark, sf_dir)).where(F.col("ssic_code").isNotNull() & F.col("text").isNotNull())
    return r.select("doc_id", "company", pad_code("ssic_code").alias("ssic_code"), X.normalize_text("text").alias("text"))


DIMS = 64
# dictionary rows get ids above any document's
DICTIONARY_IDS = 10**12


def _text_corpus(spark, sf_dir):
    """(doc_id, company, ssic_code, text): company texts with codes, then the dictionary's."""
    docs = _company_docs(spark, sf_dir)
    dictionary = training_table(spark, sf_dir).select(
        (F.col("code").cast("bigint") + DICTIONARY_IDS).alias("doc_id"), F.lit(None).cast("string").alias("company"),
        F.col("code").alias("ssic_code"), X.normalize_text("text").alias("text"))
    return docs.unionByName(dictionary)


def _text_vectors(corpus):
    """The corpus with 64-d projections of its TF-IDF weights; a row without a word has the zero vector,
    which is similar to nothing."""
    # read twice, for the weights and, without its texts, for the result: they are not written
    vectors = DV.project(TF.tfidf(corpus, "doc_id", "text", in_place=True), "doc_id", size=DIMS)
    zeros = F.array_repeat(F.lit(0.0), DIMS)
    return corpus.join(vectors, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", zeros))


_CORPUS_CTES = (
    ("ex", "SELECT company, min(ssic_code) AS c1 FROM truth WHERE ssic_code IS NOT NULL GROUP BY company"),
    ("lo", "SELECT regexp_replace(company, '\\.\\z', '') AS company, min(ssic_code) AS c2 FROM truth "
           "WHERE ssic_code IS NOT NULL GROUP BY 1"),
    ("docs", f"SELECT c.doc_id, c.company, lpad(coalesce(ex.c1, lo.c2), 5, '0') AS ssic_code, {normalize_sql('c.text')} AS text "
             "FROM company_text c LEFT JOIN ex ON c.company = ex.company LEFT JOIN lo ON c.company = lo.company "
             "WHERE coalesce(ex.c1, lo.c2) IS NOT NULL AND c.text IS NOT NULL"),
    ("descr", f"SELECT code, title || '.' || {clean_sql('definition')} || '.' || {clean_sql('examples')} AS text FROM flat"),
    ("corpus", "SELECT * FROM docs UNION ALL "
               f"SELECT {DICTIONARY_IDS} + code::BIGINT, NULL, code, {normalize_sql('text')} FROM descr"),
    *_tfidf_ctes("SELECT doc_id, text AS t FROM corpus"),
    ("vec", DV.project_sql("w", DIMS)),
)


@register("train_doc_vectors", with_views(["truth", "company_text", "dictionary"], *FLAT_CTES, *_CORPUS_CTES,
    body=f"SELECT d.doc_id, coalesce(v.embedding, list_transform(range({DIMS}), lambda i: 0.0::DOUBLE)) AS embedding "
         "FROM docs d LEFT JOIN vec v ON d.doc_id = v.doc_id"))
def train_doc_vectors(spark, sf_dir):
    """64-d vectors of company texts; term weights come from company and dictionary text."""
    v = _text_vectors(_text_corpus(spark, sf_dir))
    return v.where(F.col("doc_id") < DICTIONARY_IDS).select("doc_id", "embedding")


def text_recommendations(spark, sf_dir, k=5):
    """The whole recommender function on text: pad codes, hash split by
    company, dictionary rows join the training side, top-k neighbours of each
    test document, ranked per company. A text without a word gets no codes."""
    v = _text_vectors(_text_corpus(spark, sf_dir)).drop("text").checkpoint(eager=True)
    docs = v.where(F.col("doc_id") < DICTIONARY_IDS)
    train, _ = S.train_test_split(docs, "company", 70)
    test = S.anti_split_test(docs, train, "company")
    train_all = train.select(*docs.columns).unionByName(v.where(F.col("doc_id") >= DICTIONARY_IDS))
    return RM.recommend(train_all, test, k, "doc_id", "company", "ssic_code")


_TEXT_RECS = (
    ("tv", "SELECT c.doc_id, c.company, c.ssic_code, v.embedding AS e FROM corpus c JOIN vec v ON c.doc_id = v.doc_id"),
    ("ttr", f"SELECT * FROM tv WHERE company IS NULL OR {bucket_sql('company')} < 70"),
    ("tte", f"SELECT * FROM tv WHERE company IS NOT NULL AND {bucket_sql('company')} >= 70"),
    ("tpairs", f"SELECT q.doc_id, q.company, q.ssic_code AS actual_code, r.doc_id AS ref_id, r.ssic_code AS rec_code, "
               f"{cosine_sql('q.e', 'r.e')} AS score FROM tte q CROSS JOIN ttr r"),
    ("tnb", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ref_id) AS nb_rank FROM tpairs QUALIFY nb_rank <= 5"),
    ("trecs", "SELECT company, actual_code, rec_code, score, "
              "CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, doc_id, nb_rank) AS INTEGER) AS rank FROM tnb"),
)


@register("recommend_codes", with_views(["truth", "company_text", "dictionary"], *FLAT_CTES, *_CORPUS_CTES, *_TEXT_RECS,
    body="SELECT * FROM trecs"))
def recommend_codes(spark, sf_dir):
    """Top-5 codes for every test company from its text."""
    return text_recommendations(spark, sf_dir)
