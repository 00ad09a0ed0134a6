"""Registered reconcile queries (name matching, declared codes, merges)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import text as X
from codelens.operators import ranking as R
from codelens.operators import reconcile as RC
from codelens.operators import split as S
from codelens.operators import taxonomy as TX
from codelens.plans.catalog import register
from codelens.plans.oracle import bucket_sql, with_views
from codelens.plans.q_html import _PROFILE_SQL, company_profiles
from codelens.plans.q_taxonomy import FLAT_CTES
from codelens.sources import fixtures as FX

_LOOKUPS = (
    ("ex", "SELECT company, min(ssic_code) AS c1 FROM truth WHERE ssic_code IS NOT NULL GROUP BY company"),
    ("lo", "SELECT regexp_replace(company, '\\.\\z', '') AS company, min(ssic_code) AS c2 FROM truth "
           "WHERE ssic_code IS NOT NULL GROUP BY 1"),
)


@register("company_to_report", with_views(["truth", "company_text"], body="""
    SELECT t.uen, t.company, t.ssic_code, c.doc_id, c.text
    FROM truth t JOIN company_text c ON t.uen = CAST(c.doc_id AS VARCHAR)"""))
def company_to_report(spark, sf_dir):
    t = FX.truth(spark, sf_dir)
    c = FX.company_text(spark, sf_dir).select("doc_id", "text")
    return t.join(c, t.uen == c.doc_id.cast("string"), "inner").select("uen", "company", "ssic_code", "doc_id", "text")


@register("attach_declared_section", with_views(["truth", "dictionary"], *FLAT_CTES, body="""
    SELECT t.uen, s1.section AS section, s2.section AS section2
    FROM truth t LEFT JOIN tx_sec s1 ON substr(t.ssic_code, 1, 2) = s1.division
    LEFT JOIN tx_sec s2 ON substr(t.ssic_code2, 1, 2) = s2.division"""))
def attach_declared_section(spark, sf_dir):
    t = FX.truth(spark, sf_dir)
    sec = TX.section_table(FX.dictionary(spark, sf_dir)).select("section", "division")
    s1 = F.broadcast(sec.select(F.col("division").alias("_d1"), "section"))
    s2 = F.broadcast(sec.select(F.col("division").alias("_d2"), F.col("section").alias("section2")))
    t = t.withColumn("_d1", F.substring("ssic_code", 1, 2)).withColumn("_d2", F.substring("ssic_code2", 1, 2))
    return t.join(s1, "_d1", "left").join(s2, "_d2", "left").select("uen", "section", "section2")


@register("attach_code", with_views(["truth", "company_text"], *_LOOKUPS, body="""
    SELECT c.doc_id, c.company, ex.c1 AS ssic_code FROM company_text c LEFT JOIN ex ON c.company = ex.company"""))
def attach_code(spark, sf_dir):
    c = FX.company_text(spark, sf_dir).select("doc_id", "company")
    return RC.attach_code(c, FX.truth(spark, sf_dir)).select("doc_id", "company", "ssic_code")


@register("two_pass_reconcile", with_views(["truth", "company_text"], *_LOOKUPS,
    ("first_pass", "SELECT c.doc_id, c.company, ex.c1 AS ssic_code FROM company_text c LEFT JOIN ex ON c.company = ex.company"),
    ("second_pass", "SELECT f.doc_id, f.company, lo.c2 AS ssic_code FROM first_pass f LEFT JOIN lo ON f.company = lo.company "
                    "WHERE f.ssic_code IS NULL"),
    body="SELECT * FROM first_pass WHERE ssic_code IS NOT NULL UNION ALL SELECT * FROM second_pass"))
def two_pass_reconcile(spark, sf_dir):
    """One-pass form (two left joins on the name + coalesce); the oracle is the
    original two-pass form (match, re-match the misses, union)."""
    c = FX.company_text(spark, sf_dir).select("doc_id", "company")
    return RC.reconcile(c, FX.truth(spark, sf_dir)).select("doc_id", "company", "ssic_code")


@register("null_filters", with_views(["truth", "company_text"], *_LOOKUPS, body="""
    SELECT c.doc_id, c.company, coalesce(ex.c1, lo.c2) AS ssic_code
    FROM company_text c LEFT JOIN ex ON c.company = ex.company LEFT JOIN lo ON c.company = lo.company
    WHERE coalesce(ex.c1, lo.c2) IS NOT NULL AND c.text IS NOT NULL"""))
def null_filters(spark, sf_dir):
    c = FX.company_text(spark, sf_dir, {"has_text": F.col("text").isNotNull()})
    r = RC.reconcile(c, FX.truth(spark, sf_dir))
    return r.where(F.col("ssic_code").isNotNull() & F.col("has_text")).select("doc_id", "company", "ssic_code")


@register("anti_split_test", with_views(["company_text"],
    ("train", f"SELECT DISTINCT company FROM company_text WHERE {bucket_sql('company')} < 70"),
    body="SELECT c.doc_id, c.company FROM company_text c WHERE c.company NOT IN (SELECT company FROM train)"))
def anti_split_test(spark, sf_dir):
    c = FX.company_text(spark, sf_dir).select("doc_id", "company")
    train, _ = S.train_test_split(c, "company", 70)
    return S.anti_split_test(c, train, "company")


@register("train_test_split", with_views(["company_text"], body=
    f"SELECT doc_id, company, {bucket_sql('company')} < 70 AS is_train FROM company_text"))
def train_test_split(spark, sf_dir):
    c = FX.company_text(spark, sf_dir).select("doc_id", "company")
    return S.with_split_flag(c, "company", 70)


@register("cross_validate_folds", with_views(["company_text"], body=
    f"SELECT doc_id, {bucket_sql('company', buckets=5)} AS fold FROM company_text"))
def cross_validate_folds(spark, sf_dir):
    """5 folds by md5 bucket of the company (the fold assignment of a k-fold run)."""
    return S.with_fold(FX.company_text(spark, sf_dir).select("doc_id", "company"), "company", 5).select("doc_id", "fold")


@register("join_two_sources", with_views(["truth", "company_text", "page_text"], *_LOOKUPS, ("prof", _PROFILE_SQL), body="""
    SELECT c.company, coalesce(ex.c1, lo.c2) AS ssic_code, c.text || '.' || coalesce(p.text, '') AS text
    FROM company_text c LEFT JOIN ex ON c.company = ex.company LEFT JOIN lo ON c.company = lo.company
    LEFT JOIN prof p ON c.company = p.company
    WHERE coalesce(ex.c1, lo.c2) IS NOT NULL"""))
def join_two_sources(spark, sf_dir):
    """Report text LEFT JOIN profile text by company, joined with '.'."""
    rep = RC.reconcile(FX.company_text(spark, sf_dir).select("company", "text"), FX.truth(spark, sf_dir))
    rep = rep.where(F.col("ssic_code").isNotNull())
    prof = company_profiles(spark, sf_dir).select("company", "text")
    return RC.join_two_sources(rep, prof).select("company", "ssic_code", "text")


@register("first_code_per_company", with_views(["truth"], body="""
    SELECT company, min(ssic_code) AS ssic_code, arg_min(uen, ssic_code) AS uen FROM truth GROUP BY company"""))
def first_code_per_company(spark, sf_dir):
    """Sort by (company, code) and keep the first row per company."""
    return R.first_by_key(FX.truth(spark, sf_dir), "company", "ssic_code", ["uen"])


@register("concat_by_code", with_views(["dictionary"], *FLAT_CTES, body="""
    SELECT division, string_agg(title || '.' || definition || '.' || examples, ' ' ORDER BY code) AS text
    FROM flat GROUP BY division"""))
def concat_by_code(spark, sf_dir):
    """Description text per Division, codes in order (bounded: at most 1,000
    codes per Division)."""
    f = TX.flatten(FX.dictionary(spark, sf_dir))
    f = f.select("division", "code", X.build_description(F.col("title"), F.col("definition"), F.col("examples")).alias("text"))
    return RC.concat_texts(f, ["division"], "text", ["code"])
