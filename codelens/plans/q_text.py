"""Registered text-column and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import html as H
from codelens.functions import text as X
from codelens.operators import profile as PR
from codelens.plans.catalog import register
from codelens.plans.oracle import (
    strip_sql,
    junk_sql,
    normalize_sql,
    clean_sql,
    preprocess_domain_sql,
    preprocess_tags_sql,
    tag_activity_sql,
    tokenize_sql,
    with_views,
)
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table


@register("normalize_text", f"SELECT doc_id, {normalize_sql('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.normalize_text("text").alias("text"))


@register("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text, {clean_sql('text', lower=True)} AS text_lower FROM documents")
def clean_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("text"), X.clean_text("text", lower=True).alias("text_lower"))


@register("strip_trailing_dot", with_views(["truth"], body=
    "SELECT uen, regexp_replace(company, '\\.\\z', '') AS company FROM truth"))
def strip_trailing_dot(spark, sf_dir):
    return FX.truth(spark, sf_dir).select("uen", X.strip_trailing_dot("company").alias("company"))


@register("tokenize_words", f"SELECT doc_id, {tokenize_sql('text')} AS tokens FROM documents")
def tokenize_words(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.tokenize_words("text").alias("tokens"))


@register("preprocess_tags", f"SELECT page_id, {preprocess_tags_sql('html')} AS cleaned FROM pages")
def preprocess_tags(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", X.preprocess_tags("html").alias("cleaned"))


@register("preprocess_domain", f"SELECT doc_id, {preprocess_domain_sql('text')} AS cleaned FROM documents")
def preprocess_domain(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.preprocess_domain("text").alias("cleaned"))


# The listed activities never occur in the generated texts: a vocabulary of words that do
# lets several patterns hit, one after the other and none.
FIXTURE_PATTERNS = [("Trade", r"\b(der|die|und)\b"), ("Services", r"\b(idiot|clown|trash)\b"), ("Transport", r"reth"), *X.BUSINESS_PATTERNS]

_TAGGED_SQL = f"SELECT doc_id, {tag_activity_sql(preprocess_tags_sql('text'), FIXTURE_PATTERNS)} AS activity FROM documents"


def _tagged(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.tag_activity(X.preprocess_tags("text"), FIXTURE_PATTERNS).alias("activity"))


@register("tag_activity", _TAGGED_SQL)
def tag_activity(spark, sf_dir):
    return _tagged(spark, sf_dir)


@register("activity_counts", f"WITH t AS ({_TAGGED_SQL}) SELECT activity, count(*) AS n FROM t GROUP BY activity")
def activity_counts(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@register("row_contains_junk", f"SELECT doc_id, text FROM documents WHERE NOT {junk_sql('text')}")
def row_contains_junk(spark, sf_dir):
    """Rows that survive the junk filter (word rule for 'nan')."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where(~X.is_junk_text("text"))


@register("row_contains_junk_literal", f"SELECT doc_id FROM documents WHERE NOT {junk_sql('text', True)}")
def row_contains_junk_literal(spark, sf_dir):
    """Same with the original substring rule ('finance' is dropped too)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where(~X.is_junk_text("text", literal_nan=True)).select("doc_id")


@register("duplicate_counts", """
    SELECT count(*) - count(DISTINCT text) - max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS dup_text,
           count(*) - count(DISTINCT source) - max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS dup_source,
           count(*) - count(DISTINCT lang) - max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS dup_lang
    FROM documents""")
def duplicate_counts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return PR.duplicate_counts(d, ["text", "source", "lang"])


_DESCRIBE_COLS = ["lang", "source", "text"]


@register("describe_table", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS n_count, count(*) AS n_unique,
               arg_min(v, (-n, v)) AS top, max(n) AS freq
        FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) g""" for c in _DESCRIBE_COLS) + ") x")
def describe_table(spark, sf_dir):
    return PR.describe_text_columns(read_table(spark, sf_dir, "documents"), _DESCRIBE_COLS)


@register("table_sizes", f"""
    SELECT step, CAST(n AS BIGINT) AS n FROM (
      SELECT count(*) AS documents,
             count_if(NOT {junk_sql('text')}) AS after_junk_filter,
             count(DISTINCT CASE WHEN NOT {junk_sql('text')} THEN text END) AS after_text_dedupe,
             count(DISTINCT CASE WHEN NOT {junk_sql('text')} THEN {normalize_sql('text')} END) AS after_normalize_dedupe
      FROM documents) UNPIVOT (n FOR step IN (documents, after_junk_filter, after_text_dedupe, after_normalize_dedupe))""")
def table_sizes(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    ok = ~X.is_junk_text("text")
    return PR.step_counts(d, {
        "documents": F.count(F.lit(1)),
        "after_junk_filter": F.count_if(ok),
        "after_text_dedupe": F.count_distinct(F.when(ok, F.sha2("text", 256))),
        "after_normalize_dedupe": F.count_distinct(F.when(ok, F.sha2(X.normalize_text("text"), 256))),
    })


@register("company_from_filename", with_views(["company_text"], body="""
    SELECT doc_id, file_name,
           CASE WHEN contains(file_name, '.')
                THEN regexp_replace(substr(replace(regexp_replace(file_name, '\\.[^.]*\\z', ''), '.', ' '), 1,
                        greatest(length(replace(regexp_replace(file_name, '\\.[^.]*\\z', ''), '.', ' ')) - 5, 0)),
                        '^\\s+|\\s+$', '', 'g')
                ELSE regexp_replace(substr(file_name, 1, greatest(length(file_name) - 9, 0)), '^\\s+|\\s+$', '', 'g')
           END AS company
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN company || ' 2023.pdf' ELSE company || '-FY2023AR' END AS file_name
          FROM company_text) f"""))
def company_from_filename(spark, sf_dir):
    """Report file names (derived from the company texts) back to names."""
    ct = FX.company_text(spark, sf_dir)
    f = ct.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("company", F.lit(" 2023.pdf")))
                  .otherwise(F.concat("company", F.lit("-FY2023AR"))).alias("file_name"))
    return f.select("doc_id", "file_name", X.company_from_filename("file_name").alias("company"))


@register("company_from_spaced_filename", with_views(["company_text"], body=f"""
    SELECT doc_id, file_name, regexp_replace(CASE WHEN contains(file_name, '.')
             THEN {strip_sql("substr(stem, 1, greatest(length(stem) - 5, 0))")}
             ELSE {strip_sql("substr(file_name, 1, greatest(length(file_name) - 9, 0))")} END, '\\.\\z', '') AS company
    FROM (SELECT *, array_to_string(string_split(file_name, ' ')[1:-2], ' ') AS stem
          FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN company || '. 2023 report.pdf' ELSE company || ' FY2023AR' END AS file_name
                FROM company_text) e) f"""))
def company_from_spaced_filename(spark, sf_dir):
    """Report names with spaces back to company names."""
    ct = FX.company_text(spark, sf_dir)
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("company", F.lit(". 2023 report.pdf"))).otherwise(F.concat("company", F.lit(" FY2023AR")))
    return ct.select("doc_id", name.alias("file_name")).withColumn("company", X.company_from_spaced_filename("file_name"))


@register("query_url", with_views(["truth"], body="""
    SELECT uen, 'https://www.linkedin.com/company/' || company || '/about' AS profile_url,
           'https://www.linkedin.com/search/results/companies/?keywords=' || company AS search_url,
           'https://www.linkedin.com/company/' || replace(company, ' ', '-') || '/about' AS dashed_url
    FROM truth"""))
def query_url(spark, sf_dir):
    t = FX.truth(spark, sf_dir)
    return t.select(
        "uen",
        X.query_url("company").alias("profile_url"),
        X.query_url("company", X.SEARCH_URL).alias("search_url"),
        X.query_url("company", dash_spaces=True).alias("dashed_url"),
    )


@register("force_https", "SELECT page_id, "
          "CASE WHEN starts_with(url, 'https://') THEN url WHEN starts_with(url, 'http://') "
          "THEN replace(url, 'http://', 'https://') ELSE 'https://' || url END AS url FROM pages")
def force_https(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.force_https("url").alias("url"))
