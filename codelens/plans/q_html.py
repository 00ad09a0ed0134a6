"""Registered page/HTML queries and the page-text job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelens.functions import html as H
from codelens.functions import text as X
from codelens.operators import ranking as R
from codelens.operators import reconcile as RC
from codelens.plans.catalog import register
from codelens.plans.oracle import (
    extract_links_sql,
    filter_links_sql,
    first_tag_text_sql,
    html_to_text_sql,
    junk_sql,
    normalize_sql,
    resolve_links_sql,
    site_root_sql,
    with_views,
)
from codelens.session import shared_path
from codelens.sources import fixtures as FX
from codelens.sources.tables import read_table

# Keywords for the fixture pages: the default 'about'/'profile' plus words the
# generated hrefs use, so the filter keeps some links.
FIXTURE_LINK_KEYWORDS = H.LINK_KEYWORDS + ["the", "de"]


@register("html_to_text", f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.html_to_text("html").alias("text"))


@register("extract_links", f"SELECT page_id, {extract_links_sql('html')} AS links FROM pages")
def extract_links(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", H.extract_links("html").alias("links"))


_FILTERED = f"{filter_links_sql(extract_links_sql('html'), FIXTURE_LINK_KEYWORDS)}"


@register("filter_links", f"SELECT page_id, {_FILTERED} AS links FROM pages")
def filter_links(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", H.filter_links(H.extract_links("html"), FIXTURE_LINK_KEYWORDS).alias("links"))


def _resolved(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    site = H.site_root("url")
    return p.select(
        "page_id", site.alias("site"),
        H.resolve_links(H.filter_links(H.extract_links("html"), FIXTURE_LINK_KEYWORDS), site).alias("links"),
    )


_RESOLVED_SQL = (f"SELECT page_id, {site_root_sql('url')} AS site, "
                 f"{resolve_links_sql(_FILTERED, site_root_sql('url'))} AS links FROM pages")


@register("resolve_links", _RESOLVED_SQL)
def resolve_links(spark, sf_dir):
    return _resolved(spark, sf_dir)


@register("explode_site_links", f"""
    WITH r AS ({_RESOLVED_SQL})
    SELECT page_id, link FROM (
      SELECT page_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS link
      FROM (SELECT page_id, list_concat(CASE WHEN site IS NULL THEN [] ELSE [site] END, links) AS l FROM r) x) y""")
def explode_site_links(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.select("page_id", F.explode_outer(H.site_and_links("site", "links")).alias("link"))


def _profile_fields(spark, sf_dir):
    """The profile fields of every page, main and sub pages."""
    fields = {
        "page_url": F.col("url"),
        "category": H.first_tag_text("html", "div", "ad"),
        "website": H.first_tag_text("html", "footer", must_contain="example.com"),
        "text": H.first_tag_text("html", "p"),
    }
    return FX.page_text(spark, sf_dir, fields)


def company_profiles(spark, sf_dir):
    """One profile per company: its main page's, else its first sub page's (a partial aggregate, no window)."""
    pages = _profile_fields(spark, sf_dir)
    first = F.min_by(F.struct("page_url", "category", "website", "text"), F.struct("ord", "page_id"))
    return pages.groupBy("company").agg(first.alias("p")).select("company", "p.*")


_PAGE_PROFILE_SQL = (f"SELECT page_id, company, kind, ord, url AS page_url, {first_tag_text_sql('html', 'div', 'ad')} AS category, "
                     f"{first_tag_text_sql('html', 'footer', must_contain='example.com')} AS website, "
                     f"{first_tag_text_sql('html', 'p')} AS text FROM page_text")
_PROFILE_SQL = f"SELECT * FROM ({_PAGE_PROFILE_SQL}) q QUALIFY row_number() OVER (PARTITION BY company ORDER BY ord, page_id) = 1"


@register("extract_profile_fields", with_views(["page_text"], body=f"SELECT * EXCLUDE (ord) FROM ({_PAGE_PROFILE_SQL}) q"))
def extract_profile_fields(spark, sf_dir):
    return _profile_fields(spark, sf_dir).drop("ord")


@register("placeholder_rows", with_views(["page_text", "truth"], ("prof", _PROFILE_SQL), body="""
    SELECT t.company,
           CASE WHEN p.page_url IS NOT NULL THEN p.page_url ELSE 'linkedin page not found' END AS page_url,
           CASE WHEN p.page_url IS NOT NULL THEN coalesce(p.category, '') ELSE '' END AS category,
           CASE WHEN p.page_url IS NOT NULL THEN coalesce(p.website, '') ELSE '' END AS website,
           CASE WHEN p.page_url IS NOT NULL THEN coalesce(p.text, '') ELSE '' END AS text
    FROM (SELECT DISTINCT regexp_replace(company, '\\.\\z', '') AS company FROM truth) t
    LEFT JOIN prof p ON t.company = p.company"""))
def placeholder_rows(spark, sf_dir):
    companies = FX.truth(spark, sf_dir).select(X.strip_trailing_dot("company").alias("company")).distinct()
    return RC.placeholder_rows(companies, company_profiles(spark, sf_dir))


# ---- the page-text job: pages -> clean text -> one text per company and code

def page_text_job(spark, sf_dir, seen=lambda name, df: df):
    """``seen(step, df)`` is handed the rows of each step, to count them while the job runs."""
    # extract once per page, drop junk, normalize -- all before the company
    # join, so only clean text is shuffled
    kept = X.kept_value(H.html_to_text("html"), lambda v: ~X.junk_rule(v), then=X.normalize_text)
    t = seen("clean pages", FX.page_text(spark, sf_dir, {"text": kept}).select("page_id", "company", "ord", "text"))
    # dedupe by text within each page kind; the smallest page id survives
    t = seen("distinct texts", R.dedupe(t, ["ord", "text"], order="page_id"))
    coded = RC.reconcile(t, FX.truth(spark, sf_dir)).where(F.col("ssic_code").isNotNull() & F.col("text").isNotNull())
    return seen("companies", RC.concat_texts(seen("with a code", coded), ["company", "ssic_code"], "text", ["ord", "page_id"]))


def job_sizes(spark, sf_dir, path: str):
    """(step, n): rows after each step of the page-text job, observed in the one run that writes its result to ``path``."""
    from pyspark.sql import Observation

    watched = {}

    def seen(name, df):
        watched[name] = Observation(name)
        return df.observe(watched[name], F.count(F.lit(1)).alias("n"))

    page_text_job(spark, sf_dir, seen).write.parquet(path)
    return spark.createDataFrame([(name, int(o.get["n"])) for name, o in watched.items()], "step string, n bigint")


_JOB_CTES = (
    ("t0", f"SELECT page_id, company, ord, {html_to_text_sql('html')} AS text FROM page_text"),
    ("t1", f"SELECT page_id, company, ord, {normalize_sql('text')} AS text FROM t0 WHERE NOT {junk_sql('text')}"),
    ("t2", "SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY ord, text ORDER BY page_id) = 1"),
    ("ex", "SELECT company, min(ssic_code) AS c1 FROM truth WHERE ssic_code IS NOT NULL GROUP BY company"),
    ("lo", "SELECT regexp_replace(company, '\\.\\z', '') AS company, min(ssic_code) AS c2 FROM truth "
           "WHERE ssic_code IS NOT NULL GROUP BY 1"),
    ("t3", "SELECT t2.*, coalesce(ex.c1, lo.c2) AS ssic_code FROM t2 LEFT JOIN ex ON t2.company = ex.company "
           "LEFT JOIN lo ON t2.company = lo.company"),
)


@register("page_text_by_company", with_views(["page_text", "truth"], *_JOB_CTES,
    body="""SELECT company, ssic_code, string_agg(text, ' ' ORDER BY ord, page_id) AS text
            FROM t3 WHERE ssic_code IS NOT NULL AND text IS NOT NULL GROUP BY company, ssic_code"""))
def page_text_by_company(spark, sf_dir):
    return page_text_job(spark, sf_dir)


@register("concat_by_company", with_views(["page_text"], body=f"""
    SELECT company, string_agg(t, ' ' ORDER BY ord, page_id) AS text
    FROM (SELECT company, ord, page_id, {html_to_text_sql('html')} AS t FROM page_text) x
    WHERE t IS NOT NULL GROUP BY company"""))
def concat_by_company(spark, sf_dir):
    pt = FX.page_text(spark, sf_dir, {"text": H.html_to_text("html")}).select("company", "ord", "page_id", "text")
    return RC.concat_texts(pt.where(F.col("text").isNotNull()), ["company"], "text", ["ord", "page_id"])


@register("page_text_sizes", with_views(["page_text", "truth"], *_JOB_CTES,
    body="""SELECT 'clean pages' AS step, count(*) AS n FROM t1 UNION ALL SELECT 'distinct texts', count(*) FROM t2
            UNION ALL SELECT 'with a code', count(*) FROM t3 WHERE ssic_code IS NOT NULL AND text IS NOT NULL
            UNION ALL SELECT 'companies', count(DISTINCT (company, ssic_code)) FROM t3 WHERE ssic_code IS NOT NULL AND text IS NOT NULL"""))
def page_text_sizes(spark, sf_dir):
    """Rows after each step of the page-text job, counted while it runs (no second pass)."""
    return job_sizes(spark, sf_dir, shared_path(spark, f"page-text-{uuid.uuid4().hex}"))
