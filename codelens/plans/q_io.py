"""Registered source/sink round trips.

Each query writes a table that Spark derives from the given data to the
shared folder (``spark.checkpoint.dir``), reads it back with the reader under
test and returns the result; the oracle is the SQL of the derived table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelens.operators import taxonomy as TX
from codelens.plans.catalog import register
from codelens.plans.oracle import force_https_sql, with_views
from codelens.plans.q_neighbours import _rec_ctes, recommend_base
from codelens.plans.q_taxonomy import FLAT_CTES
from codelens.session import shared_path
from codelens.sources import fixtures as FX
from codelens.sources import io as IO


def _scratch(spark, name: str) -> str:
    return shared_path(spark, f"io/{name}-{uuid.uuid4().hex}")


@register("read_csv_strings", with_views(["company_text"], body=
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, company, text, lang FROM company_text"))
def read_csv_strings(spark, sf_dir):
    """Multi-line text cells survive a CSV round trip, read back as strings."""
    p = _scratch(spark, "company_text_csv")
    IO.write_table(FX.company_text(spark, sf_dir), p, "csv")
    return IO.read_csv_strings(spark, p)


@register("read_csv_typed", with_views(["truth"], body="SELECT * FROM truth"))
def read_csv_typed(spark, sf_dir):
    """Codes keep their leading zeros with an explicit string schema."""
    p = _scratch(spark, "truth_csv")
    IO.write_table(FX.truth(spark, sf_dir), p, "csv")
    return IO.read_csv_typed(spark, p, "uen string, company string, ssic_code string, ssic_code2 string")


@register("read_dictionary", with_views(["dictionary"], body="SELECT code, title, definition, examples FROM dictionary"))
def read_dictionary(spark, sf_dir):
    """Dictionary export with 4 preamble lines and a header line."""
    d = FX.dictionary(spark, sf_dir).select(
        "code", "title", "groups", "definition", F.lit(None).cast("string").alias("cross_references"), "examples")
    pre = spark.createDataFrame(
        [("Industry code dictionary", None, None, None, None, None), ("", None, None, None, None, None),
         ("Detailed definitions", None, None, None, None, None), ("", None, None, None, None, None),
         ("Code", "Title", "Groups", "Definitions", "Cross References", "Examples")],
        "code string, title string, groups string, definition string, cross_references string, examples string")
    p = _scratch(spark, "dictionary_csv")
    pre.unionByName(d).write.mode("overwrite").options(**dict(IO.CSV_OPTIONS, header="false")).csv(p)
    return IO.read_dictionary(spark, p)


@register("read_index", with_views(["index_entries"], body="SELECT code, definition FROM index_entries"))
def read_index(spark, sf_dir):
    """Index export: third column dropped, rows with a null dropped, renamed."""
    idx = FX.index(spark, sf_dir).select("code", F.col("definition").alias("description"), F.lit("x").alias("extra"))
    p = _scratch(spark, "index_csv")
    idx.write.mode("overwrite").options(**dict(IO.CSV_OPTIONS, header="false")).csv(p)
    return IO.read_index(spark, p)


@register("read_url_map", with_views(["page_text"], body=
    f"SELECT DISTINCT company AS pdf_name, {force_https_sql('url')} AS url FROM page_text WHERE url IS NOT NULL"))
def read_url_map(spark, sf_dir):
    """JSON lines {company: [urls]} -> (pdf_name, url), https forced."""
    # one line per url: a map file may hold a company any number of times
    pt = FX.page_text(spark, sf_dir, {"url": F.col("url")})
    lines = pt.select(F.to_json(F.create_map("company", F.array("url"))).alias("value"))
    p = _scratch(spark, "url_map_json")
    lines.write.mode("overwrite").text(p)
    return IO.read_url_map(spark, p)


@register("write_table", with_views(["dictionary"], *FLAT_CTES, body="SELECT * FROM flat"))
def write_table(spark, sf_dir):
    """Parquet round trip of the flat taxonomy."""
    p = _scratch(spark, "flat_parquet")
    IO.write_table(TX.flatten(FX.dictionary(spark, sf_dir)), p, "parquet")
    return spark.read.parquet(p)


# every row of the bundle as one digest: whole numbers instead of engine-dependent decimals
_BUNDLE_COLUMNS = {
    "results": ("metric", "value*1e6"),
    "outputs": ("company", "actual_ssic", "rec_ssic", "score*1e6", "rank"),
    "stats": ("company", "mean*10", "std*10"),
    "validation": ("company", "actual_code", "rec_code", "score*1e6", "rank", "md5 actual_text", "md5 rec_text", "actual_description", "rec_description"),
    "training": ("vec_id", "company", "ssic_code", "md5 text"),
    "testing": ("vec_id", "company", "ssic_code", "md5 text"),
}


def _bundle_cell(c: str):
    if "*" in c:
        name, factor = c.split("*")
        value = F.round(F.col(name) * float(factor)).cast("bigint").cast("string")
    else:
        value = F.md5(F.col(c[4:])) if c.startswith("md5 ") else F.col(c).cast("string")
    return F.coalesce(value, F.lit("~"))


def _bundle_sql(name: str) -> str:
    cells = []
    for c in _BUNDLE_COLUMNS[name]:
        if "*" in c:
            column, factor = c.split("*")
            cells.append(f"round({column} * {float(factor)})::BIGINT::VARCHAR")
        else:
            cells.append(f"md5({c[4:]})" if c.startswith("md5 ") else f"{c}::VARCHAR")
    row = " || '|' || ".join(f"coalesce({c}, '~')" for c in cells)
    return f"SELECT '{name}' AS table_name, md5({row}) AS row_md5 FROM b_{name}"


@register("write_result_bundle", with_views(["truth", "company_text", "dictionary"], *_rec_ctes(), *FLAT_CTES,
    ("descr", "SELECT code, title || '.' || definition || '.' || examples AS description FROM flat"),
    ("full_recs", "SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, vec_id, nb_rank) AS INTEGER) AS rank FROM nb"),
    ("b_outputs", "SELECT company, substr(actual_code, 1, 2) AS actual_ssic, substr(rec_code, 1, 2) AS rec_ssic, score, rank FROM full_recs"),
    ("b_stats", "SELECT company, round(avg(d), 1) AS mean, round(stddev_samp(d), 1) AS std FROM (SELECT company, rec_ssic::BIGINT AS d FROM b_outputs) x GROUP BY company"),
    ("b_per", "SELECT company, avg(rec_ssic::BIGINT) AS m, stddev_samp(rec_ssic::BIGINT) AS s, "
              "max((actual_ssic = rec_ssic)::INTEGER) AS hit, sum(score) AS ss, count(*) AS n FROM b_outputs GROUP BY company"),
    ("b_results", "SELECT 'overall accuracy' AS metric, round(avg(hit), 6) AS value FROM b_per UNION ALL "
                  "SELECT 'mean similarity', round(sum(ss) / sum(n), 6) FROM b_per UNION ALL "
                  "SELECT 'mean of division means', round(avg(m), 6) FROM b_per UNION ALL "
                  "SELECT 'mean of division deviations', round(avg(s), 6) FROM b_per"),
    ("b_validation", "SELECT r.*, t.text AS actual_text, u.text AS rec_text, coalesce(a.description, '') AS actual_description, "
                     "coalesce(c.description, '') AS rec_description FROM full_recs r LEFT JOIN company_text t ON r.vec_id = t.doc_id "
                     "LEFT JOIN company_text u ON r.ref_id = u.doc_id LEFT JOIN descr a ON r.actual_code = a.code LEFT JOIN descr c ON r.rec_code = c.code"),
    ("b_training", "SELECT tr.vec_id, tr.company, tr.ssic_code, t.text FROM tr LEFT JOIN company_text t ON tr.vec_id = t.doc_id"),
    ("b_testing", "SELECT te.vec_id, te.company, te.ssic_code, t.text FROM te LEFT JOIN company_text t ON te.vec_id = t.doc_id"),
    ("rows_of_all", " UNION ALL ".join(_bundle_sql(n) for n in _BUNDLE_COLUMNS)),
    body="SELECT table_name, row_md5, count(*) AS n FROM rows_of_all GROUP BY ALL"))
def write_result_bundle(spark, sf_dir):
    """The recommender's six tables (results, outputs, stats, validation,
    training, testing) written as one bundle, one parquet directory each, and
    read back: a digest of every row of every table."""
    from codelens.functions import text as X
    from codelens.operators import recommend as RM
    from codelens.plans.q_neighbours import K_RECOMMEND, _split

    base = recommend_base(spark, sf_dir)
    train, test = _split(base)
    texts = FX.company_text(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    flat = TX.flatten(FX.dictionary(spark, sf_dir))
    described = flat.select("code", X.build_description(F.col("title"), F.col("definition"), F.col("examples")).alias("description"))
    tables = RM.result_tables(base, train, test, texts, described, K_RECOMMEND, "vec_id", "company", "ssic_code")
    paths = IO.write_result_bundle(tables, _scratch(spark, "bundle"))
    out = None
    for name, path in paths.items():
        digest = F.md5(F.concat_ws("|", *[_bundle_cell(c) for c in _BUNDLE_COLUMNS[name]])).alias("row_md5")
        rows = spark.read.parquet(path).select(F.lit(name).alias("table_name"), digest)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("table_name", "row_md5").agg(F.count(F.lit(1)).alias("n"))


@register("list_report_files", with_views(["company_text"], body="""
    SELECT lang, 'json' AS extension, 1::BIGINT AS n_files, count(*) AS n_rows FROM company_text WHERE lang IS NOT NULL GROUP BY lang"""))
def list_report_files(spark, sf_dir):
    """The files of a folder tree (one per language is written there), found by a glob, with the rows each holds."""
    folder = _scratch(spark, "reports")
    texts = FX.company_text(spark, sf_dir).where(F.col("lang").isNotNull())
    texts.repartition("lang").write.partitionBy("lang").json(folder)
    files = IO.list_report_files(spark, folder, "part-*.json")
    found = files.select(F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"), F.regexp_extract("file_name", r"\.([a-z]+)$", 1).alias("extension"))
    counts = spark.read.json(folder).groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    return found.groupBy("lang", "extension").agg(F.count(F.lit(1)).alias("n_files")).join(counts, "lang")


@register("read_cached_reference", with_views(["truth"], body="SELECT * FROM truth"))
def read_cached_reference(spark, sf_dir):
    """Reference table read once and cached in executor memory; a refresh
    drops and re-reads it."""
    p = _scratch(spark, "reference_csv")
    IO.write_table(FX.truth(spark, sf_dir), p, "csv")
    ref = IO.CachedReference(spark, p, schema="uen string, company string, ssic_code string, ssic_code2 string")
    return ref.refresh()
