"""Views that adapt the driver tables to the shapes the jobs expect.

Each view is a lazy DataFrame derived from the given tables, so its size grows
with them. The same definitions exist as SQL in ``codelens.plans.oracle`` so
that DuckDB can check every query.

* ``dictionary``: code, title, groups, definition, examples (code dictionary)
* ``truth``: uen, company, ssic_code, ssic_code2 (declared codes)
* ``company_text``: doc_id, company, text, lang (profile / report text)
* ``page_text``: page_id, company, url, html, kind, ord (stored web pages)
* ``vectors``: vec_id, embedding, primary_code, secondary_code
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.functions.codes import synthetic_code
from codelens.sources.tables import read_table


def dictionary(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The code dictionary (at most ~111,000 rows: bounded by the 5-character
    code domain). It is derived through several aggregates and used by several
    branches of every taxonomy job, so it is written once with a reliable
    checkpoint and all branches read that."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    sub_rows = part.select(
        synthetic_code("p_partkey").alias("code"),
        F.col("p_partkey").alias("k"),
        F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(":\n•"), "p_name", F.lit("\n•"), "p_brand").alias("definition"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("<Blank>")).otherwise(F.col("p_brand")).alias("examples"),
    )
    # One row per code: codes repeat once parts exceed the 5-digit domain; the
    # smallest part key wins. The result has at most 100,000 rows.
    sub = sub_rows.groupBy("code").agg(
        F.min_by(F.struct("title", "definition", "examples"), F.col("k")).alias("r")
    ).select("code", "r.title", F.lit(None).cast("string").alias("groups"), "r.definition", "r.examples")

    codes = sub.select("code")
    cls = codes.select(F.substring("code", 1, 4).alias("code")).distinct()
    grp = codes.select(F.substring("code", 1, 3).alias("code")).distinct()
    div = codes.select(F.substring("code", 1, 2).alias("code")).distinct()

    def level_rows(df: DataFrame, name: str, groups=None) -> DataFrame:
        return df.select(
            "code",
            F.concat(F.lit(name + " "), "code").alias("title"),
            (groups if groups is not None else F.lit(None).cast("string")).alias("groups"),
            F.lit(None).cast("string").alias("definition"),
            F.lit(None).cast("string").alias("examples"),
        )

    # Division rows carry a bullet list of their Groups; Section rows a bullet
    # list of their Divisions (Section letter = 'A' + division // 5).
    div_groups = grp.select(F.substring("code", 1, 2).alias("code"), F.col("code").alias("g")).groupBy("code").agg(
        F.expr("listagg(concat('•', g, ' Group ', g), '\\n') WITHIN GROUP (ORDER BY g)").alias("groups")
    )
    division_rows = level_rows(div_groups, "Division", F.col("groups"))
    section_groups = div.select(
        F.expr("chr(65 + cast(floor(cast(code as int) / 5) as int))").alias("code"), F.col("code").alias("d")
    ).groupBy("code").agg(
        F.expr("listagg(concat('•', d, ' Division ', d), '\\n') WITHIN GROUP (ORDER BY d)").alias("groups")
    )
    section_rows = level_rows(section_groups, "Section", F.col("groups"))
    out = (
        section_rows.unionByName(division_rows)
        .unionByName(level_rows(grp, "Group"))
        .unionByName(level_rows(cls, "Class"))
        .unionByName(sub)
    )
    return out.checkpoint(eager=True) if materialize else out


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alphabetical index: (code, definition), one row per part, so also for
    the parts whose code another part has in the dictionary."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.select(synthetic_code("p_partkey").alias("code"), F.concat(F.lit("index entry "), "p_name").alias("definition"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.select(
        F.col("c_custkey").cast("string").alias("uen"),
        F.when(F.col("c_custkey") % 8 == 0, F.concat("c_name", F.lit("."))).otherwise(F.col("c_name")).alias("company"),
        synthetic_code("c_custkey").alias("ssic_code"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(synthetic_code(F.col("c_custkey") + 1))
        .alias("ssic_code2"),
    )


def company_text(spark: SparkSession, sf_dir: str, cols: dict | None = None) -> DataFrame:
    """doc_id, company, then ``cols`` (default: text, lang).

    ``cols`` maps output names to expressions over ``documents``; they are
    evaluated before the join with ``customer``, so the shuffle carries their
    results (a flag, extracted text) rather than whole documents.
    """
    cols = cols if cols is not None else {"text": F.col("text"), "lang": F.col("lang")}
    docs = read_table(spark, sf_dir, "documents").select("doc_id", *[e.alias(n) for n, e in cols.items()])
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = docs.join(cust, docs.doc_id == cust.c_custkey, "left")
    company = (
        F.when(F.col("c_name").isNull(), F.concat(F.lit("Company#"), F.col("doc_id").cast("string")))
        .when(F.col("doc_id") % 10 == 9, F.concat("c_name", F.lit(" Holdings")))
        .otherwise(F.col("c_name"))
    )
    return j.select("doc_id", company.alias("company"), *cols)


def page_text(spark: SparkSession, sf_dir: str, cols: dict | None = None) -> DataFrame:
    """page_id, company, kind, ord, then ``cols`` (default: url, html).

    ``cols`` are expressions over ``pages`` evaluated before the join with
    ``customer`` (one of them may be a generator, e.g. a filter that keeps
    extracted text), so raw HTML need not be shuffled.
    """
    cols = cols if cols is not None else {"url": F.col("url"), "html": F.col("html")}
    pages = read_table(spark, sf_dir, "pages").select("page_id", *[e.alias(n) for n, e in cols.items()])
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = pages.withColumn("ckey", F.floor(F.col("page_id") / 2).cast("bigint"))
    j = p.join(cust, p.ckey == cust.c_custkey, "left")
    return j.select(
        "page_id",
        F.coalesce("c_name", F.concat(F.lit("Company#"), F.col("ckey").cast("string"))).alias("company"),
        F.when(F.col("page_id") % 2 == 0, F.lit("main")).otherwise(F.lit("sub")).alias("kind"),
        (F.col("page_id") % 2).cast("int").alias("ord"),
        *cols,
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        F.col("label").alias("primary_code"),
        F.when(F.col("vec_id") % 4 == 0, F.lit(None).cast("int"))
        .otherwise(((F.col("label") + 3) % 10).cast("int"))
        .alias("secondary_code"),
    )


VIEWS = {
    "dictionary": dictionary,
    "index_entries": index,
    "truth": truth,
    "company_text": company_text,
    "page_text": page_text,
    "vectors": vectors,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register raw tables and fixture views as temp views (for spark.sql users)."""
    from codelens.sources.tables import TABLES

    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
