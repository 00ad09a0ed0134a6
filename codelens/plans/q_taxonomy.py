"""Registered taxonomy queries (code dictionary operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import codes as C
from codelens.functions import text as X
from codelens.operators import ranking as R
from codelens.operators import taxonomy as TX
from codelens.plans import judge as PJ
from codelens.plans.catalog import register
from codelens.sources import fixtures as FX
from codelens.plans.oracle import with_views
from codelens.plans.q_judge import _RANKED_CTES

_BLANK = "CASE WHEN {c} IS NULL OR {c} IN ('<Blank>', 'NaN') THEN '' ELSE {c} END"

FLAT_CTES = (
    ("tx_sub", f"""SELECT code, title, {_BLANK.format(c='definition')} AS definition,
                   {_BLANK.format(c='examples')} AS examples,
                   substr(code, 1, 2) AS division, substr(code, 1, 3) AS group_code, substr(code, 1, 4) AS class_code
                   FROM dictionary WHERE length(code) = 5"""),
    ("tx_sec", """SELECT DISTINCT code AS section, title AS section_title, substr(replace(item, '•', ''), 1, 2) AS division
                  FROM (SELECT code, title, unnest(string_split(groups, chr(10) || '•')) AS item
                        FROM dictionary WHERE length(code) = 1) x"""),
    ("tx_div", "SELECT DISTINCT code AS division, title AS division_title FROM dictionary WHERE length(code) = 2"),
    ("tx_grp", "SELECT DISTINCT code AS group_code, title AS group_title FROM dictionary WHERE length(code) = 3"),
    ("tx_cls", "SELECT DISTINCT code AS class_code, title AS class_title FROM dictionary WHERE length(code) = 4"),
    ("flat", """SELECT s.code, s.title, s.definition, s.examples, sec.section, sec.section_title, s.division,
                       d.division_title, s.group_code, g.group_title, s.class_code, c.class_title
                FROM tx_sub s LEFT JOIN tx_sec sec ON s.division = sec.division
                LEFT JOIN tx_div d ON s.division = d.division
                LEFT JOIN tx_grp g ON s.group_code = g.group_code
                LEFT JOIN tx_cls c ON s.class_code = c.class_code"""),
)


def flat(spark, sf_dir):
    return TX.flatten(FX.dictionary(spark, sf_dir))


def _flat_sql(body, *extra):
    return with_views(["dictionary"], *FLAT_CTES, *extra, body=body)


@register("taxonomy_flatten", _flat_sql("SELECT * FROM flat"))
def taxonomy_flatten(spark, sf_dir):
    return flat(spark, sf_dir)


@register("taxonomy_browser", _flat_sql(
    "SELECT DISTINCT code, title, section, division, group_code, class_code, section_title FROM flat"))
def taxonomy_browser(spark, sf_dir):
    """The whole taxonomy job: level filters, bullet split, prefixes, blank
    fix, flatten joins, projection and dedupe."""
    return flat(spark, sf_dir).select(
        "code", "title", "section", "division", "group_code", "class_code", "section_title"
    ).dropDuplicates()


@register("code_level_filter", with_views(["dictionary"], body=
    "SELECT CASE length(code) WHEN 1 THEN 'Section' WHEN 2 THEN 'Division' WHEN 3 THEN 'Group' WHEN 4 THEN 'Class' "
    "ELSE 'Sub-class' END AS level, code, title FROM dictionary WHERE length(code) BETWEEN 1 AND 5"))
def code_level_filter(spark, sf_dir):
    """The rows of each of the five levels."""
    return TX.with_level(FX.dictionary(spark, sf_dir)).select("level", "code", "title")


@register("drop_section_rows", with_views(["dictionary"], body=
    "SELECT code, title FROM dictionary WHERE NOT regexp_matches(code, '^[A-Z]$')"))
def drop_section_rows(spark, sf_dir):
    return TX.drop_section_rows(FX.dictionary(spark, sf_dir)).select("code", "title")


@register("cascade_search", _flat_sql(
    "SELECT * FROM flat WHERE regexp_matches(section, 'c', 'i') AND regexp_matches(code, '1', 'i') "
    "AND regexp_matches(title, 'RING', 'i')"))
def cascade_search(spark, sf_dir):
    return TX.cascade_search(flat(spark, sf_dir), section="c", code="1", title="RING")


CODE_LIST = ["00037", "00111", "03700", "37000", "99999"]


@register("code_in_list", _flat_sql(
    "SELECT code, title, section FROM flat WHERE code IN (" + ", ".join(f"'{c}'" for c in CODE_LIST) + ")"))
def code_in_list(spark, sf_dir):
    return flat(spark, sf_dir).where(F.col("code").isin(*CODE_LIST)).select("code", "title", "section")


@register("select_rename_reorder", _flat_sql(
    "SELECT section AS ssic_section, code AS ssic_code, title AS ssic_title FROM flat"))
def select_rename_reorder(spark, sf_dir):
    return flat(spark, sf_dir).select("section", "code", "title").toDF("ssic_section", "ssic_code", "ssic_title")


@register("blank_to_null", with_views(["dictionary"], body=
    f"SELECT code, {_BLANK.format(c='definition')} AS definition, {_BLANK.format(c='examples')} AS examples "
    f"FROM dictionary WHERE length(code) = 5"))
def blank_to_null(spark, sf_dir):
    d = TX.level_rows(FX.dictionary(spark, sf_dir), "Sub-class")
    return d.select("code", X.blank_to_empty("definition").alias("definition"), X.blank_to_empty("examples").alias("examples"))


@register("fill_blank", with_views(["truth"], body=
    "SELECT uen, company, ssic_code, coalesce(ssic_code2, 'Blank') AS ssic_code2 FROM truth"))
def fill_blank(spark, sf_dir):
    return FX.truth(spark, sf_dir).na.fill("Blank", subset=["ssic_code2"])


@register("split_bullets", with_views(["dictionary"], body="""
    SELECT code, replace(item, '•', '') AS item, substr(replace(item, '•', ''), 1, 2) AS division
    FROM (SELECT code, unnest(string_split(groups, chr(10) || '•')) AS item FROM dictionary WHERE length(code) = 1) x"""))
def split_bullets(spark, sf_dir):
    s = TX.split_bullets(TX.level_rows(FX.dictionary(spark, sf_dir), "Section").select("code", "groups"), "groups")
    return s.select("code", "item", F.substring("item", 1, 2).alias("division"))


@register("code_prefixes", with_views(["truth"], body="""
    SELECT uen, substr(ssic_code, 1, 2) AS division, substr(ssic_code, 1, 3) AS group_code,
           substr(ssic_code, 1, 4) AS class_code, substr(ssic_code, 1, 5) AS sub_class,
           substr(ssic_code2, 1, 2) AS division2, substr(ssic_code2, 1, 3) AS group_code2,
           substr(ssic_code2, 1, 4) AS class_code2, substr(ssic_code2, 1, 5) AS sub_class2
    FROM truth"""))
def code_prefixes(spark, sf_dir):
    t = FX.truth(spark, sf_dir)
    cols = [C.code_prefix("ssic_code", n).alias(a) for n, a in ((2, "division"), (3, "group_code"), (4, "class_code"), (5, "sub_class"))]
    cols += [C.code_prefix("ssic_code2", n).alias(a + "2") for n, a in ((2, "division"), (3, "group_code"), (4, "class_code"), (5, "sub_class"))]
    return t.select("uen", *cols)


@register("pad_code", """
    SELECT c_custkey, CASE WHEN length(x) < 5 THEN lpad(x, 5, '0') ELSE x END AS ssic_code
    FROM (SELECT c_custkey, CAST((c_custkey * 37) % 100000 AS VARCHAR) AS x FROM customer) t""")
def pad_code(spark, sf_dir):
    from codelens.sources.tables import read_table

    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.pad_code(F.col("c_custkey") * 37 % 100000).alias("ssic_code"))


@register("cast_code", with_views(["dictionary"], body=
    "SELECT code, TRY_CAST(code AS BIGINT) AS code_int FROM dictionary"))
def cast_code(spark, sf_dir):
    return FX.dictionary(spark, sf_dir).select("code", C.code_as_int("code").alias("code_int"))


def _clean_sql(c):
    return f"trim(regexp_replace(replace(replace({c}, chr(10), ' '), '•', '- '), '\\s+', ' ', 'g'))"


@register("build_description", _flat_sql(
    f"SELECT code, title || '.' || {_clean_sql('definition')} || '.' || {_clean_sql('examples')} AS description FROM flat"))
def build_description(spark, sf_dir):
    f = flat(spark, sf_dir)
    return f.select("code", X.build_description(F.col("title"), X.clean_text("definition"), X.clean_text("examples")).alias("description"))


@register("level_counts", _flat_sql("""
    SELECT level, key, count(*) AS n FROM (
      SELECT 'Section' AS level, section AS key FROM flat UNION ALL
      SELECT 'Division', division FROM flat UNION ALL
      SELECT 'Group', group_code FROM flat UNION ALL
      SELECT 'Class', class_code FROM flat UNION ALL
      SELECT 'Sub-class', code FROM flat) x GROUP BY level, key"""))
def level_counts(spark, sf_dir):
    return TX.level_counts(flat(spark, sf_dir))


@register("encode_labels", _flat_sql(
    "SELECT division, CAST(dense_rank() OVER (ORDER BY division) - 1 AS INTEGER) AS encoded "
    "FROM (SELECT DISTINCT division FROM flat WHERE division IS NOT NULL) x"))
def encode_labels(spark, sf_dir):
    return TX.encode_labels(flat(spark, sf_dir), "division")


@register("decode_predictions", with_views(["vectors", "dictionary"], *_RANKED_CTES, *FLAT_CTES,
    ("enc", "SELECT division, CAST(dense_rank() OVER (ORDER BY division) - 1 AS INTEGER) AS encoded "
            "FROM (SELECT DISTINCT division FROM flat WHERE division IS NOT NULL) x"),
    body="""SELECT r.vec_id, r.rank, r.code AS encoded, e.division, d.division_title, r.sim
            FROM ranked r LEFT JOIN enc e ON r.code = e.encoded LEFT JOIN tx_div d ON e.division = d.division"""))
def decode_predictions(spark, sf_dir):
    """Encoded predictions -> Division code -> Division title (two broadcast
    left joins; the label table is bounded by the code domain)."""
    f = flat(spark, sf_dir)
    enc = TX.encode_labels(f, "division")
    titles = TX.level_table(FX.dictionary(spark, sf_dir), "Division")
    pred = PJ.ranked_candidates(spark, sf_dir).select("vec_id", F.col("code").alias("encoded"), "rank", "sim")
    out = pred.join(F.broadcast(enc), "encoded", "left").join(F.broadcast(titles), "division", "left")
    return out.select("vec_id", "rank", "encoded", "division", "division_title", "sim")


@register("declared_titles", with_views(["truth", "dictionary"], body="""
    SELECT t.uen, t.ssic_code, d1.title AS title1, t.ssic_code2, d2.title AS title2
    FROM truth t LEFT JOIN dictionary d1 ON t.ssic_code = d1.code
    LEFT JOIN dictionary d2 ON t.ssic_code2 = d2.code"""))
def declared_titles(spark, sf_dir):
    t = FX.truth(spark, sf_dir)
    d = FX.dictionary(spark, sf_dir).select("code", "title")
    d1 = d.select(F.col("code").alias("ssic_code"), F.col("title").alias("title1"))
    d2 = d.select(F.col("code").alias("ssic_code2"), F.col("title").alias("title2"))
    return t.join(F.broadcast(d1), "ssic_code", "left").join(F.broadcast(d2), "ssic_code2", "left").select(
        "uen", "ssic_code", "title1", "ssic_code2", "title2"
    )


@register("exact_dedupe", _flat_sql("SELECT title, min(code) AS code FROM flat GROUP BY title"))
def exact_dedupe(spark, sf_dir):
    """Dedupe by title; the surviving row is the one with the smallest code."""
    return R.first_by_key(flat(spark, sf_dir), "title", "code", []).select("title", "code")


@register("union_tables", with_views(["dictionary", "index_entries"], body="""
    SELECT code, title, groups, definition, examples FROM dictionary
    UNION ALL SELECT code, NULL, NULL, definition, NULL FROM index_entries"""))
def union_tables(spark, sf_dir):
    """The dictionary with the alphabetical index below it; columns that the index lacks are null."""
    return FX.dictionary(spark, sf_dir).unionByName(FX.index(spark, sf_dir), allowMissingColumns=True)


@register("sort_tables", with_views(["truth"], body="SELECT * FROM truth ORDER BY company, ssic_code"))
def sort_tables(spark, sf_dir):
    return FX.truth(spark, sf_dir).orderBy("company", "ssic_code")
