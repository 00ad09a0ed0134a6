"""Match company names across sources and attach declared codes.

Every join here is an equi-join on a business key (company name or UEN). The
truth table can be as large as the company base, so it is not broadcast: the
exact-name and stripped-name lookups are both aggregated by name and then
joined on the same key, which lets one exchange of the text side serve both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.text import strip_trailing_dot

# Fixed value: marker for a company without a profile page.
NOT_FOUND = "linkedin page not found"


def name_lookup(truth: DataFrame, name: str = "company", code: str = "ssic_code", strip_dot: bool = False) -> DataFrame:
    """One row per (optionally dot-stripped) name with its smallest code.
    Truth rows without a code are dropped first, so the stripped lookup
    cannot fan out."""
    t = truth.where(F.col(code).isNotNull())
    key = strip_trailing_dot(name) if strip_dot else F.col(name)
    return t.select(key.alias(name), F.col(code)).groupBy(name).agg(F.min(code).alias(code))


def reconcile(df: DataFrame, truth: DataFrame, name: str = "company", code: str = "ssic_code") -> DataFrame:
    """Exact name match, else match after stripping a trailing '.' on the
    truth side. One lookup keyed by both forms of the name, and one left join."""
    t = truth.where(F.col(code).isNotNull())
    none = F.lit(None).cast(truth.schema[code].dataType)
    both = t.select(F.col(name), F.col(code).alias("_exact"), none.alias("_loose")).union(
        t.select(strip_trailing_dot(name), none, F.col(code))
    )
    # written first: with a plain table on this side, Spark may split the rows of a hot name on the other
    lookup = both.groupBy(name).agg(F.coalesce(F.min("_exact"), F.min("_loose")).alias(code)).checkpoint(eager=True)
    return df.join(lookup, name, "left")


def attach_code(df: DataFrame, truth: DataFrame, on: str = "company", code: str = "ssic_code") -> DataFrame:
    """Plain left join of text rows to declared codes (one code per key)."""
    return df.join(name_lookup(truth, on, code).checkpoint(eager=True), on, "left")


def join_two_sources(report: DataFrame, profile: DataFrame, key: str = "company", text: str = "text") -> DataFrame:
    """report LEFT JOIN profile on key; text = report + '.' + (profile or '')."""
    p = profile.select(F.col(key), F.col(text).alias("_ptext"))
    j = report.join(p, key, "left")
    return j.withColumn(text, F.concat(F.col(text), F.lit("."), F.coalesce("_ptext", F.lit("")))).drop("_ptext")


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted by ``keys``, then ``order``, over range partitions, with ``_place``, a number that grows along.

    The rows of one key, however many, lie in as many partitions as they need. The
    sample of keys that range partitioning takes would run the work behind ``df``
    twice, so ``df`` is written first (a reliable checkpoint).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.checkpoint(eager=True).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return ranged.withColumn("_place", F.monotonically_increasing_id())


def concat_texts(df: DataFrame, keys: list[str], text: str, order: list[str], sep: str = " ") -> DataFrame:
    """One text per key: texts joined with ``sep`` in ``order``; null texts are left out.

    Rows are put in order over range partitions, so a key that holds half of all
    rows is sorted and gathered in pieces by many tasks. Only the last step, which
    makes one row of a key's pieces, is one task a key: the row is the result.
    """
    rows = in_order(df.select(*keys, *order, text).where(F.col(text).isNotNull()), keys, order)
    pieces = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", text))).alias("_pieces"))
    joined = F.array_join(F.transform("_pieces", lambda p: p[text]), sep)
    return pieces.select(*keys, joined.alias(text))


def placeholder_rows(companies: DataFrame, profiles: DataFrame, key: str = "company",
                     page_col: str = "page_url", fields: tuple[str, ...] = ("category", "website", "text")) -> DataFrame:
    """Every company, with its profile fields or the not-found marker and ''."""
    j = companies.join(profiles, key, "left")
    found = F.col(page_col).isNotNull()
    cols = [F.when(found, F.col(page_col)).otherwise(F.lit(NOT_FOUND)).alias(page_col)]
    cols += [F.when(found, F.coalesce(F.col(f), F.lit(""))).otherwise(F.lit("")).alias(f) for f in fields]
    return j.select(key, *cols)
