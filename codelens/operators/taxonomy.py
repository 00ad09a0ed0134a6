"""Code dictionary -> flat five-level hierarchy.

Level tables are bounded by the code domain (at most 26 Sections, 100
Divisions, 1,000 Groups, 10,000 Classes), so they are broadcast; the sub-class
side is never shuffled for the flatten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions.codes import LEVEL_LENGTHS, code_prefix
from codelens.functions.text import blank_to_empty

LEVEL_COLS = {
    "Section": ("section", "section_title"),
    "Division": ("division", "division_title"),
    "Group": ("group_code", "group_title"),
    "Class": ("class_code", "class_title"),
}


def level_rows(dictionary: DataFrame, level: str, code: str = "code") -> DataFrame:
    """Rows whose code has the length of ``level``."""
    return dictionary.where(F.length(code) == LEVEL_LENGTHS[level])


def with_level(dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Every row of a known level with ``level``, told by the length of its code."""
    level = F.lit(None).cast("string")
    for name, n in LEVEL_LENGTHS.items():
        level = F.when(F.length(code) == n, F.lit(name)).otherwise(level)
    return dictionary.withColumn("level", level).where(F.col("level").isNotNull())


def drop_section_rows(dictionary: DataFrame, code: str = "code") -> DataFrame:
    return dictionary.where(~F.col(code).rlike("^[A-Z]$"))


def split_bullets(df: DataFrame, col: str, out: str = "item") -> DataFrame:
    """Split a newline-bullet list into rows (null list kept as a null row),
    remove the bullet marks."""
    items = F.split(F.col(col), "\n•")
    return df.withColumn(out, F.explode_outer(items)).withColumn(out, F.replace(F.col(out), F.lit("•"), F.lit("")))


def section_table(dictionary: DataFrame) -> DataFrame:
    """(section, section_title, division) from the Section rows' Division lists."""
    s = split_bullets(level_rows(dictionary, "Section").select("code", "title", "groups"), "groups")
    return s.select(
        F.col("code").alias("section"),
        F.col("title").alias("section_title"),
        F.substring("item", 1, 2).alias("division"),
    ).dropDuplicates()


def level_table(dictionary: DataFrame, level: str) -> DataFrame:
    """(level code, level title), one row per code."""
    code_col, title_col = LEVEL_COLS[level]
    return level_rows(dictionary, level).select(
        F.col("code").alias(code_col), F.col("title").alias(title_col)
    ).dropDuplicates()


def flatten(dictionary: DataFrame) -> DataFrame:
    """Sub-class rows with the code and title of every level above them.

    Left joins on code prefixes against broadcast level tables.
    """
    sub = level_rows(dictionary, "Sub-class").select(
        "code",
        "title",
        blank_to_empty("definition").alias("definition"),
        blank_to_empty("examples").alias("examples"),
    )
    sub = (
        sub.withColumn("division", code_prefix("code", 2))
        .withColumn("group_code", code_prefix("code", 3))
        .withColumn("class_code", code_prefix("code", 4))
    )
    sections = section_table(dictionary)
    out = sub.join(F.broadcast(sections), "division", "left")
    out = out.join(F.broadcast(level_table(dictionary, "Division")), "division", "left")
    out = out.join(F.broadcast(level_table(dictionary, "Group")), "group_code", "left")
    out = out.join(F.broadcast(level_table(dictionary, "Class")), "class_code", "left")
    return out.select(
        "code", "title", "definition", "examples",
        "section", "section_title", "division", "division_title",
        "group_code", "group_title", "class_code", "class_title",
    )


def encode_labels(labels: DataFrame, label: str, name: str = "encoded") -> DataFrame:
    """Distinct labels -> dense integer in sorted order (0-based).

    The window has no partition key, but it runs over the distinct label set,
    which is bounded by the code domain, never over a fact table.
    """
    d = labels.select(label).where(F.col(label).isNotNull()).distinct()
    return d.withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))


LEVEL_KEYS = {"Section": "section", "Division": "division", "Group": "group_code", "Class": "class_code", "Sub-class": "code"}


def level_counts(flat: DataFrame) -> DataFrame:
    """Rows per Section/Division/Group/Class/Sub-class: one aggregate over five grouping sets
    (partial aggregation before the shuffle). A row without a code at a level counts under null there."""
    keys = list(LEVEL_KEYS.values())
    counted = flat.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*keys).alias("_set"))
    # the set of the first key has the bits of all the others, and so on
    every = (1 << len(keys)) - 1
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, column) in enumerate(LEVEL_KEYS.items()):
        mine = F.col("_set") == every - (1 << (len(keys) - 1 - i))
        level, key = F.when(mine, F.lit(name)).otherwise(level), F.when(mine, F.col(column)).otherwise(key)
    return counted.select(level.alias("level"), key.alias("key"), "n")


def cascade_search(flat: DataFrame, section: str = "", code: str = "", title: str = "") -> DataFrame:
    """Optional case-insensitive regex filters, ANDed; empty ones are skipped."""
    out = flat
    for col, pat in (("section", section), ("code", code), ("title", title)):
        if pat:
            out = out.where(F.col(col).rlike("(?i)" + pat))
    return out
