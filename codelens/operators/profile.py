"""Table profiling: duplicate counts, describe, row counts per step.

Each is one pass with partial aggregation; results are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that repeat an earlier value, per column (null counts as a value).
    Strings are compared by their SHA-256, so that no text is shuffled."""
    def key(c: str) -> Column:
        return F.sha2(F.col(c), 256) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)

    aggs = [
        (F.count(F.lit(1)) - F.count_distinct(key(c)) - F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)).cast("bigint")).alias(f"dup_{c}")
        for c in cols
    ]
    return df.agg(*aggs)


def describe_text_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """count / unique / top / freq per column; the most frequent value wins,
    ties go to the smallest value.

    Values are unpivoted to (column_name, v) and aggregated by both, then by
    column: two partial aggregates, no window over a large group.
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("s")
    ).select("s.column_name", "s.v").where(F.col("v").isNotNull())
    g = stacked.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("n_count"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("top"),
        F.max("n").alias("freq"),
    )


def step_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Row counts after each step, computed in one pass and unpivoted to
    (step, n)."""
    one = df.agg(*[agg.alias(name) for name, agg in steps.items()])
    return one.unpivot([], list(steps), "step", "n")
