"""Ranking, top-k, dedupe and ordering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this many rows a top-k is not gathered by TakeOrderedAndProject (whose
# final merge runs in one task) but computed with a distributed sort.
SMALL_TOP_K = 100_000


def top_rows(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First k rows of ``df`` in ``order`` (order must be total for exactness)."""
    if k <= 0:
        return df.limit(0)
    if k <= SMALL_TOP_K:
        return df.orderBy(*order).limit(k)
    # Distributed: range-partition by the order, checkpoint so both passes see
    # the same partitions, number the rows within each, count rows per partition
    # (one small row per partition), and keep rows whose global position is < k.
    sorted_df = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # one row per partition
    numbered = sorted_df.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    out = numbered.join(F.broadcast(offsets.select("_pid", "_off")), "_pid").where(F.col("_off") + F.col("_rn") <= k)
    return out.drop("_pid", "_rn", "_off").orderBy(*order)


def row_number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k_within(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top-k per group; Spark plans it with a partial WindowGroupLimit before
    the shuffle, so at most k rows per group and map task are exchanged."""
    return row_number_within(df, keys, order, name).where(F.col(name) <= k)


def first_by_key(df: DataFrame, key: str, order_col: str, cols: list[str]) -> DataFrame:
    """Row with the smallest ``order_col`` per key, via min_by (partial
    aggregation, no sort): sort by (key, order_col), keep first."""
    r = F.min_by(F.struct(*[F.col(c) for c in [order_col, *cols]]), F.col(order_col))
    return df.groupBy(key).agg(r.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in [order_col, *cols]])


def dedupe(df: DataFrame, subset: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Whole-row dedupe, or dedupe by ``subset`` keeping the row with the
    smallest ``order`` value (the input-order 'keep first' of pandas has no
    meaning on distributed data)."""
    if subset is None:
        return df.dropDuplicates()
    if order is None:
        return df.dropDuplicates(subset)
    rest = [c for c in df.columns if c not in subset]
    r = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order))
    return df.groupBy(*subset).agg(r.alias("_r")).select(*subset, *[F.col(f"_r.{c}").alias(c) for c in rest])
