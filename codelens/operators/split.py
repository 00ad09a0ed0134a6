"""Seeded, order-free train/test splits and folds.

A row's side is decided by a hash of its business key, so the split is the same
on every run, on any number of partitions, and in DuckDB: the bucket is the
first 7 hex digits of md5(key[#seed]) read as an integer, mod 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(key, seed: str | int | None = None, buckets: int = 100) -> Column:
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    if seed is not None:
        k = F.concat(k, F.lit("#" + str(seed)))
    return (F.conv(F.substring(F.md5(k), 1, 7), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def train_test_split(
    df: DataFrame, key: str, train_pct: int = 70, seed: str | int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Return (train, test): train holds keys whose bucket < train_pct.

    Both sides are filters over the same scan; no shuffle, no sampling state.
    """
    b = hash_bucket(key, seed)
    return df.where(b < train_pct), df.where(b >= train_pct)


def with_split_flag(df: DataFrame, key: str, train_pct: int = 70, seed=None, name: str = "is_train") -> DataFrame:
    return df.withColumn(name, hash_bucket(key, seed) < train_pct)


def anti_split_test(df: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Test = rows whose key is not in train (left anti join on the key)."""
    return df.join(train.select(key).distinct(), key, "left_anti")


def with_fold(df: DataFrame, key: str, folds: int = 5, seed=None, name: str = "fold") -> DataFrame:
    """Assign each key to one of ``folds`` folds by the same md5 bucket rule."""
    return df.withColumn(name, hash_bucket(key, seed, folds))


def _is_train(key: str, trial: Column, train_pct: int) -> Column:
    k = F.concat(F.col(key).cast("string"), F.lit("#"), trial.cast("string"))
    return (F.conv(F.substring(F.md5(k), 1, 7), 16, 10).cast("bigint") % F.lit(100)).cast("int") < train_pct


def with_trials(df: DataFrame, key: str, trials: int, train_pct: int = 70, packed: bool = False) -> DataFrame:
    """One row per (trial, key) with the trial's train/test flag.

    Trials run as one job: the trial id is a column, seeded by its number, so
    k repeats cost one scan instead of k separate jobs. ``packed``: a row stays one
    row, with the arrays train_trials and test_trials.
    """
    numbers = F.sequence(F.lit(1), F.lit(trials))
    if packed:
        train = F.filter(numbers, lambda t: _is_train(key, t, train_pct))
        test = F.filter(numbers, lambda t: ~_is_train(key, t, train_pct))
        return df.withColumn("train_trials", train).withColumn("test_trials", test)
    t = df.withColumn("trial", F.explode(numbers))
    return t.withColumn("is_train", _is_train(key, F.col("trial"), train_pct))
