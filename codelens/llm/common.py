"""Shared helpers: intermediate tables in the cluster's shared folder, word
hashing inside tasks, and distributed connected components."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not the
    work above it. Every call takes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes in DuckDB SQL: shifts and a table made by eight steps a byte."""
    step = "list_transform({0}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    table = "range(256)"
    for _ in range(8):
        table = step.format(table)
    body = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    fold = f"list_reduce({body}, lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), 4294967295)"
    return f"(SELECT xor({fold}, 4294967295) FROM (SELECT {table} AS t) crc_table)"


def worker_state(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks.

    One operator at a time: another owner's entries go first, so that the stages
    of a pipeline do not pile up in a worker.
    """
    name = "codelens_llm_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    state = sys.modules[name].__dict__
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component = smallest node id.

    Each round a node takes the smallest label among its neighbours, hands it to
    the node that its old label names, then jumps to its label's label; rounds
    end when no label falls. Labels and edges are read from written tables, so
    that a hub's rows are an ordinary skewed join side, which AQE splits, and
    the minima are combined before they are shuffled.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = stored(e.union(e.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        .select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    total = _label_sum(labels)
    while total is not None:
        seen = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node"))
        both_labels = labels.join(seen.agg(F.min("label").alias("near")), "node")
        low = F.least("label", "near")
        proposals = both_labels.select("node", low.alias("label")).union(
            both_labels.where("near < label").select(F.col("label").alias("node"), F.col("near").alias("label"))
        )
        hooked = stored(proposals.groupBy("node").agg(F.min("label").alias("label")), "labels")
        parents = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        before, labels = labels, stored(hooked.join(parents, "label").select("node", F.col("up").alias("label")), "labels")
        discard(before, hooked)
        now = _label_sum(labels)
        if now == total:
            break
        total = now
    discard(both)
    return labels.select("node", F.col("label").alias("component"))


def _label_sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
