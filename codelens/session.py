"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, AQE) are read from the
session when present; the defaults here only fill what is unset, which is the
local/test case.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session. AQE re-plans joins and coalesces
# partitions at runtime; skew-join splits hot keys in sort-merge joins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    # Broadcast only on measured sizes: the static planner's estimates can be
    # far off after explode/aggregate, so it never broadcasts by itself; AQE
    # broadcasts a join side whose actual shuffle output is small. Explicit
    # F.broadcast is kept for tables bounded by construction (code levels).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "codelens", shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CODELENS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Runtime SQL settings the jobs rely on; applied to any session handed in.
RUNTIME_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # a join on (doc, term) may reuse a partitioning by doc alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the broadcast/AQE policy to a session created elsewhere."""
    for k, v in RUNTIME_SQL_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) do we make a scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        # a machine-local folder would not survive the loss of an executor
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="codelens-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialized tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
