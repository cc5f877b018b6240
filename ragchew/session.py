"""Spark session defaults for the library and its tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for the jobs in this package. AQE re-plans joins at runtime
# (small sides become broadcasts, skewed partitions are split) and coalesces
# the post-shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # keep small-but-CPU-heavy stages (smoothing windows) spread over cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Let a join on (log, chunk, seq) reuse the (log, chunk) hash partitioning
    # of the big side: chunks bound the partition size, so no skew follows.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ragchew") -> SparkSession:
    """Return (or create) a session with the package defaults.

    On a cluster the session already exists and keeps its own settings; the
    defaults here only fill what is unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RAGCHEW_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Only when the session names none and runs in local mode (tests) is a
    scratch folder set, on the context (the setting itself is fixed once a
    session runs); on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.getCheckpointDir() and not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ragchew-ckpt-"))
    return named or sc.getCheckpointDir()


# Session settings the library's plans rely on (performance only, never
# semantics). Applied to whatever session the caller hands in.
PLAN_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> None:
    """Apply ``PLAN_CONF`` and make sure a checkpoint folder is known."""
    for key, value in PLAN_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    checkpoint_dir(spark)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for so many rows: their number grows with the rows, so that what one task holds does not."""
    return max(spark.sparkContext.defaultParallelism, -(-int(rows) // rows_per_task))


def materialize(df, what: str, by: list[str] | None = None):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: later branches scan it with column pruning instead of
    recomputing its lineage (which is cut, so lost executors cost nothing).
    With ``by``, a folder for each value of these columns. The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
