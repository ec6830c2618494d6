"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # A batch for a Python worker is bounded by its bytes as well: ten thousand rows may be ten thousand long texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# Rows a broadcast side may have after it was counted; every such side is a few narrow columns.
BROADCAST_ROWS = 2_000_000


def local_session(cores: int = 8, partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("weighbridge")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        # Call-site capture per column expression is most of the time it takes to build a wide plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; partition counts are left to the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a fresh temporary one where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared place."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later steps neither recompute it nor lose it with an executor, and its real size is known to the optimizer.
    The work runs once, where a checkpoint would run it twice.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a row bound is known and low; otherwise the join shuffles."""
    if rows is not None and rows <= limit:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Hash-split a freshly read table that arrives in fewer pieces than there are cores.

    A table of many files comes back as it is; one small file would otherwise keep all work before the first
    shuffle in a single task. Where rows multiply afterwards, `times` cuts the pieces so much finer.
    """
    cores, pieces = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, pieces) * times, *keys) if pieces < cores or times > 1 else df
