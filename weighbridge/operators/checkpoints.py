"""Checkpoint choice from an evaluation log: one row per (run, update)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_select(log: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per run: the update of lowest development loss (earliest on ties) and whether it beats the unchanged base.

    All aggregates, so a run of any length is combined in parts.
    """
    best = F.min(F.struct("dev_nll", "update", "dev_accuracy"))
    base = F.min(F.struct("update", "dev_nll", "dev_accuracy"))
    out = log.groupBy("run").agg(best.alias("b"), base.alias("z"))
    passed = (F.col("b.update") > 0) & (F.col("b.dev_nll") < F.col("z.dev_nll")) & (F.col("b.dev_accuracy") >= F.col("z.dev_accuracy") - tolerance)
    return out.select("run", F.col("b.update").alias("update"), F.col("b.dev_nll").alias("dev_nll"), F.col("b.dev_accuracy").alias("dev_accuracy"), passed.alias("passed"))


def stale_streak(log: DataFrame, patience: int = 2) -> DataFrame:
    """Per evaluation: whether it set a new best, how many in a row did not, and whether training stops there.

    A run's log has one row per evaluation step, a few thousand at most, so one window per run is small.
    """
    before = Window.partitionBy("run").orderBy("update").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run").orderBy("update").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("improved", F.coalesce(F.col("dev_nll") < F.min("dev_nll").over(before), F.lit(True)))
    rows = rows.withColumn("_island", F.sum(F.col("improved").cast("int")).over(upto))
    inside = Window.partitionBy("run", "_island").orderBy("update").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stale", F.count_if(~F.col("improved")).over(inside)).drop("_island")
    stopped = F.coalesce(F.max((F.col("stale") >= patience).cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("stops_here", (F.col("stale") >= patience) & ~stopped).withColumn("after_stop", stopped)
