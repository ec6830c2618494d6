"""Sampled memory series: what each phase used and left free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def telemetry_phases(df: DataFrame) -> DataFrame:
    """Per phase: samples, highest use, its rise over the very first sample, and lowest free. df: ts, phase, used, free."""
    sets = df.groupingSets([["phase"], []], "phase").agg(
        F.count(F.lit(1)).alias("samples"), F.max("used").alias("max_used"), F.min("free").alias("min_free"),
        F.min(F.struct("ts", "used")).alias("_first"), F.grouping("phase").alias("_all"),
    )
    # One row per phase plus the total: a window over that handful, never over samples.
    base = F.max(F.when(F.col("_all") == 1, F.col("_first.used"))).over(Window.partitionBy(F.lit(0)))
    return sets.withColumn("max_delta", F.col("max_used") - base).filter(F.col("_all") == 0).select("phase", "samples", "max_used", "max_delta", "min_free")


def headroom_alert(df: DataFrame, floor: float) -> DataFrame:
    """Summaries whose lowest free memory broke the floor. Works on batch and streaming summaries."""
    return df.filter(F.col("min_free") < floor)
