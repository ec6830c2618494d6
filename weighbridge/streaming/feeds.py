"""Streaming forms: telemetry windows, running metrics and request validation.

All state is bounded by watermarks, and sinks are keyed by batch, so a restarted query repeats nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weighbridge.operators.requests import validate_requests
from weighbridge.operators.scoring import METRICS, score_joined


def closing_row(rows: DataFrame, ts: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """One row with only a time, far enough behind the last of rows to close all their windows.

    A stream gives out a window when its watermark passes the window's end, so a feed that ends needs an event after it. No rows, no end.
    """
    later = F.max(ts) + 2 * F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {delay}")
    end = rows.agg(later.alias(ts)).filter(F.col(ts).isNotNull())
    return end.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def telemetry_windows(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per tumbling window and phase: samples, highest use, rise over the window's first sample, lowest free."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "phase").agg(
        F.count(F.lit(1)).alias("samples"), F.max("used").alias("max_used"), F.min("free").alias("min_free"), F.min(F.struct("ts", "used")).alias("_first"))
    return agg.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "phase", "samples", "max_used",
        (F.col("max_used") - F.col("_first.used")).alias("max_delta"), "min_free")


def _scored_arrivals(stream: DataFrame, records: DataFrame, delay: str) -> DataFrame:
    """Predictions met with their records and scored; repeated ids within the watermark count once."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    joined = once.select("id", "ts", F.col("error").alias("_error"), F.col("answer").alias("_answer"), "latency_ms", F.lit(True).alias("_has")).join(records, "id")
    return score_joined(joined)


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if("correct").alias("correct"),
        *[F.sum(m).alias(f"{m}_sum") for m in METRICS], *[F.count(m).alias(f"{m}_n") for m in METRICS],
    ]


def streaming_metrics(stream: DataFrame, records: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Score predictions as they arrive; per window and source: n, valid, correct and metric sums with their counts.

    Repeated ids within the watermark count once. Sums add up over windows, so totals to date come from the sink.
    """
    out = _scored_arrivals(stream, records, delay).groupBy(F.window("ts", width), "source").agg(*_sums())
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def running_totals(stream: DataFrame, records: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Totals by source while a run is appended, held as state: every micro-batch writes the sources it changed under its number.

    State is one row of sums a source, and ids within the watermark. A batch that runs again after a failure overwrites its own version,
    so the sink never counts it twice.
    """
    totals = _scored_arrivals(stream, records, delay).groupBy("source").agg(*_sums())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The totals as they stood after a micro-batch, the last one by default: every source's newest row up to it."""
    rows = spark.read.parquet(path)
    if version is not None:
        rows = rows.filter(F.col("version") <= version)
    sums = [c for c in rows.columns if c not in ("source", "version")]
    return rows.groupBy("source").agg(F.max_by(F.struct(*sums), "version").alias("s")).select("source", "s.*")


def running_report(sums: DataFrame) -> DataFrame:
    """Totals to date per source from the streamed sums."""
    n = F.sum("n")
    return sums.groupBy("source").agg(
        n.alias("n"), F.sum("valid").alias("valid"), F.sum("correct").alias("correct"), (F.sum("correct") / n).alias("accuracy"),
        *[(F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(m) for m in METRICS],
    )


def validate_stream(stream: DataFrame, models: Sequence[str], valid_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Valid requests to one folder, quarantined ones with reasons to another. A repeated batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        checked = validate_requests(batch, models).persist()
        good = F.size("reasons") == 0
        checked.filter(good).drop("reasons").write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        checked.filter(~good).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(result: DataFrame, path: str) -> DataFrame:
    """Run a streaming frame over everything available into Parquet and read that back."""
    spark = result.sparkSession
    schema = result.schema
    query = result.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/data")
