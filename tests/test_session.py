"""Where intermediate data may go, and feeds that end."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weighbridge.session import shared_dir
from weighbridge.streaming import feeds


def test_a_cluster_needs_a_shared_folder():
    fake = lambda named: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master="spark://host:7077"))
    assert shared_dir(fake("hdfs:///scratch")) == "hdfs:///scratch"
    with pytest.raises(RuntimeError):
        shared_dir(fake(None))


def test_a_streamed_feed_equals_the_batch(spark, tmp_path):
    rows = spark.range(50).select((F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 7).cast("int"))).alias("ts"), F.lit("a").alias("phase"),
                                  F.col("id").alias("used"), (100 - F.col("id")).alias("free"))
    rows.unionByName(feeds.closing_row(rows, "ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = feeds.drain(feeds.telemetry_windows(stream), f"{tmp_path}/out").agg(F.count(F.lit(1)).alias("windows"), F.sum("samples").alias("samples")).first()
    assert (got["windows"], got["samples"]) == (6, 50)
    assert feeds.closing_row(rows.filter("false"), "ts").count() == 0
