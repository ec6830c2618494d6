"""Totals of a run that is still being written."""

from pyspark.sql import functions as F

from tests.test_scoring import PREDICTION, RECORD, pred, rec
from weighbridge.streaming import feeds


def test_totals_after_every_batch_and_a_replay(spark, tmp_path):
    records = spark.createDataFrame([rec(str(i), "noul", [], "1", source="even" if i % 2 == 0 else "odd") for i in range(8)], RECORD)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([pred(str(i), noul=0.9 if i < 6 else 0.1) for i in range(8)], PREDICTION).drop("input_sha256")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1767225600) + F.col("id").cast("int")))
    counts = lambda version=None: {r["source"]: (r["n"], r["correct"]) for r in feeds.totals_at(spark, f"{out}/data", version).collect()}

    def arrive(ids):
        some = rows.filter(F.col("id").isin(*ids))
        some.unionByName(some).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        query = feeds.running_totals(stream, records, f"{out}/data", f"{out}/state")
        query.awaitTermination()
        return query.lastProgress["batchId"]

    first = arrive(["0", "1", "2", "3"])
    assert counts() == {"even": (2, 2), "odd": (2, 2)}
    last = arrive(["0", "4", "6"])  # one of them was counted before
    assert last > first and counts(first) == {"even": (2, 2), "odd": (2, 2)}
    assert counts() == {"even": (4, 3), "odd": (2, 2)}
    # What a failure between the sink and the commit leaves behind: the batch is run again.
    commits = sorted((tmp_path / "out" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest = commits[-1]
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    feeds.running_totals(stream, records, f"{out}/data", f"{out}/state").awaitTermination()
    assert counts() == {"even": (4, 3), "odd": (2, 2)}
