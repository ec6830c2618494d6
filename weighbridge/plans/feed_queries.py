"""Queries: sources and sinks, inventories, telemetry, streams and vector blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators import telemetry, vectors
from weighbridge.plans.conversion_queries import _REASON, MODELS, requests
from weighbridge.plans.fixtures import decisions, r6, records, run, source_order, table
from weighbridge.plans.registry import query, view
from weighbridge.plans.scoring_queries import M, rounded
from weighbridge.session import scratch
from weighbridge.sources import inventory as inv
from weighbridge.sources import records as src
from weighbridge.streaming import feeds

RECORD = "id string, source string, state string, label string"


def _written(spark, d, compression: str | None = None) -> DataFrame:
    """The records written as a split and read back."""
    path = scratch(spark, "split") + "/train.jsonl"
    src.write_split(records(spark, d).select("id", "source", "state", "label"), path, compression)
    out = src.read_records(spark, path, RECORD)
    # One gzip file is one task; spread its rows before any further work.
    return out.repartition(spark.sparkContext.defaultParallelism) if compression else out


_BACK = "SELECT id, source, label, md5(state) AS state_md5 FROM fx_records"


@query("s01_read_records", _BACK)
def _s01(spark, d):
    return _written(spark, d).select("id", "source", "label", F.md5("state").alias("state_md5"))


@query("s02_read_gz", _BACK)
def _s02(spark, d):
    return _written(spark, d, "gzip").select("id", "source", "label", F.md5("state").alias("state_md5"))


@query("s03_read_parquet", "SELECT source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def _s03(spark, d):
    docs = src.read_table(spark, f"{d}/documents.parquet")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("text").cast("bigint")).alias("chars"))


@query("s04_decode_records", """
SELECT id, sha256(to_json({'order': o_orderkey, 'status': o_orderstatus})::VARCHAR) AS state_sha256, o_orderstatus AS status,
  sha256('[' || to_json({'order': o_orderkey, 'status': o_orderstatus})::VARCHAR || ',{"instructions":"Open?","type":"noul"}]') AS input_sha256
FROM (SELECT 'o/' || o_orderkey AS id, * FROM orders)""")
def _s04(spark, d):
    # Keys out of order and spaced, as an upstream file may have them.
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit('{ "status": "'), F.col("o_orderstatus"), F.lit('", "order": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("state"),
        F.lit('{"type": "noul", "instructions": "Open?"}').alias("question"))
    out = src.decode_records(rows)
    return out.select("id", "state_sha256", F.variant_get("state", "$.status", "string").alias("status"), "input_sha256")


@query("s05_write_split", "SELECT count(*) AS rows, count(label) AS labelled, true AS refused_to_overwrite FROM fx_records")
def _s05(spark, d):
    path = scratch(spark, "split") + "/train.jsonl"
    rows = records(spark, d).select("id", "source", "state", "label")
    src.write_split(rows, path)
    try:
        src.write_split(rows, path)
        refused = False
    except Exception as e:
        refused = "EXIST" in str(e).upper()
    return src.read_records(spark, path, RECORD).agg(F.count(F.lit(1)).alias("rows"), F.count("label").alias("labelled")).withColumn("refused_to_overwrite", F.lit(refused))


@query("s07_inventory_verify", """
SELECT source AS name, CASE WHEN seq % 7 = 0 THEN 'extra' WHEN seq % 5 = 0 THEN 'size differs' WHEN seq % 3 = 0 THEN 'checksum differs' ELSE 'ok' END AS status FROM fx_order
UNION ALL SELECT source || '-lost', 'missing' FROM fx_order WHERE seq % 4 = 0""")
def _s07(spark, d):
    recs = records(spark, d)
    actual = inv.content_fingerprint(recs, ["id", "state_sha256"], ["source"]).withColumnRenamed("source", "name")
    seq = F.col("seq")
    told = actual.join(source_order(recs).withColumnRenamed("source", "name"), "name")
    manifest = told.filter(seq % 7 != 0).select("name", (F.col("rows") + F.when(seq % 5 == 0, 1).otherwise(0)).alias("rows"), (F.col("checksum") + F.when(seq % 3 == 0, 1).otherwise(0)).alias("checksum"))
    lost = told.filter(seq % 4 == 0).select(F.concat("name", F.lit("-lost")).alias("name"), "rows", "checksum")
    return inv.inventory_compare(actual, manifest.unionByName(lost), "name", "rows", "checksum")


SHARD_KEYS, SHARD_RANGE = 4000, 8192  # orders in one file, bytes in one hashed range: small, so that every file has several

_LINES = "o_orderkey || '|' || o_custkey || '|' || o_orderstatus || chr(10)"
view("fx_order_files", f"SELECT 'part=' || (o_orderkey // {SHARD_KEYS}) AS name, string_agg({_LINES}, '' ORDER BY o_orderkey) AS content FROM orders GROUP BY o_orderkey // {SHARD_KEYS}")


def order_files(spark, d) -> str:
    """Orders as text files of one block of keys each."""
    path = scratch(spark, "files")
    part = F.floor(F.col("o_orderkey") / SHARD_KEYS).alias("part")
    lines = table(spark, d, "orders").select(part, "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("s07_file_inventory", """
SELECT f.name, length(f.content) AS bytes, count(*) AS ranges, sha256(f.content) AS sha256, sha256(string_agg(sha256(substr(f.content, u.i * RANGE + 1, RANGE)), '' ORDER BY u.i)) AS range_sha256
FROM fx_order_files f, unnest(range(0, (length(f.content) + RANGE - 1) // RANGE)) AS u(i) GROUP BY f.name, f.content""".replace("RANGE", str(SHARD_RANGE)))
def _s07_files(spark, d):
    path = order_files(spark, d)
    part = F.substring_index("name", "/", 1).alias("name")
    whole = inv.file_inventory(spark, path, "*.txt").select(part, "sha256")
    return inv.range_inventory(spark, path, "*.txt", SHARD_RANGE).select(part, "bytes", "ranges", "range_sha256").join(whole, "name")


@query("s07_content_fingerprint", "SELECT source, count(*) AS rows, sum(('0x' || substr(md5(id || '|' || state_sha256), 1, 8))::BIGINT)::VARCHAR AS checksum FROM fx_records GROUP BY source")
def _s07_table(spark, d):
    return inv.content_fingerprint(records(spark, d), ["id", "state_sha256"], ["source"]).withColumn("checksum", F.col("checksum").cast("string"))


@query("s08_prior_crawl", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'train' ELSE 'eval' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'train.jsonl' WHEN 1 THEN 'dev.jsonl' ELSE 'test.jsonl' END AS file, id,
  CASE doc_id % 4 WHEN 1 THEN sha256(to_json(state)::VARCHAR) WHEN 0 THEN state_sha256 ELSE state_sha256 END AS state_sha256 FROM fx_records WHERE doc_id % 4 < 3
UNION SELECT 'train', 'train.jsonl', id || '/original', NULL FROM fx_records WHERE doc_id % 4 = 0""")
def _s08(spark, d):
    root = scratch(spark, "prior")
    recs = records(spark, d)
    slot = F.col("doc_id") % 4
    src.write_split(recs.filter(slot == 0).select("id", F.concat("id", F.lit("/original")).alias("record_id"), "state_sha256"), f"{root}/v1/train.jsonl")
    src.write_split(recs.filter(slot == 1).select("id", "state"), f"{root}/v1/dev.jsonl")
    src.write_split(recs.filter(slot == 2).select("id", "state_sha256"), f"{root}/v2/nested/test.jsonl")
    src.write_split(recs.filter(slot == 3).select("id", "state_sha256"), f"{root}/raw/upstream.jsonl")
    return inv.prior_keys(spark, [root])


# --- telemetry and streams -----------------------------------------------------------------------------------

def samples(events: DataFrame) -> DataFrame:
    """Events as memory samples: phase by hour of day, use from the value."""
    hour = F.hour("ts")
    phase = F.when(hour < 6, "load").when(hour < 12, "warmup").when(hour < 18, "mixed").otherwise("synthetic")
    used = F.round(F.col("value") * 100).cast("bigint")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), phase.alias("phase"), used.alias("used"), (F.lit(24000) - used).alias("free"))


view("fx_samples", """
SELECT event_id, ts, CASE WHEN hour(ts) < 6 THEN 'load' WHEN hour(ts) < 12 THEN 'warmup' WHEN hour(ts) < 18 THEN 'mixed' ELSE 'synthetic' END AS phase,
  round(value * 100)::BIGINT AS used, 24000 - round(value * 100)::BIGINT AS free FROM events""")
view("fx_windows", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, phase, count(*) AS samples, max(used) AS max_used, max(used) - arg_min(used, (ts, used)) AS max_delta, min(free) AS min_free
FROM fx_samples GROUP BY ALL""")


@query("g01_telemetry_phases", """
SELECT phase, count(*) AS samples, max(used) AS max_used, max(used) - (SELECT arg_min(used, (ts, used)) FROM fx_samples) AS max_delta, min(free) AS min_free FROM fx_samples GROUP BY phase""")
def _g01(spark, d):
    return telemetry.telemetry_phases(samples(table(spark, d, "events")))


def streamed_windows(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    # A pattern, because a stream reads folders or patterns, and the table may be either a file or a folder.
    given = spark.read.parquet(path)
    stream = samples(spark.readStream.schema(given.schema).parquet(path + "*"))
    # The end of the feed: a sample beyond every window, whose own window is never closed.
    folder = scratch(spark, "end")
    feeds.closing_row(samples(given), "ts").write.parquet(folder)
    ended = stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))
    return feeds.drain(feeds.telemetry_windows(ended), scratch(spark, "telemetry"))


@query("g01_telemetry_stream", "SELECT epoch(window_start)::BIGINT AS window_start, phase, samples, max_used, max_delta, min_free FROM fx_windows")
def _g01_stream(spark, d):
    return streamed_windows(spark, d).select(F.unix_timestamp("window_start").alias("window_start"), "phase", "samples", "max_used", "max_delta", "min_free")


@query("g04_headroom_alert", "SELECT epoch(window_start)::BIGINT AS window_start, phase, min_free FROM fx_windows WHERE min_free < 20000")
def _g04(spark, d):
    return telemetry.headroom_alert(streamed_windows(spark, d), 20000).select(F.unix_timestamp("window_start").alias("window_start"), "phase", "min_free")


# Predictions arrive over two days.
view("fx_arrivals", """
SELECT s.*, TIMESTAMP '2026-01-01' + INTERVAL (vec_id % 2880) MINUTE AS ts FROM fx_scored_new s WHERE vec_id % 59 <> 0""")


def _static(recs: DataFrame) -> DataFrame:
    return recs.drop("e", "k", "vec_id", "group", "family", "subset", "state", "input_sha256")


def _feed(spark, d) -> DataFrame:
    recs = decisions(spark, d)
    at = F.timestamp_seconds(F.lit(1767225600) + (F.col("vec_id") % 2880) * 60)
    return run(recs, "new").join(recs.select("id", at.alias("ts")), "id").select("id", "ts", "error", "answer", "latency_ms")


_TOTALS = ("SELECT source, count(*) AS n, count(*) FILTER (valid) AS valid, sum(correct)::BIGINT AS correct, round(sum(correct) / count(*), 6) AS accuracy, "
           + ", ".join(f"round(avg({m}) FILTER (valid), 6) AS {m}" for m in M) + " FROM fx_arrivals GROUP BY source")


@query("g02_streaming_metrics", _TOTALS)
def _g02(spark, d):
    feed = _feed(spark, d)
    folder = scratch(spark, "predictions")
    # Every prediction is delivered twice; the watermark removes the copy.
    feed.unionByName(feed).unionByName(feeds.closing_row(feed, "ts")).write.parquet(folder)
    stream = src.prediction_stream(spark, folder, feed.schema, "parquet")
    sums = feeds.drain(feeds.streaming_metrics(stream, _static(decisions(spark, d))), scratch(spark, "metrics"))
    return rounded(feeds.running_report(sums))


@query("g02_running_totals", _TOTALS)
def _g02_running(spark, d):
    feed = _feed(spark, d)
    folder, out = scratch(spark, "predictions"), scratch(spark, "totals")
    # The run arrives in two parts, each in full and each twice; the second stream goes on from the state of the first.
    for part in (0, 1):
        rows = feed.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part)
        rows.unionByName(rows).write.mode("append").parquet(folder)
        stream = src.prediction_stream(spark, folder, feed.schema, "parquet")
        feeds.running_totals(stream, _static(decisions(spark, d)), f"{out}/data", f"{out}/state", "4 days").awaitTermination()
    return rounded(feeds.running_report(feeds.totals_at(spark, f"{out}/data")))


@query("g03_stream_validate", f"SELECT request_id, {_REASON} AS reasons FROM fx_requests")
def _g03(spark, d):
    rows = requests(spark, d)
    folder = scratch(spark, "requests")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    feeds.validate_stream(stream, MODELS, f"{folder}/valid", f"{folder}/bad", f"{folder}/state").awaitTermination()
    good = spark.read.parquet(f"{folder}/valid").select("request_id", F.lit("").alias("reasons"))
    bad = spark.read.parquet(f"{folder}/bad").select("request_id", F.array_join("reasons", ";").alias("reasons"))
    return good.unionByName(bad)


@query("s11_prediction_stream", "SELECT id, source FROM fx_arrivals")
def _s11(spark, d):
    recs = decisions(spark, d)
    feed = run(recs, "new").select("id", "error", "latency_ms").join(recs.select("id", "source"), "id")
    folder = scratch(spark, "feed")
    src.write_split(feed, folder)
    stream = src.prediction_stream(spark, folder, feed.schema)
    return feeds.drain(stream.select("id", "source"), scratch(spark, "arrived"))


# --- vector blocks -------------------------------------------------------------------------------------------

BLOCK = 16


def _pairs(spark, d) -> DataFrame:
    """Two versions of every vector: as given, and moved a little towards itself shifted by one."""
    turned = F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1))
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"),
        F.zip_with("embedding", turned, lambda x, y: x.cast("double") + 0.25 * y.cast("double")).alias("b"))


view("fx_cells", f"""
SELECT vec_id, label, i, (i - 1) // {BLOCK} AS blk, a, b, b - a AS d, avg(abs(a)) OVER (PARTITION BY vec_id, (i - 1) // {BLOCK}) AS s
FROM (SELECT vec_id, label, u.i, embedding[u.i]::DOUBLE AS a, embedding[u.i]::DOUBLE + 0.25 * embedding[1 + u.i % 64]::DOUBLE AS b FROM embeddings, unnest(range(1, 65)) AS u(i))""")
view("fx_coded", "SELECT *, CASE WHEN s <> 0 THEN greatest(-1, least(1, round_even(a / s, 0))) ELSE 0 END AS c FROM fx_cells")
view("fx_blocks", """
SELECT vec_id, label, blk, count(*) AS n, sum(ww) AS ww, sum(d * d) AS dd, sum(flip) AS flips, sum(r * d) AS nd, sum(r * r) AS nn,
  coalesce(sum(w * d) / nullif(sum(ww), 0), 0) AS g, sum(w * d) AS wd
FROM (SELECT *, s * c AS w, (s * c) ** 2 AS ww, s * rc - s * c AS r, (rc <> c)::INT AS flip FROM (
  SELECT *, CASE WHEN s <> 0 THEN greatest(-1, least(1, round_even((s * c + d) / s, 0))) ELSE 0 END AS rc FROM fx_coded)) GROUP BY ALL""")
_DRIFT = """sqrt(sum(dd) / sum(ww)) AS delta_to_weight_norm, sum(flips) / sum(n) AS code_flip_fraction, sum(nd) / sqrt(greatest(sum(nn) * sum(dd), 1e-300)) AS naive_cosine,
  sqrt(greatest(sum(nn) - 2 * sum(nd) + sum(dd), 0) / sum(dd)) AS naive_relative_error, sum(g * wd) / sqrt(greatest(sum(g * g * ww) * sum(dd), 1e-300)) AS scale_only_cosine,
  sqrt(greatest(sum(g * g * ww) - 2 * sum(g * wd) + sum(dd), 0) / sum(dd)) AS scale_only_relative_error, avg(abs(g)) AS scale_factor_abs_deviation_mean"""
_DRIFT_NAMES = ("delta_to_weight_norm", "code_flip_fraction", "naive_cosine", "naive_relative_error", "scale_only_cosine", "scale_only_relative_error", "scale_factor_abs_deviation_mean")


@query("v01_block_ternarize", "SELECT vec_id, blk AS block, round(any_value(s), 6) AS scale, string_agg(c::INT::VARCHAR, ',' ORDER BY i) AS codes FROM fx_coded GROUP BY vec_id, blk")
def _v01(spark, d):
    out = vectors.block_ternarize(table(spark, d, "embeddings"), "embedding", BLOCK).select("vec_id", F.posexplode("blocks").alias("block", "b"))
    return out.select("vec_id", F.col("block").cast("bigint").alias("block"), r6("b.scale").alias("scale"), F.array_join(F.transform("b.codes", lambda c: c.cast("int").cast("string")), ",").alias("codes"))


@query("v02_block_drift", "SELECT label, blocks, " + ", ".join(f"round({m}, 6) AS {m}" for m in _DRIFT_NAMES) + f" FROM (SELECT label, count(*) AS blocks, {_DRIFT} FROM fx_blocks GROUP BY label)")
def _v02(spark, d):
    return rounded(vectors.block_drift(_pairs(spark, d), "a", "b", BLOCK, ["label"]))


@query("v03_ternary_check", """
SELECT label, count(*) AS blocks, median(dist) AS median_distinct_values_per_block, max(dist) AS max_distinct_values_per_block, round(sum(same) / sum(n), 6) AS code_agreement_after_rounding,
  round(sqrt(sum(res)) / sqrt(sum(bb)), 6) AS relative_residual_to_ternary, round(sum(bq) / sqrt(sum(bb) * sum(qq)), 6) AS cosine_with_ternary, max(gap) <= 1e-3 * max(qmax) AS exactly_dequantized
FROM (SELECT vec_id, label, blk, count(*) AS n, count(DISTINCT round(b, 6)) AS dist, sum((c = greatest(-1, least(1, round_even(b / s, 0))))::INT) AS same, sum((b - s * c) ** 2) AS res, sum(b * b) AS bb,
  sum(b * s * c) AS bq, sum((s * c) ** 2) AS qq, max(abs(s * c)) AS qmax, max(abs(b - s * c)) AS gap FROM fx_coded GROUP BY vec_id, label, blk) GROUP BY label""")
def _v03(spark, d):
    return rounded(vectors.ternary_check(_pairs(spark, d), "b", "a", BLOCK, ["label"]))


@query("v04_drift_summary", f"""
SELECT label, measure, round(avg(v), 6) AS mean, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM (
  UNPIVOT (SELECT vec_id, label, {_DRIFT} FROM fx_blocks GROUP BY vec_id, label) ON {', '.join(_DRIFT_NAMES[:-1])} INTO NAME measure VALUE v) GROUP BY label, measure""")
def _v04(spark, d):
    return rounded(vectors.drift_summary(vectors.block_drift(_pairs(spark, d), "a", "b", BLOCK, ["vec_id", "label"]), "label"))
