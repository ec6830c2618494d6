"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams. A bucket's gain is the logarithm of how much likelier the target texts are to draw it than the documents,
both smoothed by one; a document weighs the mean gain of its features, plus Gumbel noise from a keyed hash of its id, so that the k highest
scores are a weighted sample without replacement.

The gains are one array, so a batch of texts is scored by array look-ups. The k-th score is found by a distributed quickselect: every round draws
pivot keys at random from the interval that holds it, counts exactly what lies between them in every partition, and goes on with one interval.
Keys are composite and never equal, so a hot score or id does no harm. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weighbridge.llm.flat import Flat, byte_table, per_text, picked, text_slices
from weighbridge.session import cut, scratch

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PIVOTS = 32  # drawn a round
LONG_WORD = 64  # bytes; longer ones are hashed one by one

WORD = byte_table((48, 57), (65, 90), (97, 122), (128, 255))
CAPITALS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()


def span_crc32(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of many byte spans at once, a byte of every span a step."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG_WORD, "left"))
    for i in order[:long]:
        out[i] = zlib.crc32(raw[start[i]: end[i]].tobytes())
    order = order[long:]
    if not len(order):
        return out
    at, state = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-size[order], -np.arange(1, int(size[order[0]]) + 1), "right")  # spans that have a k-th byte
    for k, n in enumerate(alive):
        s = state[:n]
        state[:n] = TABLE[(s ^ raw[at[:n] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


def features(raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, bounds per text, words per text); runs of 1 to longest words, joined by one space."""
    raw = np.frombuffer(raw.tobytes().translate(CAPITALS), np.uint8)
    flat = Flat(raw, offsets, WORD)
    if longest == 1:
        return span_crc32(raw, flat.start, flat.end) % np.uint32(buckets), flat.first, flat.counts
    # The words of a text with one space between them: a run of words is a span of that.
    size = flat.end - flat.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    line = np.full(int((size + 1).sum()), 32, np.uint8)
    line[np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))] = raw[
        np.repeat(flat.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
    stop, owner = begin + size, flat.text_of_word()
    found, owners = [], []
    for n in range(1, longest + 1):
        first, _ = flat.windows(n)
        found.append(span_crc32(line, begin[first], stop[first + n - 1]))
        owners.append(owner[first])
    hashes, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order] % np.uint32(buckets), np.searchsorted(owners[order], np.arange(len(offsets))), flat.counts


def bucket_counts(texts: DataFrame, text: str, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; every task sends one number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, offsets in text_slices(batch, text):
                total += np.bincount(features(raw, offsets, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = texts.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket."""
    s, t, n = source.tolist(), target.tolist(), len(source)
    every_s, every_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (every_s + n)) / float((a + 1) * (every_t + n)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str, doc_id: str, longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of every row; the weight is the floored mean gain, 0 without features."""

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                bucket, bounds, words = features(raw, offsets, longest, len(gain))
                n = np.diff(bounds)
                total = per_text(gain[bucket], bounds)
                weight = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)],
                                                 names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256("seed:id"); a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("bigint")


def _key() -> Column:
    """The composite key of a row; lesser keys win: high scores, then low ids, nulls last, then the row's number."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("_row").alias("r"))


def kth_key(keys: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS):
    """The k-th least value (from 1) of the struct column `key`, or None when there are fewer; no two keys are equal.

    keys is read once a round, and a round leaves about one part in `pivots` of the rows. The driver sees counts and pivots only.
    """
    low = high = None  # exclusive ends of the interval in question, as rows
    before, drawn, number = 0, [], 0
    lit = lambda row: F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in keys.schema["key"].dataType])
    while True:
        rows = keys
        if low is not None:
            rows = rows.filter(F.col("key") > lit(low))
        if high is not None:
            rows = rows.filter(F.col("key") < lit(high))
        # Twice the number of pivots below the key, and one more on a pivot: a row's exact place among them.
        place = F.lit(0)
        for p in drawn:
            place = place + F.when(F.col("key") > lit(p), 2).when(F.col("key") == lit(p), 1).otherwise(0)
        noise = F.xxhash64(F.lit(seed), F.lit(number), "key")
        slot = F.pmod(noise, F.lit(pivots))
        draw = rows.groupBy(place.alias("place"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min_by("key", noise).alias("pivot"))
        found = draw.collect()  # at most (2 pivots + 1) x pivots rows
        count: dict[int, int] = {}
        for r in found:
            count[r.place] = count.get(r.place, 0) + r.n
        for place_ in sorted(count):
            if before + count[place_] >= k:
                break
            before += count[place_]
        else:
            return None
        ordered = sorted(drawn, key=_sortable)
        if place_ % 2:
            return ordered[place_ // 2]
        low = ordered[place_ // 2 - 1] if place_ else low
        high = ordered[place_ // 2] if place_ // 2 < len(ordered) else high
        drawn, number = [r.pivot for r in found if r.place == place_], number + 1


def _sortable(row):
    """A key as Python compares it; Spark puts a null before all values."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


def ranked_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3 ... in the given total order: range partitions, their sizes, and a number inside each."""
    spark = rows.sparkSession
    path = scratch(spark, "sorted")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(offsets), "_part").withColumn(
        "rank", (F.col("_before") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_before")


def importance_sample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", longest: int = 1, buckets: int = BUCKETS,
                      seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank counts the drawn ones from 1, best first, and is null for the others.

    percent of the rows with at least least_words words are drawn (rounded down). Null and empty texts have no features and weigh 0. Equal scores
    rank by the lesser id, a null id behind all others; rows that repeat id and score are drawn in any order, each on its own. An empty target
    or table leaves counts of zero; an empty table gives no rows. Other columns are not read.
    """
    rows = picked(docs, doc_id, text)
    gain = gains(bucket_counts(rows, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    scored = weighted(rows, gain, text, doc_id, longest).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.filter(eligible).count() // 100
    columns = [F.col("id").alias(doc_id), "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("bigint").alias("rank")
    last = kth_key(scored.filter(eligible).select(_key().alias("key")), wanted, seed) if wanted else None
    if last is None:
        return scored.select(*columns, undrawn)
    kinds = scored.select(_key().alias("key")).schema["key"].dataType
    bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
    drawn = eligible & (_key() <= bound)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_row")]
    winners = ranked_rows(scored.filter(drawn).select("id", "n_features", "weight", "score", "_row"), order)
    return winners.select(*columns, "rank").unionByName(scored.filter(~drawn).select(*columns, undrawn))
