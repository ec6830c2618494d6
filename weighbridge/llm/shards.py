"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, id), so copies of a text lie together. Splitters between shards are found without moving a row:
every round counts the exact bytes and rows below candidate boundaries in every partition, adds the counts, and draws new
candidates only where a splitter is not yet within tolerance. Then every row crosses the network once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weighbridge.llm.flat import unused
from weighbridge.session import cut

KEY = "S16"
PROBES = 64  # sampled boundaries a shard and round
TOLERANCE = 0.002  # of a shard's bytes
PART_BYTES = 128 << 20  # a shard is sorted in parts of about this size


@dataclass
class Split:
    """Sorted boundary keys; part p holds the keys from bounds[p - 1] on and below bounds[p]."""

    bounds: np.ndarray
    shard: np.ndarray  # of every part
    before: np.ndarray  # rows of the same shard in earlier parts


def with_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key: str = "_key") -> DataFrame:
    """Add size (UTF-8 bytes plus 8), text_crc32 and the 16-byte sort key, named key; a null text counts as an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    eight = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    return docs.withColumns({
        "size": F.octet_length(whole).cast("bigint") + 8, "text_crc32": F.crc32(whole.cast("binary")),
        key: F.concat(eight(F.xxhash64(whole)), eight(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)))),
    })


def _keys(array: pa.Array) -> np.ndarray:
    """16-byte keys of a binary column."""
    return np.frombuffer(b"".join(array.to_pylist()), KEY)


def histogram(keys: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) between neighbouring bounds; every task adds up its rows first."""

    def run(batches):
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.searchsorted(bounds, _keys(batch.column("_key")), "right")
                np.add.at(size, at, batch.column("size").to_numpy())
                np.add.at(rows, at, 1)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["at", "size", "n"])

    parts = keys.mapInArrow(run, "at bigint, size bigint, n bigint").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in parts.collect():  # one row a boundary at most
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return size, rows


def sample(keys: DataFrame, bounds: np.ndarray, share: np.ndarray, seed: int) -> np.ndarray:
    """Keys drawn with the given chance in every interval between bounds; which ones depends on key and round alone."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = _keys(batch.column("_key"))
                word = k.view(np.uint8).reshape(-1, 16).view("<u8")
                with np.errstate(over="ignore"):
                    draw = (word[:, 0] ^ (word[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
                    draw = (draw ^ (draw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                taken = np.flatnonzero((draw >> np.uint64(11)) / 2.0**53 < share[np.searchsorted(bounds, k, "right")])
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(taken))], names=["_key"])

    got = keys.select("_key").mapInArrow(run, "_key binary").collect()  # PROBES a shard on average
    return np.unique(np.array([bytes(r["_key"]) for r in got], KEY))


def find_split(keys: DataFrame, shards: int, part_bytes: int = PART_BYTES, tolerance: float = TOLERANCE, probes: int = PROBES) -> Split:
    """Boundaries of shards parts of equal bytes each within tolerance, or as near as whole rows allow."""
    totals = keys.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    total, n = int(totals["size"] or 0), int(totals["n"])
    targets = total * np.arange(1, shards) / shards
    pieces = max(1, -(-total // (shards * part_bytes)))
    want = shards * max(probes, 4 * pieces)
    bounds = sample(keys, np.zeros(0, KEY), np.array([min(1.0, want / max(1, n))]), 1)
    for round_ in range(2, 64):  # ends when nothing is left to refine; every round narrows by about PROBES
        size, rows = histogram(keys, bounds)
        below = np.cumsum(size)[:-1]  # bytes under every bound
        edge = np.concatenate([[0], below, [total]])
        inside = np.searchsorted(below, targets, "left")  # interval that holds the target
        miss = np.minimum(np.abs(edge[inside] - targets), np.abs(edge[inside + 1] - targets))
        open_ = np.unique(inside[(miss > tolerance * total / shards) & (rows[inside] > 1)])
        if not len(open_):
            break
        share = np.zeros(len(rows))
        share[open_] = np.minimum(1.0, probes / rows[open_])
        more = np.setdiff1d(sample(keys, bounds, share, round_), bounds)
        if not len(more):  # the rows of each open interval share one key, or none was drawn: draw all of few
            share[open_] = np.where(rows[open_] <= 1 << 16, 1.0, np.minimum(1.0, 16 * probes / rows[open_]))
            more = np.setdiff1d(sample(keys, bounds, share, round_ + 64), bounds)
        if not len(more):
            break
        bounds = np.union1d(bounds, more)
    # A splitter is the bound nearest to its target; -1 and len(bounds) stand for the ends.
    right = np.searchsorted(below, targets, "left")
    left_edge, right_edge = edge[right], edge[right + 1]
    splitter = np.where(np.abs(left_edge - targets) <= np.abs(right_edge - targets), right - 1, right)
    shard_of = np.searchsorted(splitter, np.arange(len(rows)) - 1, "right")  # of every interval
    # Parts: whole intervals, together about part_bytes and within one shard.
    part, used = np.zeros(len(rows), np.int64), 0
    for i in range(1, len(rows)):
        used += size[i - 1]
        new = shard_of[i] != shard_of[i - 1] or used + size[i] > part_bytes
        part[i] = part[i - 1] + new
        used = 0 if new else used
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    counts = np.add.reduceat(rows, heads)
    shard = shard_of[heads]
    running = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.searchsorted(shard, shard)  # parts are in shard order
    return Split(bounds[heads[1:] - 1], shard, running - running[first])


def balanced_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, law (`bytes`), shard (0 to shards - 1) and slot (0, 1, ... in a shard, in key order).

    Columns of these names are replaced, all others are carried. Null texts weigh 8 bytes. Rows alike in text and id share a key and
    are never split apart; their slots are arbitrary among themselves. An empty table gives no rows.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot")
    key, part, row, before = unused(docs, "_key", "_part", "_row", "_before")
    rows = with_key(docs, text, doc_id, key)
    split = find_split(cut(rows.select(F.col(key).alias("_key"), "size")), shards)
    bounds = split.bounds

    @F.arrow_udf("int")
    def part_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, _keys(keys), "right").astype(np.int32))

    spark = docs.sparkSession
    parts = spark.createDataFrame([(int(p), int(s), int(b)) for p, (s, b) in enumerate(zip(split.shard, split.before, strict=True))],
                                  f"{part} int, shard int, {before} bigint")
    dealt = rows.withColumn(part, part_of(key)).repartition(max(1, len(split.shard)), part)
    numbered = dealt.withColumn(row, F.row_number().over(Window.partitionBy(part).orderBy(key)))
    # One row of 16 bytes a part of PART_BYTES: 800,000 rows, 13 MB, for 100 TB.
    return numbered.join(F.broadcast(parts), part).withColumns(
        {"law": F.lit("bytes"), "slot": F.col(before) + F.col(row) - 1}).drop(part, key, row, before)


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> None:
    """One folder a shard."""
    balanced_shards(docs, shards, text, doc_id).write.partitionBy("shard").parquet(path)

