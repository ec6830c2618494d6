"""Word n-gram contamination of a corpus by evaluation text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.windows import Bitmap, first_of_each, slices, word_windows
from weighbridge.session import broadcast_if_small, cut

PART_BITS = 10  # parts of the hash space in which the n-grams of a group are counted
GRAM_BYTES = 16  # two hashes of 64 bits
HELD = 1 << 20  # n-grams a task holds before it packs them
N = 13
NEAR_DUPLICATE = 0.2
BLOCK = 1 << 16  # bytes of a bitmap that travel as one row


def gram_bound(texts: DataFrame, text: str) -> int:
    """An upper bound on the n-grams of a text column from one light scan: a word takes two characters."""
    return int(texts.agg(F.coalesce(F.sum((F.char_length(text) + 1) / 2), F.lit(0.0))).first()[0])


def _windows(batch: pa.RecordBatch, text: str, n: int):
    """(from row, to row, windows) of pieces of a batch whose text column is lower-cased."""
    for low, high, data, offsets in slices(batch.column(text)):
        yield low, high, word_windows(data, offsets, n)


def gram_bitmap(texts: DataFrame, text: str, n: int, bits: int) -> Bitmap:
    """A bitmap of all n-grams of a text column: every task sends the blocks it has bits in, equal blocks are merged."""

    def run(batches):
        seen = Bitmap(bits)
        for batch in batches:
            for _, _, w in _windows(batch, "t", n):
                seen.add(w.hashes)
        for i in range(0, len(seen.data), BLOCK):
            block = seen.data[i: i + BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "bits"])

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                b = np.frombuffer(b, np.uint8)
                merged[i] = merged[i] | b if i in merged else b
        for i, b in merged.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["block", "bits"])

    schema = "block int, bits binary"
    blocks = texts.select(F.lower(text).alias("t")).mapInArrow(run, schema).repartition("block").mapInArrow(merge, schema).toArrow()
    out = Bitmap(bits)
    for i, b in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        out.data[i * BLOCK: i * BLOCK + len(b)] |= np.frombuffer(b, np.uint8)
    return out


def distinct_grams(texts: DataFrame, text: str, n: int = N) -> DataFrame:
    """(g): the distinct n-grams of a text column as strings."""

    def run(batches):
        for batch in batches:
            for _, _, w in _windows(batch, "t", n):
                yield pa.RecordBatch.from_arrays([pa.array([w.text(k) for k in np.unique(w.hashes, return_index=True)[1]], pa.string())], names=["g"])

    return texts.select(F.lower(text).alias("t")).mapInArrow(run, "g string").distinct()


def suspects(df: DataFrame, bitmap: Bitmap, text: str, n: int) -> DataFrame:
    """Every row without its text, with the number of its distinct n-grams and those the bitmap does not rule out. No shuffle."""
    rest = [f for f in df.schema if f.name != text]
    shared = df.sparkSession.sparkContext.broadcast((bitmap.bits, bitmap.data.tobytes()))

    def run(batches):
        known = Bitmap(shared.value[0], np.frombuffer(shared.value[1], np.uint8))
        for batch in batches:
            for low, high, w in _windows(batch, "_lower", n):
                mine = first_of_each(w.owner, w.hashes)
                owner = w.owner[mine]
                maybe = known.may_hold(w.hashes[mine])
                shown = pa.array([w.text(k) for k in mine[maybe]], pa.string())
                bounds = np.searchsorted(owner[maybe], np.arange(high - low + 1)).astype(np.int32)
                part = batch.slice(low, high - low)
                columns = [part.column(f.name) for f in rest]
                columns += [pa.array(np.bincount(owner, minlength=high - low)), pa.ListArray.from_arrays(pa.array(bounds), shown)]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in rest], "grams", "_maybe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", grams bigint, _maybe array<string>"
    return df.select(*[f.name for f in rest], F.lower(text).alias("_lower")).mapInArrow(run, schema)


def ngram_contamination(df: DataFrame, evaluation: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """Per row: distinct n-grams, how many occur in the evaluation text, and their ratio (null without n-grams). Other columns stay, the text goes.

    The evaluation side, however large, becomes a bitmap of at most 64 MB. One pass over the corpus counts every text's distinct windows and
    keeps as strings those in the bitmap; nothing else leaves a task. The survivors meet the evaluation strings in an inner join, so hits
    are exact. A fuller bitmap (beyond some 30 million distinct n-grams) lets more through and misses none.
    """
    bitmap = gram_bitmap(evaluation, text, n, Bitmap.size_for(gram_bound(evaluation, text)))
    counted = cut(suspects(df, bitmap, text, n).withColumn("_row", F.monotonically_increasing_id()))
    shown = counted.filter(F.size("_maybe") > 0).select("_row", F.explode("_maybe").alias("g"))
    found = cut(shown.join(distinct_grams(evaluation, text, n), "g").groupBy("_row").agg(F.count(F.lit(1)).alias("hits")))
    return counted.drop("_maybe").join(broadcast_if_small(found, found.count()), "_row", "left").drop("_row").withColumn(
        "hits", F.coalesce("hits", F.lit(0))).withColumn("ratio", F.col("hits") / F.nullif(F.col("grams"), F.lit(0)))


def _packed(held: list, values: list, name: str, kind: pa.DataType) -> pa.RecordBatch:
    """Held (group, hash, second hash) as one row for every group and part of the hash space: its n-grams end to end, repeats met here once."""
    code, a, b = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((a, code))
    code, a, b = code[order], a[order], b[order]
    part = (a >> np.uint64(64 - PART_BITS)).astype(np.int32)
    new, run = np.ones(len(a), bool), np.ones(len(a), bool)
    run[1:] = (code[1:] != code[:-1]) | (part[1:] != part[:-1])
    new[1:] = run[1:] | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(run)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(new.astype(np.int64), at))]) * GRAM_BYTES
    grams = np.stack([a[new], b[new]], axis=1)
    return pa.RecordBatch.from_arrays(
        [pa.array([values[c] for c in code[at]], kind), pa.array(part[at]), pa.array(np.diff(np.append(at, len(a)))),
         pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(grams)])], names=[name, "part", "n", "g"])


def gram_counts(df: DataFrame, by: str, text: str = "text", n: int = N, held_grams: int = HELD) -> DataFrame:
    """(by, rows, grams): distinct n-grams of every text, summed, and the distinct ones of the group.

    N-grams travel as two independent 64-bit hashes, packed by group and part of the hash space: 16 bytes each and no row of their own. Copies
    collapse in the task that meets them. A part of a group is counted by one task; there are 2^PART_BITS of them a group.
    """
    kind = df.schema[by].dataType.simpleString()

    def run(batches):
        values, codes, held, size = [], {}, [], 0
        for batch in batches:
            column = batch.column(by)
            told = column.dictionary_encode(null_encoding="encode")
            own = []
            for value in told.dictionary.to_pylist():
                if value not in codes:
                    codes[value] = len(values)
                    values.append(value)
                own.append(codes[value])
            group = np.array(own, np.int64)[told.indices.to_numpy(zero_copy_only=False)] if own else np.zeros(0, np.int64)
            for low, _, data, offsets in slices(batch.column("_lower")):
                one, two = word_windows(data, offsets, n), word_windows(data, offsets, n, seed=1)
                mine = first_of_each(one.owner, one.hashes)
                if len(mine):
                    held.append((group[one.owner[mine] + low], one.hashes[mine], two.hashes[mine]))
                    size += len(mine)
                if size >= held_grams:
                    yield _packed(held, values, by, column.type)
                    held, size = [], 0
        if held:
            yield _packed(held, values, by, column.type)

    def count(packed: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(packed.column("g").to_pylist()), np.uint64).reshape(-1, 2)
        raw = raw[np.lexsort((raw[:, 1], raw[:, 0]))]
        distinct = 1 + int((raw[1:] != raw[:-1]).any(axis=1).sum())
        return pa.table([packed.column(by).slice(0, 1), pa.array([int(np.sum(packed.column("n").to_numpy()))]), pa.array([distinct])], names=[by, "rows", "grams"])

    grams = df.select(by, F.lower(text).alias("_lower")).mapInArrow(run, f"`{by}` {kind}, part int, n bigint, g binary")
    per = grams.groupBy(by, "part").applyInArrow(count, f"`{by}` {kind}, rows bigint, grams bigint")
    return per.groupBy(by).agg(F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))


def near_duplicate_filter(measured: DataFrame, max_ratio: float = NEAR_DUPLICATE) -> DataFrame:
    """Rows to keep: no n-grams, or at most max_ratio of them in the evaluation text."""
    return measured.filter((F.col("grams") == 0) | (F.col("ratio") <= max_ratio))


def contamination_report(measured: DataFrame, by: str = "source", order: str = "h", examples: int = 5) -> DataFrame:
    """Per source: rows, rows with a shared n-gram and the first few of their ids in selection order."""
    from weighbridge.operators.ranking import ranked

    totals = measured.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("hits") > 0).alias("ngram_hits")
    )
    first = ranked(measured.filter(F.col("hits") > 0).select(by, "id", order), [by], order, "id", examples)
    shown = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_e")).select(
        by, F.array_join(F.transform("_e", lambda e: e["id"]), ",").alias("examples")
    )
    return totals.join(shown, by, "left").withColumn("examples", F.coalesce("examples", F.lit("")))
