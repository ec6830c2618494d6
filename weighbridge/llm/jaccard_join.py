"""Exact n-gram Jaccard self-join by rare-first prefix filtering.

A text is the set of its distinct five-word shingles. All sets are put in one order of shingles, rare ones first. Two sets of similarity t share one of
the first n - ceil(t n) + 1 shingles of either, so sets meet on prefix shingles only. Where they meet, three filters come before any comparison:
sizes must be within t (length), the shingles left behind the meeting point must suffice (positional), and counts of the suffixes in fixed cells of
the hash space must leave enough in common (suffix). What passes is verified once a pair on the whole sets.

Rarity is read off a fixed array of counters over all texts, as an order of magnitude; shingles that share a counter count as frequent as both. Any
order gives the same result, a better one meets less often.

A shingle that very many sets have in their prefix would list all their pairs. Only classes are wanted, so each meeting is settled in two steps. Every set
is first compared with one leader, the set with the least before the shared shingle: the origin of a family of near copies has nothing of its
own there. Then only members of different classes meet, and only those rows that some size of partner at its best position could satisfy.
What a copy changed is rare and comes first in its order, so members too far from the origin fail the positional filter with nearly all partners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.components import components, cut_counted
from weighbridge.llm.flat import Flat, byte_table, mix, picked, text_slices, window_hashes
from weighbridge.session import broadcast_if_small, cut

SHINGLE = 5
PERCENT = 80  # similarity in hundredths
CELLS = 1 << 20  # counters of shingles, whatever the data
BLOCK = 1 << 14  # counters in one row on their way to the sum
KEPT = 1 << 16  # sets a task remembers, to pass over copies
SUFFIX_CELLS = 32

WORD = byte_table((0, 8), (14, 31), (33, 255))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Per text the sorted hashes of its distinct shingles; fewer words than size are one shingle, no words are none."""
    flat = Flat(raw, offsets, WORD, fold=True)
    words = flat.hashes()
    first, bounds = flat.windows(size)
    hashes = window_hashes(words, first, size)
    for i, n in enumerate(flat.counts):
        if n >= size:
            mine = np.sort(hashes[bounds[i]: bounds[i + 1]])
            yield mine[np.concatenate([[True], mine[1:] != mine[:-1]])] if len(mine) > 1 else mine
        elif n:
            yield window_hashes(words, flat.first[i: i + 1], int(n))
        else:
            yield hashes[:0]


def digest(mine: np.ndarray) -> int:
    """64 bits that stand for a set; two of a billion different sets agree with a chance of 0.03."""
    with np.errstate(over="ignore"):
        return int(mix(mine ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def signed(docs: DataFrame, text: str, doc_id: str, size: int) -> tuple[DataFrame, np.ndarray]:
    """((id, set, n) of every row, counters): one pass over the texts; the set of a text without words is null."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        counters, of_id = np.zeros(CELLS, np.int64), None
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                ids, sizes = [], []
                for mine in shingle_sets(raw, offsets, size):
                    counters += np.bincount(_cell(mine), minlength=CELLS) if len(mine) > CELLS // 16 else 0
                    if len(mine) <= CELLS // 16:
                        np.add.at(counters, _cell(mine), 1)
                    ids.append(digest(mine) if len(mine) else None)
                    sizes.append(len(mine))
                of_id, n = part.column(doc_id).type, part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                                                 names=["id", "set", "n", "block", "counts"])
        if of_id is not None:
            blocks = counters.astype("<i4").reshape(-1, BLOCK)
            at = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), of_id), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)),
                                              pa.array([blocks[i].tobytes() for i in at], pa.binary())], names=["id", "set", "n", "block", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.astype("<i8").tobytes() for t in total.values()], pa.binary())], names=["block", "counts"])

    rows = cut(docs.select(doc_id, text).mapInArrow(run, f"id {kind}, set bigint, n bigint, block int, counts binary"))
    blocks = rows.filter(F.col("block").isNotNull()).select("block", "counts")
    # The sums are CELLS numbers, 8 MB, at every size of the table.
    got = blocks.repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    counters = np.zeros(CELLS, np.int64).reshape(-1, BLOCK)
    for block, counts in zip(got.column("block").to_pylist(), got.column("counts").to_pylist(), strict=True):
        counters[block] = np.frombuffer(counts, "<i8")
    return rows.filter(F.col("block").isNull()).select("id", "set", "n"), counters.reshape(-1)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.intp)


def magnitudes(counters: np.ndarray) -> np.ndarray:
    """Eight steps an octave, 0 to 255."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counters, 1)))).astype(np.uint8)


def in_order(mine: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """A set as sorted places in the common order: magnitude first, then 56 bits of the hash."""
    return np.sort(rarity[_cell(mine)].astype(np.uint64) << np.uint64(56) | mine >> np.uint64(8))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefixes(docs: DataFrame, rarity: np.ndarray, text: str, size: int, percent: int) -> DataFrame:
    """(set, n, i, e): the i-th shingle e of every prefix; rows of one set may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, raw, offsets in text_slices(batch, text):
                sets, sizes, found = [], [], []
                for mine in shingle_sets(raw, offsets, size):
                    if not len(mine) or (name := digest(mine)) in seen:
                        continue
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(name)
                    sets.append(name)
                    sizes.append(len(mine))
                    found.append(in_order(mine, shared.value)[: prefix_length(len(mine), percent)])
                if sets:
                    length = [len(x) for x in found]
                    take = np.repeat(np.arange(len(sets)), length)
                    place = np.arange(len(take)) - np.repeat(np.cumsum(length) - length, length)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(sets, np.int64)[take]), pa.array(np.array(sizes, np.int32)[take]), pa.array(place.astype(np.int32)),
                                                      pa.array(np.concatenate(found).view(np.int64))], names=["set", "n", "i", "e"])

    return docs.select(text).mapInArrow(run, "set bigint, n int, i int, e bigint")


def may_link(n1: Column, i1: Column, n2: Column, i2: Column, percent: int) -> Column:
    """Length and positional filter of two sets that meet first at their places i1 and i2."""
    both = n1.cast("bigint") + n2
    return (100 * F.least(n1, n2).cast("bigint") >= percent * F.greatest(n1, n2)) & ((100 + percent) * F.least(n1 - i1, n2 - i2).cast("bigint") >= percent * both)


def ordered_sets(docs: DataFrame, pairs: DataFrame, named: DataFrame, rarity: np.ndarray, text: str, doc_id: str, size: int) -> DataFrame:
    """(set, places): the whole ordered set of every set of pairs (a, b); named holds a row (set, id) for it. Nothing else is read from the texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    ids, n = cut_counted(named.join(wanted, "set", "left_semi").select(F.col("id").alias("_wanted")).distinct())
    texts = docs.select(doc_id, text).join(broadcast_if_small(ids, n), F.col(doc_id) == F.col("_wanted"), "left_semi").select(text)
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        for batch in batches:
            for _, raw, offsets in text_slices(batch, text):
                sets = [(digest(mine), in_order(mine, shared.value).view(np.int64)) for mine in shingle_sets(raw, offsets, size) if len(mine)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.list_(pa.int64()))], names=["set", "places"])

    # Rows that repeat an id may bring a set twice; a link found twice is one link.
    return cut(texts.mapInArrow(run, "set bigint, places array<bigint>"))


def _flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]: offsets[-1]], offsets - offsets[0]


def suffix_passes(a: np.ndarray, at_a: np.ndarray, i: np.ndarray, b: np.ndarray, at_b: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Per pair: may the parts behind the first common shingle still have enough in common?

    What two suffixes share is at most, in every cell of the hash space, the lesser of their counts there.
    """
    n, size_a, size_b = len(i), np.diff(at_a), np.diff(at_b)

    def cells(values, bounds, skip):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        behind = np.arange(len(values)) - bounds[:-1][owner] > skip[owner]
        low = (values[behind] & (SUFFIX_CELLS - 1)).astype(np.int64)
        return np.bincount(owner[behind] * SUFFIX_CELLS + low, minlength=n * SUFFIX_CELLS).reshape(n, SUFFIX_CELLS)

    common = 1 + np.minimum(cells(a, at_a, i), cells(b, at_b, j)).sum(axis=1)
    return (100 + percent) * common >= percent * (size_a + size_b)


def intersections(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    n = len(at_a) - 1
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))])
    values = np.concatenate([a, b])
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][same], minlength=n)


def verified(pairs: DataFrame, n: int, fetch, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) of n candidates (a, b, i, j) that are similar enough, and their number; fetch(pairs) brings their sets."""
    sets = fetch(pairs)
    side = lambda name: sets.select(F.col("set").alias(name), F.col("places").alias(f"_{name}"))
    # Pairs are four numbers: while they are few they travel to the sets, and whole sets cross the network once, to meet the other side.
    left = side("a").join(broadcast_if_small(pairs, n), "a")
    right = side("b").join(broadcast_if_small(pairs.select("b").distinct(), n), "b", "left_semi")
    both = left.join(right, "b").select("a", "b", "i", "j", "_a", "_b")

    def run(batches):
        for batch in batches:
            at, weight = 0, np.cumsum(np.diff(batch.column("_a").offsets.to_numpy()) + np.diff(batch.column("_b").offsets.to_numpy()))
            while at < batch.num_rows:  # about a million shingles at once
                stop = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + (1 << 20), "right")))
                part = batch.slice(at, stop - at)
                (a, at_a), (b, at_b) = _flat_lists(part.column("_a")), _flat_lists(part.column("_b"))
                alive = suffix_passes(a, at_a, part.column("i").to_numpy(), b, at_b, part.column("j").to_numpy(), percent)
                if alive.any():
                    keep = np.flatnonzero(alive)
                    some = part.take(pa.array(keep)) if len(keep) < part.num_rows else part
                    (a, at_a), (b, at_b) = _flat_lists(some.column("_a")), _flat_lists(some.column("_b"))
                    common = intersections(a, at_a, b, at_b)
                    good = pa.array(np.flatnonzero((100 + percent) * common >= percent * (np.diff(at_a) + np.diff(at_b))))
                    yield pa.RecordBatch.from_arrays([some.column("a").take(good), some.column("b").take(good)], names=["a", "b"])
                at = stop

    return cut_counted(both.mapInArrow(run, "a bigint, b bigint"))


def _candidates(met: DataFrame) -> DataFrame:
    """One row a pair with the place of its first meeting and the number of meetings."""
    swap = F.col("x") > F.col("y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.min(F.when(swap, F.col("j")).otherwise(F.col("i"))).alias("i"), F.min(F.when(swap, F.col("i")).otherwise(F.col("j"))).alias("j"), F.count(F.lit(1)).alias("shared"))


def set_classes(members: DataFrame, fetch, percent: int) -> tuple[DataFrame | None, int]:
    """(node, root) of every set that is linked with another, and their number."""
    first = members.groupBy("e").agg(F.min(F.struct(F.col("i").alias("j"), F.col("set").alias("y"), F.col("n").alias("m"))).alias("l")).select("e", "l.*")
    met = members.withColumnRenamed("set", "x").join(first, "e").filter((F.col("x") != F.col("y")) & may_link(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    led = met.groupBy("x", "y").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("shared"))
    best = led.groupBy("x").agg(F.max_by(F.struct("y", "i", "j"), F.struct("shared", "y")).alias("p")).select("x", "p.y", "p.i", "p.j")
    tested, n = cut_counted(_candidates(best).drop("shared"))
    if not n:
        return None, 0
    links, n = verified(tested, n, fetch, percent)
    roots, classes = cut_counted(components(links)) if n else (None, 0)
    rest = _across(members, roots, classes, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest, n = cut_counted(rest.select("a", "b", "i", "j"))
    if n:
        more, n = verified(rest, n, fetch, percent)
        if n:
            links = links.union(more)
            roots, classes = cut_counted(components(links))
    return roots, classes


def _able(members: DataFrame, percent: int) -> DataFrame:
    """Members that some partner could satisfy: a row that fails with the best place of every size of partner links with nobody there."""
    front = members.groupBy(F.col("e").alias("f"), F.col("n").alias("m")).agg(F.min("i").alias("j"), F.count(F.lit(1)).alias("_rows"))
    other = (F.col("m") != F.col("n")) | (F.col("_rows") > 1)  # not only itself
    return members.join(front, (F.col("e") == F.col("f")) & other & may_link(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent), "left_semi")


def _across(members: DataFrame, roots: DataFrame | None, classes: int, percent: int) -> DataFrame:
    """Candidates between different classes that pass the length and the positional filter."""
    if roots is None:
        of = members.withColumn("root", F.col("set"))
    else:
        of = members.join(broadcast_if_small(roots, classes), F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set")).drop("node")
    several = lambda df: df.join(df.groupBy("e").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("e"), "e", "left_semi")
    of = cut(several(of))
    able = cut(several(_able(of, percent)))
    right = able.select("e", F.col("set").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    near = (F.col("x") < F.col("y")) & (F.col("root") != F.col("other")) & may_link(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent)
    return _candidates(able.withColumnRenamed("set", "x").join(right, "e").filter(near))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the least id reachable over links of percent or more.

    Rows with equal sets are linked. A null, empty or blank text has an empty set and is its own component. A row with a null id has its size,
    links with nothing and has a null component. Repeated rows come back as often as they stand; rows of one id with different texts are
    compared by their texts. Other columns are not read; an empty table gives no rows.
    """
    rows = picked(docs, doc_id, text)
    signs, counters = signed(rows, text, doc_id, size)
    rarity = magnitudes(counters)
    named = rows.filter(F.col(doc_id).isNotNull())
    every = cut(prefixes(named, rarity, text, size, percent))
    shared, n = cut_counted(every.groupBy("e").agg(F.min("set").alias("_lo"), F.max("set").alias("_hi")).filter("_lo <> _hi").select("e"))
    members = cut(every.join(broadcast_if_small(shared, n), "e", "left_semi").groupBy("set", "e").agg(F.first("n").alias("n"), F.first("i").alias("i")))
    members = cut(_able(members, percent))
    least = cut(signs.filter(F.col("set").isNotNull() & F.col("id").isNotNull()).groupBy("set").agg(F.min("id").alias("first")))
    fetch = lambda pairs: ordered_sets(rows, pairs, least.withColumnRenamed("first", "id"), rarity, text, doc_id, size)
    roots, classes = set_classes(members, fetch, percent)
    if roots is not None:
        small = lambda: broadcast_if_small(roots.select(F.col("node").alias("set"), "root"), classes)
        of = cut(least.join(small(), "set", "left").withColumn("root", F.coalesce("root", "set")))
        linked = of.join(of.groupBy("root").agg(F.min("first").alias("component")), "root").select("set", "component")
    else:
        linked = least.withColumnRenamed("first", "component")
    out = signs.join(linked, "set", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
