"""How much of a corpus repeats itself: exact copies, shares of templates, near copies by n-gram Jaccard similarity.

Near copies are counted, not listed. States meet on the rare grams in front of their ordered sets (prefix, length and position filters; the order is
one array of counters over the corpus). Each state is compared with one leader of every group it meets, the state with the least before the shared
gram, and is done when that is near. Only states still without a partner are compared with the others they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.windows import first_of_each, slices, word_windows
from weighbridge.session import broadcast_if_small, cut

NEAR = 95  # hundredths of Jaccard similarity
GRAM = 5
CELLS = 1 << 18
KEPT = 1 << 16  # states a task remembers, to pass over copies


def template(state: Column) -> Column:
    """The state with numbers and capitalised words masked."""
    return F.regexp_replace(F.regexp_replace(state, "[0-9]+([.,][0-9]+)*", "#"), "[A-Z][A-Za-z]*", "@")


def _sets(batch: pa.RecordBatch, n: int):
    """Lists of (row, sorted distinct gram hashes) of the rows of a batch with a lower-cased column t, one list for every slice of its bytes."""
    for low, _, data, offsets in slices(batch.column("t")):
        w = word_windows(data, offsets, n)
        mine = first_of_each(w.owner, w.hashes)  # by text, then hash
        bounds = np.searchsorted(w.owner[mine], np.arange(len(offsets)))
        hashes = w.hashes[mine]
        del w, mine
        yield [(low + i, hashes[bounds[i]: bounds[i + 1]]) for i in range(len(offsets) - 1)]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.intp)


def _counters(texts: DataFrame, n: int) -> np.ndarray:
    """Grams by cell of the hash space over all texts, as an order of magnitude; the sums are CELLS numbers whatever the data."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for rows in _sets(batch, n):
                for _, mine in rows:
                    np.add.at(total, _cells(mine), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = texts.select("t").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.ones(CELLS)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(255, np.floor(8 * np.log2(out))).astype(np.uint8)


def _places(mine: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return np.sort(rarity[_cells(mine)].astype(np.uint64) << np.uint64(56) | mine >> np.uint64(8)).view(np.int64)


def _prefixes(texts: DataFrame, rarity, n: int, percent: int) -> DataFrame:
    """(key, of, size, i, g): the i-th gram g of the part of every set in which two near copies must meet."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, groups = batch.column("key").to_numpy(), batch.column("of").to_numpy()
            # What a slice gives leaves the task before the next slice is read.
            for sets in _sets(batch, n):
                rows = []
                for row, mine in sets:
                    key = int(keys[row])
                    if not len(mine) or key in seen:
                        continue
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(key)
                    rows.append((key, len(mine), _places(mine, rarity.value)[: len(mine) - (percent * len(mine) + 99) // 100 + 1], groups[row]))
                if rows:
                    length = [len(r[2]) for r in rows]
                    ends = np.cumsum(length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([r[0] for r in rows], length)), pa.array(np.repeat([r[3] for r in rows], length)), pa.array(np.repeat([r[1] for r in rows], length).astype(np.int32)),
                         pa.array((np.arange(ends[-1]) - np.repeat(ends - length, length)).astype(np.int32)), pa.array(np.concatenate([r[2] for r in rows]))], names=["key", "of", "size", "i", "g"])

    return texts.mapInArrow(run, "key bigint, of bigint, size int, i int, g bigint")


def _may(size: str, i: str, size2: str, i2: str, percent: int) -> Column:
    """Length and position filter for two sets that share their first common gram at places i and i2."""
    a, b = F.col(size).cast("bigint"), F.col(size2).cast("bigint")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * F.least(a - F.col(i), b - F.col(i2)) >= percent * (a + b))


def _near(pairs: DataFrame, texts: DataFrame, rarity, n: int, percent: int) -> DataFrame:
    """(key): the states of pairs (a, b) that are near each other."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())

    def fetch(batches):
        for batch in batches:
            for rows in _sets(batch, n):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([r for r, _ in rows], pa.int64())), pa.array([_places(m, rarity.value) for _, m in rows], pa.list_(pa.int64()))],
                                                 names=["key", "s"])

    named = texts.join(broadcast_if_small(wanted, wanted.count()), "key", "left_semi").mapInArrow(fetch, "key bigint, s array<bigint>")
    sets = cut(named)  # copies of a state may stand here more than once: the same answer twice
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    good = both.filter((100 + percent) * common >= percent * (F.size("x") + F.size("y")).cast("bigint"))
    return good.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def near_copies(df: DataFrame, by: str, state: str, n: int = GRAM, percent: int = NEAR) -> DataFrame:
    """(by, near): different states of a group that have a near copy among the group's other states."""
    spark = df.sparkSession
    # The group is part of the key: states of different groups never meet. 64 bits name a state.
    texts = df.filter(F.col(state).isNotNull()).select(F.xxhash64(by, state).alias("key"), F.xxhash64(by).alias("of"), F.lower(state).alias("t"))
    rarity = spark.sparkContext.broadcast(_counters(texts, n))
    front = cut(_prefixes(texts, rarity, n, percent))
    shared = front.groupBy("of", "g").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi")).filter("_lo <> _hi").select("of", "g")
    met = cut(front.join(shared, ["of", "g"], "left_semi").dropDuplicates(["key", "g"]))
    first = met.groupBy(F.col("of").alias("of2"), F.col("g").alias("g2")).agg(F.min(F.struct("i", "key", "size")).alias("l")).select("of2", "g2", F.col("l.i").alias("i2"), F.col("l.key").alias("key2"), F.col("l.size").alias("size2"))
    same = (F.col("of") == F.col("of2")) & (F.col("g") == F.col("g2"))
    pair = [F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")]
    led = cut(met.join(first, same & (F.col("key") != F.col("key2")) & _may("size", "i", "size2", "i2", percent)).select(*pair).distinct())
    found = cut(_near(led, texts.select("key", "t"), rarity, n, percent))
    alone = met.join(found, "key", "left_anti")
    others = met.select(F.col("of").alias("of2"), F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("key").alias("key2"), F.col("size").alias("size2"))
    rest = alone.join(others, same & (F.col("key") != F.col("key2")) & _may("size", "i", "size2", "i2", percent)).select(*pair).distinct()
    more = _near(cut(rest.join(led, ["a", "b"], "left_anti")), texts.select("key", "t"), rarity, n, percent)
    named = df.filter(F.col(state).isNotNull()).select(by, F.xxhash64(by, state).alias("key")).distinct()
    return named.join(found.union(more).distinct(), "key", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("near"))


def diversity_report(df: DataFrame, by: str = "source", state: str = "state", n: int = GRAM, percent: int = NEAR) -> DataFrame:
    """(by, records, exact_copies, template_share, near_share) of every group.

    exact_copies are records whose state another record of the group has, less one a state; template_share is the part of the group that its
    commonest template has; near_share counts different states with a near copy, over the records. Null states count as records only.
    """
    counted = df.select(by, F.md5(F.col(state).cast("binary")).alias("_s"), F.md5(template(F.col(state)).cast("binary")).alias("_t"))
    states = counted.groupBy(by, "_t", "_s").agg(F.count(F.lit(1)).alias("_n"))
    shapes = states.groupBy(by, "_t").agg(F.sum("_n").alias("_n"), F.count("_s").alias("_d"))
    total = F.sum("_n")
    there = F.col("_t").isNotNull()
    groups = shapes.groupBy(by).agg(total.alias("records"), F.coalesce(F.sum(F.when(there, F.col("_n") - F.col("_d"))), F.lit(0)).alias("exact_copies"),
                                    (F.coalesce(F.max(F.when(there, F.col("_n"))), F.lit(0)) / total).alias("template_share"))
    near = near_copies(df, by, state, n, percent).withColumnRenamed(by, "_by")
    return groups.join(near, F.col(by).eqNullSafe(F.col("_by")), "left").select(
        by, "records", "exact_copies", "template_share", (F.coalesce("near", F.lit(0)) / F.col("records")).alias("near_share"))
