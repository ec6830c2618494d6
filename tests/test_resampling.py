"""Bootstrap intervals against a plain loop, theory and each other."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from weighbridge.operators import comparison as cmp
from weighbridge.operators import resampling as R


def weights(key, resamples, seed):
    chance, table = math.exp(-1), []
    for k in range(40):
        table.append(chance)
        chance /= k + 1
    cdf = np.cumsum(table)
    out = []
    for r in range(resamples):
        digits = hashlib.md5(f"{seed}|{key}|{r // 4}".encode()).hexdigest()[8 * (r % 4): 8 * (r % 4) + 8]
        out.append(int(np.searchsorted(cdf[:12], int(digits, 16) / 2**32, "right")))
    return np.array(out)


def test_weights_are_poisson():
    w = np.concatenate([weights(k, 400, 1) for k in range(100)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and w.max() >= 5


def test_intervals_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", f"g{i % 3}", None if i % 11 == 0 else float(rng.normal()), float(i % 4)) for i in range(120)] + [("alone", "g9", None, 1.0), ("single", "g8", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, g string, x double, y double")
    got = {(r.g, r.measure): r for r in R.poisson_intervals(df, "id", {"x": (F.col("x"), F.lit(1)), "ratio": (F.col("x"), F.col("y"))}, ["g"], 42, 5).collect()}
    for g in ("g0", "g1", "g2", "g8", "g9"):
        mine = [r for r in rows if r[1] == g and r[2] is not None]
        w = np.array([weights(r[0], 42, 5) for r in mine]).reshape(len(mine), 42)
        for name, bottom in (("x", lambda r: 1.0), ("ratio", lambda r: r[3])):
            r = got[g, name]
            top, low = np.array([m[2] for m in mine]), np.array([bottom(m) for m in mine])
            assert r.n == len(mine)
            if not mine:
                assert r["mean"] is None and r.low is None and r.high is None
                continue
            s = w.T @ low
            draws = np.sort((w.T @ top)[s != 0] / s[s != 0])
            want = (top.sum() / low.sum(), draws[int(0.025 * len(draws))], draws[max(int(0.975 * len(draws)) - 1, 0)])
            assert np.allclose((r["mean"], r.low, r.high), want)
    one = R.poisson_intervals(df, "id", {"x": (F.col("x"), F.lit(1))}, (), 42, 5, interpolate=True).first()
    mine = [r for r in rows if r[2] is not None]
    w = np.array([weights(r[0], 42, 5) for r in mine])
    assert np.allclose((one.low, one.high), np.quantile((w.T @ np.array([r[2] for r in mine])) / w.sum(axis=0), [0.025, 0.975]))
    assert R.poisson_intervals(df.limit(0), "id", {"x": (F.col("x"), F.lit(1))}, ["g"], 8).count() == 0


def test_rows_and_counts_agree(spark):
    """The interval from weighted rows and the one from counts alone estimate the same thing."""
    rows = [(str(i), i % 5 != 0, i % 7 != 0) for i in range(2000)]
    items = spark.createDataFrame(rows, "id string, old boolean, new boolean")
    row = cmp.paired_difference(items, resamples=2000).first()
    counted = cmp.with_interval(spark.createDataFrame([(row.n, row.wins, row.losses)], "n bigint, wins bigint, losses bigint"), 2000).first()
    assert abs(row.low - counted.low) < 0.004 and abs(row.high - counted.high) < 0.004 and row.low < row["mean"] < row.high


def test_clusters_widen_the_interval_of_repeated_items(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{c}-{k}", f"c{c}", float(x)) for c, x in enumerate(rng.normal(size=150)) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, c string, x double")
    single = R.poisson_intervals(df, "id", {"x": (F.col("x"), F.lit(1))}, resamples=400).first()
    grouped = R.cluster_intervals(df, "c", {"x": F.col("x")}, resamples=400).first()
    assert grouped.n == 150 and math.isclose(grouped["mean"], single["mean"]) and (grouped.high - grouped.low) > 3 * (single.high - single.low)
    means = [x for _, _, x in rows[::20]]
    assert abs((grouped.high - grouped.low) / 2 / (1.96 * np.std(means) / math.sqrt(150)) - 1) < 0.2  # as theory has it for 150 independent means


def test_many_replicates_make_more_tasks_not_longer_ones(spark):
    from weighbridge.session import spread

    rows = spark.range(8).repartition(2)
    cores = spark.sparkContext.defaultParallelism
    assert [spread(rows, times=n).rdd.getNumPartitions() for n in (1, 10)] == [cores, 10 * cores]
    assert spread(spark.range(8).repartition(20), times=3).rdd.getNumPartitions() == 60
