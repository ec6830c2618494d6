"""Exact ranks under skew and ties."""

import random

from pyspark.sql import functions as F

from weighbridge.functions.hashing import hex_mod, seeded_bucket
from weighbridge.operators.ranking import rank_percentile


def want(values, f):
    values = sorted(values)
    return values[round((len(values) - 1) * f)]


def test_rank_percentile_is_exact(spark):
    rng = random.Random(1)
    groups = {
        "ties": [5.0] * 3000 + [rng.random() for _ in range(50)],
        "tail": [rng.paretovariate(0.6) for _ in range(5000)],
        "one": [7.0],
        "two": [1.0, 2.0],
        "negative": [-rng.random() for _ in range(101)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    fractions = {"q1": 0.25, "median": 0.5, "p95": 0.95, "last": 1.0}
    for r in rank_percentile(df, ["g"], "v", fractions).collect():
        vs = groups[r["g"]]
        assert r["n"] == len(vs)
        for name, f in fractions.items():
            assert r[name] == want(vs, f), (r["g"], name)


def test_rank_percentile_without_groups(spark):
    vs = [float(i * 37 % 1009) for i in range(1009)]
    row = rank_percentile(spark.createDataFrame([(v,) for v in vs], "v double"), [], "v", {"p95": 0.95}).first()
    assert (row["n"], row["p95"]) == (1009, want(vs, 0.95))


def test_hex_mod_is_exact(spark):
    import hashlib

    keys = [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for k in (2, 3, 5, 6, 97, 2**31 - 1):
        got = {r[0]: r[1] for r in df.select("k", seeded_bucket(F.col("k"), k)).collect()}
        assert got == {key: int(hashlib.sha256(key.encode()).hexdigest(), 16) % k for key in keys}
    assert df.select(hex_mod(F.sha2("k", 256), 4)).count() == 200


def test_rank_percentile_of_a_million_values_in_a_narrow_range(spark):
    """All values share their leading bits; no group is sorted and no window is used."""
    df = spark.range(1_000_000).select((F.lit(1.0) + (F.col("id") * 7919 % 1_000_000) * F.lit(2.0**-40)).alias("v"))
    out = rank_percentile(df, [], "v", {"median": 0.5, "p95": 0.95})
    row = out.first()
    assert (row["n"], row["median"], row["p95"]) == (1_000_000, 1 + round(999_999 * 0.5) * 2.0**-40, 1 + round(999_999 * 0.95) * 2.0**-40)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_rank_percentile_orders_all_doubles(spark):
    vs = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0, 2.5]
    df = spark.createDataFrame([(v,) for v in vs] + [(None,)], "v double")
    for k in range(len(vs)):
        assert rank_percentile(df, [], "v", {"x": k / (len(vs) - 1)}).first()["x"] == sorted(vs)[k]
    assert rank_percentile(df.filter("v IS NULL"), [], "v", {"x": 0.5}).count() == 0
