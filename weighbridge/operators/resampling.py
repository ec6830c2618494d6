"""Poisson bootstrap over rows or clusters.

In every replicate a row has a Poisson(1) weight, read off an md5 of (seed, key, replicate), so a result depends neither on order nor on
partitioning and SQL can repeat it. A row meets its weights inside the task that reads it; what leaves a task is one weighted sum a group and replicate.
A cluster bootstrap draws one weight a cluster: cluster totals are summed first, and the estimate is a ratio of weighted totals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.session import spread

TASK_BLOCKS = 500  # blocks of replicates that a row brings at most to a task's share of the work
PIECES = 4  # weights in one md5: eight hex digits each


def poisson_bounds() -> list[str]:
    """The numbers of 32 bits, in hex, from which on the weight is 1, 2, 3 ..."""
    out, chance, below = [], math.exp(-1), 0.0
    for k in range(12):
        below += chance
        chance /= k + 1
        out.append(f"{math.floor(below * 2**32):08x}")
    return out


BOUNDS = poisson_bounds()


def poisson_weight(digits: Column) -> Column:
    """Poisson(1) by inversion; eight hex digits sort like the number they spell."""
    weight = F.when(digits < BOUNDS[0], 0)
    for k, b in enumerate(BOUNDS[1:]):
        weight = weight.when(digits < b, k + 1)  # the likeliest come first
    return weight.otherwise(len(BOUNDS))


def interval(values: Column, interpolate: bool = False) -> tuple[Column, Column]:
    """The 2.5th and 97.5th percentile of an ascending array.

    Plainly the elements int(.025 n) and int(.975 n) - 1 from 0, or between neighbours when interpolated; null for an empty array.
    """
    n = F.size(values)
    if not interpolate:
        at = lambda i: F.try_element_at(values, F.greatest(i, F.lit(0)).cast("int") + 1)
        return at(F.floor(0.025 * n)), at(F.floor(0.975 * n) - 1)

    def between(q: float) -> Column:
        place = (n - 1) * F.lit(q)
        low = F.try_element_at(values, F.floor(place).cast("int") + 1)
        high = F.try_element_at(values, F.least(F.floor(place).cast("int") + 2, n))
        return low + (place - F.floor(place)) * (high - low)

    return tuple(F.when(n > 0, between(q)) for q in (0.025, 0.975))


def poisson_intervals(rows: DataFrame, key: str, measures: Mapping[str, tuple[Column, Column]], by: Sequence[str] = (), resamples: int = 1000, seed: int = 20260926,
                      interpolate: bool = False) -> DataFrame:
    """(by, measure, n, mean, low, high): the ratio of two sums and its 95% bootstrap interval, for every group and measure.

    measures names (numerator, denominator); rows where either is null do not count for it. n is the number of rows that count. A replicate in which
    all of a group's weights are zero has no mean and is left out.
    """
    names = list(measures)
    parts = [F.struct(*[F.when(top.isNotNull() & bottom.isNotNull(), c.cast("double")).alias(x) for x, c in (("top", top), ("bottom", bottom))]).alias(f"_m{i}")
             for i, (top, bottom) in enumerate(measures.values())]
    blocks = -(-resamples // PIECES)
    # The work is rows times blocks: a task takes the rows of one core for TASK_BLOCKS blocks, however many resamples are drawn.
    narrow = spread(rows.select(*by, F.col(key).cast("string").alias("_key"), *parts), times=-(-blocks // TASK_BLOCKS))
    # Block -1 has no hash and weight 1: the estimate itself comes out of the same pass.
    wide = narrow.withColumn("_block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))
    hashed = wide.withColumn("_md5", F.when(F.col("_block") >= 0, F.md5(F.concat_ws("|", F.lit(str(seed)), "_key", F.col("_block").cast("string")).cast("binary"))))
    values = [f"_m{i}" for i in range(len(names))]
    digits = hashed.select(*by, "_block", *values, *[F.substring("_md5", 8 * j + 1, 8).alias(f"_d{j}") for j in range(PIECES)])
    weights = [F.when(F.col("_block") < 0, F.lit(1)).otherwise(poisson_weight(F.col(f"_d{j}"))).alias(f"_w{j}") for j in range(PIECES)]
    weighed = digits.select(*by, "_block", *values, *weights)
    sums = [F.array(*[F.struct(F.sum(F.col(f"_w{j}") * F.col(f"_m{i}.top")).alias("top"), F.sum(F.col(f"_w{j}") * F.col(f"_m{i}.bottom")).alias("bottom")) for j in range(PIECES)]).alias(f"_s{i}")
            for i in range(len(names))]
    counts = [F.count(f"_m{i}.top").alias(f"_n{i}") for i in range(len(names))]
    folded = weighed.groupBy(*by, "_block").agg(*sums, *counts)
    long = folded.select(*by, "_block", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"_s{i}").alias("s"), F.col(f"_n{i}").alias("n")) for i, n in enumerate(names)])).alias("_x"))
    each = long.select(*by, "_x.measure", "_block", "_x.n", F.posexplode("_x.s").alias("_j", "_s"))
    ratio = F.col("_s.top") / F.nullif(F.col("_s.bottom"), F.lit(0.0))
    drawn = (F.col("_block") >= 0) & (F.col("_block") * PIECES + F.col("_j") < resamples)
    # One array of at most `resamples` numbers a group and measure.
    out = each.groupBy(*by, "measure").agg(
        F.max(F.when(F.col("_block") < 0, F.col("n"))).alias("n"), F.max(F.when((F.col("_block") < 0) & (F.col("_j") == 0), ratio)).alias("mean"),
        F.sort_array(F.collect_list(F.when(drawn, ratio))).alias("_draws"))
    low, high = interval(F.col("_draws"), interpolate)
    return out.select(*by, "measure", "n", "mean", low.alias("low"), high.alias("high"))


def cluster_intervals(rows: DataFrame, cluster: str, measures: Mapping[str, Column], by: Sequence[str] = (), resamples: int = 1000, seed: int = 20260926) -> DataFrame:
    """(by, measure, n, mean, low, high): mean of every measure with weights drawn a cluster; n is the number of clusters.

    Members of a cluster come and go together, so repeated or related items do not narrow the interval.
    """
    names = list(measures)
    totals = rows.groupBy(*by, F.col(cluster).alias("_cluster")).agg(
        *[a for i, c in enumerate(measures.values()) for a in (F.sum(c).alias(f"_t{i}"), F.nullif(F.count(c), F.lit(0)).alias(f"_c{i}"))])
    return poisson_intervals(totals, "_cluster", {n: (F.col(f"_t{i}"), F.col(f"_c{i}")) for i, n in enumerate(names)}, by, resamples, seed)


def intervals_sql(source: str, by: str, resamples: int, seed: int = 20260926, interpolate: bool = False) -> str:
    """Checking SQL: source yields the comma-separated columns of by, key, top and bottom; gives by, low and high."""
    weight = " + ".join(f"(d >= '{b}')::INT" for b in BOUNDS)
    groups = f"{by}, " if by else ""
    if interpolate:
        ends = "quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high"
    else:
        ends = "list_sort(list(m))[floor(0.025 * count(m))::INT + 1] AS low, list_sort(list(m))[greatest(floor(0.975 * count(m))::INT, 1)] AS high"
    return f"""
SELECT {groups}{ends} FROM (
  SELECT {groups}r, sum(w * top) / nullif(sum(w * bottom), 0) AS m FROM (
    SELECT *, {weight} AS w FROM (
      SELECT *, substr(md5('{seed}|' || key || '|' || (r // 4)), 8 * (r % 4) + 1, 8) AS d FROM ({source}), range({resamples}) AS t(r)))
  WHERE top IS NOT NULL AND bottom IS NOT NULL GROUP BY {groups}r) WHERE m IS NOT NULL {'GROUP BY ' + by if by else ''}"""
