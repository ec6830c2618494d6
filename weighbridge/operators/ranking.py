"""Exact ranks without putting a whole group into one task.

Hash-ordered ranks split every group by hash prefix (4,096 even pieces); value ranks are found by counting over
leading bits, round by round. Both are exact whatever the skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weighbridge.functions.text import let
from weighbridge.session import broadcast_if_small, cut

PREFIX = 3  # hex digits
DIGIT = 16  # bits of a value that one round of a selection counts by
GROUPS_BROADCAST = 100_000


def ranked(df: DataFrame, by: list[str], order: str, tie: str, limit: Column | int | None = None,
           prefix: int = PREFIX) -> DataFrame:
    """Add 1-based `rank` inside `by` in (order, tie) order; order is a hex hash.

    With a limit (a number or a column constant within a group) only rows up to it are kept, and pieces
    wholly beyond it are dropped before the ranking shuffle.
    """
    piece = F.substring(F.col(order), 1, prefix)
    df = df.withColumn("_piece", piece)
    sizes = df.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if isinstance(limit, int):
        offsets = offsets.filter(F.col("_before") < limit)
    keys = [*by, "_piece"]
    joined = df.join(offsets, keys)
    if limit is not None and not isinstance(limit, int):
        joined = joined.filter(F.col("_before") < limit)
    inside = Window.partitionBy(*keys).orderBy(order, tie)
    out = joined.withColumn("rank", F.col("_before") + F.row_number().over(inside))
    if limit is not None:
        out = out.filter(F.col("rank") <= limit)
    return out.drop("_piece", "_before")


def _attach(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Put a written one-row-per-group table beside the rows; without groups its single row stands beside all."""
    if by:
        return rows.join(broadcast_if_small(small, small.count(), GROUPS_BROADCAST), by)
    return rows.withColumn("_all", F.lit(1)).join(F.broadcast(small.withColumn("_all", F.lit(1))), "_all").drop("_all")


def _order_key(value: Column) -> Column:
    """The bits of a double as a number that sorts like the value: those of a negative one are turned round. Negative zero is zero."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return let(bits, lambda b: F.when(b < 0, b.bitwiseXOR(F.lit(2**63 - 1))).otherwise(b))


def _pick(cells: Column, at: Column) -> Column:
    """The cell that holds sorted index at, and the index inside it; cells are in order of their prefix."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast(SLOT).alias("hit"))
    here = lambda s, c: F.struct(c["p"].alias("p"), (at - s["before"]).alias("at"), (c["lo"] == c["hi"]).alias("done"), c["v"].alias("v"))
    step = lambda s, c: F.struct((s["before"] + c["c"]).alias("before"), F.when(s["hit"].isNotNull(), s["hit"]).when(s["before"] + c["c"] > at, here(s, c)).alias("hit"))
    return F.aggregate(cells, start, step, lambda s: s["hit"])


SLOT = "struct<p:bigint,at:bigint,done:boolean,v:double>"


def rank_percentile(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group: n and the value at sorted index round((n-1)*f), half to even, for every named fraction.

    Radix selection: values become 64-bit keys of the same order; a round counts rows by their leading bits in partial aggregates, keeps for every
    wanted rank the one prefix that holds it, and the next round counts the following bits of rows with a kept prefix. A prefix with one value
    ends its search, so there are at most four rounds. No rows are sorted, and a round yields at most 65,536 counts a group and fraction.
    """
    names = list(fractions)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    keyed = cut(rows.withColumn("_k", _order_key(F.col("_v"))))
    cell = F.struct(F.col("_p").alias("p"), F.col("_c").alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_w").alias("v"))

    def counted(part: DataFrame, bits: int) -> DataFrame:
        cells = part.groupBy(*by, F.shiftright("_k", bits).alias("_p")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.min("_v").alias("_w"))
        return cells.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sort_array(F.collect_list(cell)).alias("_cells"))

    wanted = [F.rint((F.col("_n") - 1) * F.lit(f)).cast("bigint") for f in fractions.values()]
    found = counted(keyed, 64 - DIGIT).filter(F.col("_n") > 0)
    plan = cut(found.select(*by, F.col("_n").alias("n"), *[_pick(F.col("_cells"), w).alias(f"_s{i}") for i, w in enumerate(wanted)]))
    each = range(len(names))
    for bits in range(64 - 2 * DIGIT, -1, -DIGIT):
        waiting = reduce(lambda a, b: a | b, [~F.col(f"_s{i}.done") for i in each])
        if plan.filter(waiting).isEmpty():
            break
        open_ = plan.filter(waiting).select(*by, *[F.when(~F.col(f"_s{i}.done"), F.col(f"_s{i}.p")).alias(f"_p{i}") for i in each])
        head = F.shiftright("_k", bits + DIGIT)
        inside = reduce(lambda a, b: a | b, [F.coalesce(head == F.col(f"_p{i}"), F.lit(False)) for i in each])
        cells = cut(counted(_attach(keyed, open_, by).filter(inside), bits).drop("_n"))
        both = plan.join(cells, by, "left") if by else _attach(plan, cells, by)
        mine = lambda i: F.filter("_cells", lambda c: F.shiftright(c["p"], DIGIT) == F.col(f"_s{i}.p"))
        plan = cut(both.select(*by, "n", *[F.when(F.col(f"_s{i}.done"), F.col(f"_s{i}")).otherwise(_pick(mine(i), F.col(f"_s{i}.at"))).alias(f"_s{i}") for i in each]))
    return plan.select(*by, "n", *[F.col(f"_s{i}.v").alias(name) for i, name in enumerate(names)])
