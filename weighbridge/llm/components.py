"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weighbridge.session import cut


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, counted while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def _cut_marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """cut(edges) and a fingerprint of its rows, taken while they are written."""
    seen = Observation()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")))
    return out, (seen.get["n"], seen.get["mark"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links; root is the least node it is connected to.

    Every round joins links to one least neighbour per node, so a hub only meets sums; a hub's links are split by the join. Rounds
    grow with the logarithm of the longest chain. Nulls and loops are ignored; no links give no rows.
    """
    edges, mark = _cut_marked(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while mark[0]:
        # Large star: every larger neighbour of a node is tied to the node's least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = edges.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: every smaller neighbour, and the node itself, is tied to the least one.
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        tied = large.join(down, F.col("u") == F.col("x")).select("x", F.col("v").alias("w"), "m")
        ends = F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("m").alias("v")), F.struct(F.col("x").alias("u"), F.col("m").alias("v"))))
        edges, now = _cut_marked(tied.select(ends.alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
