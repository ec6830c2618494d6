"""Registry equality, license clearance and the training allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.text import card_license

# Licenses a fitting source may state.
PERMISSIVE = ("cc-by-4.0", "cc-by-3.0", "cc0-1.0", "mit", "apache-2.0")


def registry_check(a: DataFrame, b: DataFrame, name: str = "source") -> DataFrame:
    """Entries of two registries that are not in both; empty when the sets are equal."""
    left = a.select(name).distinct().withColumn("_a", F.lit(True))
    right = b.select(name).distinct().withColumn("_b", F.lit(True))
    return left.join(right, name, "full").filter(F.col("_a").isNull() | F.col("_b").isNull()).select(
        name, F.when(F.col("_a").isNull(), "only second").otherwise("only first").alias("where"))


def license_gate(registry: DataFrame, permissive: Sequence[str] = PERMISSIVE) -> DataFrame:
    """Per source: stated licenses and clearance.

    registry: source, role, card (text or null), evidence (array<boolean>, one per pattern looked for). A fitting
    source is cleared when all it states is permissive, or it states nothing and every piece of evidence was found.
    An excluded source is cleared by its evidence; others have no clearance.
    """
    stated = F.array_distinct(card_license(F.coalesce("card", F.lit(""))))
    evidence = F.coalesce("evidence", F.array().cast("array<boolean>"))
    found = (F.size(evidence) > 0) & F.forall(evidence, lambda e: e)
    allowed = F.size(F.array_except("stated", F.array(*[F.lit(p) for p in permissive]))) == 0
    states = F.size("stated") > 0
    cleared = F.when(F.col("role") == "fit", (states & allowed) | (~states & found)).when((F.col("role") == "excluded") & (F.size(evidence) > 0), found)
    return registry.withColumn("stated", stated).withColumn("cleared", cleared)


def blocked_sources(gate: DataFrame) -> DataFrame:
    """Fitting sources that are not cleared; a build must find none."""
    return gate.filter((F.col("role") == "fit") & ~F.coalesce("cleared", F.lit(False))).select("source")


def allow_list_offenders(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Sources outside the allowed set with their row counts. Sources are counted first, so the join is tiny."""
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(allowed.select("source").distinct(), "source", "left_anti")
