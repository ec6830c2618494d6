"""Block statistics of vectors stored as one scale and codes in {-1, 0, 1} per block. No element is exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.text import let

TINY = 1e-300


def blocks(vector: Column, block: int) -> Column:
    """array<array<double>>: consecutive blocks of equal size."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return let(doubles, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int") - 1), lambda i: F.slice(v, i * block + 1, block)))


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(x)))


def _codes(values: Column, scale: Column) -> Column:
    return F.transform(values, lambda x: F.when(scale != 0, _clip(x / F.nullif(scale, F.lit(0.0)))).otherwise(0.0))


def ternary(vector: Column, block: int) -> Column:
    """array<struct<scale, codes>>: the scale is the mean magnitude of the block."""
    def one(values: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x)) / block
        return let(mean, lambda s: F.struct(s.alias("scale"), _codes(values, s).alias("codes")))

    return F.transform(blocks(vector, block), one)


def block_ternarize(df: DataFrame, column: str, block: int) -> DataFrame:
    """Replace-by-blocks view of a vector column; vectors whose length is no multiple of the block are refused."""
    checked = F.when(F.size(column) % block == 0, F.col(column)).otherwise(F.raise_error(F.lit("vector width must be a multiple of the block")).cast(df.schema[column].dataType))
    return df.withColumn("blocks", ternary(checked, block))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _drift_sums(a: str, b: str, block: int) -> Column:
    """Per vector: sums over blocks of everything block_drift needs."""
    both = F.arrays_zip(ternary(F.col(a), block).alias("t"), blocks(F.col(a), block).alias("x"), blocks(F.col(b), block).alias("y"))

    def one(z: Column) -> Column:
        s = z["t"]["scale"]
        cells = F.zip_with(z["t"]["codes"], F.zip_with(z["x"], z["y"], lambda x, y: y - x), lambda c, d: F.struct(
            c.alias("c"), (s * c).alias("w"), d.alias("d"), F.when(s != 0, _clip((s * c + d) / F.nullif(s, F.lit(0.0)))).otherwise(0.0).alias("r")))
        return let(cells, lambda e: let(F.struct(
            _sum(e, lambda x: x["w"] * x["w"]).alias("ww"), _sum(e, lambda x: x["w"] * x["d"]).alias("wd"), _sum(e, lambda x: x["d"] * x["d"]).alias("dd"),
            _sum(e, lambda x: F.when(x["r"] != x["c"], 1.0).otherwise(0.0)).alias("flips"),
            _sum(e, lambda x: (s * x["r"] - x["w"]) * x["d"]).alias("nd"), _sum(e, lambda x: F.pow(s * x["r"] - x["w"], F.lit(2))).alias("nn"),
        ), lambda m: let(F.when(m["ww"] > 0, m["wd"] / F.nullif(m["ww"], F.lit(0.0))).otherwise(0.0), lambda g: F.struct(
            # g is the best block factor minus one: the change of the scale-only projection is g*w.
            m["ww"].alias("ww"), m["dd"].alias("dd"), m["flips"].alias("flips"), m["nd"].alias("nd"), m["nn"].alias("nn"),
            (g * m["wd"]).alias("sd"), (g * g * m["ww"]).alias("ss"), F.abs(g).alias("dev")))))

    return F.transform(both, one)


def block_drift(df: DataFrame, a: str, b: str, block: int, by: Sequence[str] = ()) -> DataFrame:
    """How much of the change from vector a to vector b survives in a's block code, per group.

    naive: keep the scales, round again. scale_only: keep the codes, best scale per block.
    """
    names = ("ww", "dd", "flips", "nd", "nn", "sd", "ss", "dev")
    rows = df.select(*by, F.size(a).alias("_n"), _drift_sums(a, b, block).alias("_b"))
    rows = rows.select(*by, "_n", F.size("_b").alias("_k"), *[_sum(F.col("_b"), lambda x, k=k: x[k]).alias(k) for k in names])
    s = rows.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_k").alias("blocks"), *[F.sum(k).alias(k) for k in names])
    c, floor = F.col, lambda x: F.greatest(x, F.lit(TINY))
    cosine = lambda rd, rr: c(rd) / F.sqrt(floor(c(rr) * c("dd")))
    error = lambda rd, rr: F.sqrt(F.greatest(c(rr) - 2 * c(rd) + c("dd"), F.lit(0.0)) / floor(c("dd")))
    return s.select(
        *by, "blocks", F.sqrt(c("dd") / floor(c("ww"))).alias("delta_to_weight_norm"), (c("flips") / c("n")).alias("code_flip_fraction"),
        cosine("nd", "nn").alias("naive_cosine"), error("nd", "nn").alias("naive_relative_error"), cosine("sd", "ss").alias("scale_only_cosine"),
        error("sd", "ss").alias("scale_only_relative_error"), (c("dev") / c("blocks")).alias("scale_factor_abs_deviation_mean"),
    )


def ternary_check(df: DataFrame, dense: str, coded: str, block: int, by: Sequence[str] = ()) -> DataFrame:
    """How a dense vector relates to another vector's block code: distinct values, code agreement, residual, cosine."""
    both = F.arrays_zip(blocks(F.col(dense), block).alias("w"), ternary(F.col(coded), block).alias("t"))

    def one(z: Column) -> Column:
        s = z["t"]["scale"]
        cells = F.zip_with(z["w"], F.zip_with(z["t"]["codes"], _codes(z["w"], s), lambda c, r: F.struct(c.alias("c"), r.alias("r"))), lambda w, p: F.struct(
            w.alias("w"), (s * p["c"]).alias("q"), F.when(p["c"] == p["r"], 1.0).otherwise(0.0).alias("same")))
        return let(cells, lambda e: F.struct(
            F.size(F.array_distinct(F.transform(z["w"], lambda w: F.round(w, 6)))).alias("distinct"), _sum(e, lambda x: x["same"]).alias("same"),
            _sum(e, lambda x: x["w"] * x["w"]).alias("ww"), _sum(e, lambda x: x["q"] * x["q"]).alias("qq"), _sum(e, lambda x: x["w"] * x["q"]).alias("wq"),
            F.array_max(F.transform(e, lambda x: F.abs(x["q"]))).alias("qmax"), F.array_max(F.transform(e, lambda x: F.abs(x["w"] - x["q"]))).alias("gap")))

    rows = df.select(*by, F.size(dense).alias("_n"), F.explode(F.transform(both, one)).alias("b"))
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"),
        # At most `block` different counts exist, so the exact median keeps a tiny histogram.
        F.median("b.distinct").alias("median_distinct_values_per_block"), F.max("b.distinct").alias("max_distinct_values_per_block"),
        (F.sum("b.same") / (F.count(F.lit(1)) * block)).alias("code_agreement_after_rounding"),
        F.sum("b.ww").alias("ww"), F.sum("b.qq").alias("qq"), F.sum("b.wq").alias("wq"), F.max("b.qmax").alias("qmax"), F.max("b.gap").alias("gap"),
    )
    residual = F.sqrt(F.greatest(F.col("ww") - 2 * F.col("wq") + F.col("qq"), F.lit(0.0))) / F.greatest(F.sqrt("ww"), F.lit(TINY))
    return s.withColumns({
        "relative_residual_to_ternary": residual, "cosine_with_ternary": F.col("wq") / F.greatest(F.sqrt(F.col("ww") * F.col("qq")), F.lit(TINY)),
        "exactly_dequantized": F.col("gap") <= 1e-3 * F.col("qmax"),
    }).drop("ww", "qq", "wq", "qmax", "gap")


def drift_summary(drift: DataFrame, by: str, measures: Sequence[str] = (
        "delta_to_weight_norm", "code_flip_fraction", "naive_cosine", "naive_relative_error", "scale_only_cosine", "scale_only_relative_error")) -> DataFrame:
    """Mean, minimum and maximum of per-vector drift, long format by kind and measure."""
    long = drift.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])).alias("x")).select(by, "x.measure", "x.v")
    return long.groupBy(by, "measure").agg(F.avg("v").alias("mean"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
