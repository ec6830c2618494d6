"""Fit global calibration from saved logits: every grid point in one pass over the traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.probability import FLOOR
from weighbridge.operators.readout import Calibration, distribution, read_options, trace_problem, yes_probability

# The search grid.
TEMPERATURES = (0.5, 0.65, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0)
BIASES = (-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0)


def _loss(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(FLOOR)))


def usable(records: DataFrame, predictions: DataFrame, canonical: bool = False) -> DataFrame:
    """Traces beside the gold position; `usable` is false where the prediction cannot be replayed."""
    pred = predictions.select("id", F.col("error").alias("_e"), F.col("input_sha256").alias("_i"), "traces")
    j = records.select("id", "primitive", "question", "label", "input_sha256").join(pred, "id", "left")
    j = j.withColumn("_o", read_options(F.col("question"), canonical))
    keys = F.transform("_o", lambda o: o["key"])
    good = F.col("_e").isNull() & F.col("_i").eqNullSafe(F.col("input_sha256")) & trace_problem(F.col("traces"), F.size("_o")).isNull()
    return j.select(
        "id", F.when(F.col("primitive") == "noul", "noul").otherwise("choice_score").alias("kind"), "label",
        F.array_position(keys, F.col("label")).cast("int").alias("gold"), "traces", good.alias("usable"),
    )


def _noul_loss(temperature, noul_temperature, bias) -> Column:
    yes = yes_probability(F.element_at(F.col("traces"), 1)["logits"], temperature, noul_temperature, bias)
    return _loss(F.when(F.col("label") == "1", yes).otherwise(1 - yes))


def _choice_loss(temperature) -> Column:
    return _loss(F.element_at(distribution(F.col("traces"), temperature), F.col("gold")))


def mean_nll(records: DataFrame, predictions: DataFrame, calibration: Calibration = Calibration(), canonical: bool = False) -> DataFrame:
    """Mean hard-label loss under one calibration, per kind, with the rows that could not be replayed."""
    c = calibration
    rows = usable(records, predictions, canonical)
    noul = F.col("kind") == "noul"
    loss = F.when(F.col("usable") & noul, _noul_loss(c.temperature, c.noul_temperature, c.noul_bias)).when(F.col("usable"), _choice_loss(c.temperature))
    return rows.select("kind", "usable", loss.alias("loss")).groupBy("kind").agg(
        F.count("loss").alias("n"), F.count_if(~F.col("usable")).alias("rejected"), F.avg("loss").alias("nll"))


def grid_trials(records: DataFrame, predictions: DataFrame, temperatures: Sequence[float] = TEMPERATURES, biases: Sequence[float] = BIASES,
                canonical: bool = False) -> DataFrame:
    """Every trial: kind, temperature, bias, mean loss, replayed and rejected rows.

    One pass: a row meets every grid point while it is in memory, and the losses collapse to one sum per point
    inside each task before anything is shuffled.
    """
    rows = usable(records, predictions, canonical)
    point = lambda t, b, loss: F.struct(t.alias("temperature"), b.alias("bias"), loss.alias("loss"))
    ts, bs = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (temperatures, biases))
    none = F.lit(None).cast("double")
    choice = F.transform(ts, lambda t: point(t, F.lit(0.0), F.when(F.col("usable"), _choice_loss(t)).otherwise(none)))
    binary = F.flatten(F.transform(ts, lambda t: F.transform(bs, lambda b: point(t, b, F.when(F.col("usable"), _noul_loss(F.lit(1.0), t, b)).otherwise(none)))))
    each = rows.select("kind", F.explode(F.when(F.col("kind") == "noul", binary).otherwise(choice)).alias("x")).select("kind", "x.*")
    return each.groupBy("kind", "temperature", "bias").agg(
        F.avg("loss").alias("nll"), F.count("loss").alias("n"), (F.count(F.lit(1)) - F.count("loss")).alias("rejected"))


def fit_grid(records: DataFrame, predictions: DataFrame, temperatures: Sequence[float] = TEMPERATURES, biases: Sequence[float] = BIASES,
             canonical: bool = False) -> DataFrame:
    """The best calibration and its losses, as one row.

    The temperature minimises the choice and score loss, ties nearest 1. The yes/no loss depends only on the
    effective temperature and the bias, so both searches share the pass; ties go to the smaller bias, then to the
    yes/no temperature nearest 1. A grid without 1.0 or bias 0 has no 'before' loss.
    """
    noul, t, b = F.col("kind") == "noul", F.col("temperature"), F.col("bias")
    trials = grid_trials(records, predictions, temperatures, biases, canonical)
    # The trial table has one row per grid point, so gathering it into one row is a fixed hundred entries.
    row = trials.agg(
        F.min(F.when(~noul, F.struct("nll", F.abs(t - 1).alias("tie"), t.alias("t")))).alias("_c"),
        F.collect_list(F.when(noul, F.struct("nll", t.alias("t"), b.alias("b")))).alias("_all"),
        F.max(F.when(~noul, F.col("n"))).alias("choice_score_records"), F.max(F.when(noul, F.col("n"))).alias("noul_records"),
        (F.coalesce(F.max(F.when(~noul, F.col("rejected"))), F.lit(0)) + F.coalesce(F.max(F.when(noul, F.col("rejected"))), F.lit(0))).alias("rejected"),
        F.max(F.when(~noul & (t == 1.0), F.col("nll"))).alias("before_choice_score_nll"),
        F.max(F.when(noul & (t == 1.0) & (b == 0.0), F.col("nll"))).alias("before_noul_nll"),
    )
    ordered = F.transform("_all", lambda x: F.struct(
        x["nll"].alias("nll"), F.abs(x["b"]).alias("bias_tie"), F.abs(x["t"] / F.col("_c.t") - 1).alias("t_tie"), x["t"].alias("t"), x["b"].alias("b")))
    row = row.withColumn("_b", F.array_min(ordered))
    return row.select(
        F.col("_c.t").alias("temperature"), (F.col("_b.t") / F.col("_c.t")).alias("noul_temperature"), F.col("_b.b").alias("noul_bias"),
        "choice_score_records", "noul_records", "rejected", "before_choice_score_nll", "before_noul_nll",
        F.col("_c.nll").alias("after_choice_score_nll"), F.col("_b.nll").alias("after_noul_nll"),
    )


def fit_temperatures(records: DataFrame, predictions: DataFrame, temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    """fit_grid over sorted options with the yes/no bias held at zero."""
    return fit_grid(records, predictions, temperatures, (0.0,), canonical=True)


def binary_pool(records: DataFrame) -> DataFrame:
    """Yes/no rows and gold yes, per source and overall."""
    return records.filter(F.col("primitive") == "noul").groupingSets([["source"], []], "source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("label") == "1").alias("gold_yes"), F.grouping("source").alias("_g"),
    ).select(F.when(F.col("_g") == 1, "overall").otherwise(F.col("source")).alias("scope"), "records", "gold_yes",
             (F.col("gold_yes") / F.nullif(F.col("records"), F.lit(0))).alias("gold_yes_share"))


def fit_guards(records: DataFrame, frozen: bool = False) -> DataFrame:
    """One row: repeated ids and rows outside validation; a declared frozen split may use any rows."""
    per_id = records.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("split").eqNullSafe(F.lit("validation"))).alias("o"))
    out = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum("o"), F.lit(0)).alias("outside_validation"))
    return out.withColumn("passed", (F.col("duplicate_ids") == 0) & (F.lit(frozen) | (F.col("outside_validation") == 0)))


def calibration_match(calibrations: DataFrame, identities: DataFrame, version: str, default_version: str, by: str = "model") -> DataFrame:
    """Per model: why its calibration must not be used, or null. A missing readout version means the default one."""
    c = calibrations.select(by, *[F.col(k).alias(f"_{k}") for k in ("model_sha256", "adapter_sha256", "readout_version")], F.lit(True).alias("_has"))
    reason = (
        F.when(F.col("_has").isNull(), F.lit(None))
        .when(~F.col("_model_sha256").eqNullSafe(F.col("model_sha256")), "fitted to different weights: model_sha256")
        .when(~F.col("_adapter_sha256").eqNullSafe(F.col("adapter_sha256")), "fitted to different weights: adapter_sha256")
        .when(F.coalesce("_readout_version", F.lit(default_version)) != version, "different readout version")
    )
    return identities.join(c, by, "left").select(by, F.coalesce("_has", F.lit(False)).alias("calibrated"), reason.alias("reason"))


