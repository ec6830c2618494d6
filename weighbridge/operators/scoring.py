"""Scores with explicit denominators: a failed prediction is a wrong answer and is absent from probability means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.probability import (
    FLOOR, argmax, chosen, expected_labels, human_distribution, total, tvd, valid_probabilities, wilson_high, wilson_low,
)
from weighbridge.operators.ranking import rank_percentile

METRICS = ("nll", "brier_multiclass", "brier_binary", "score_mae", "rps", "human_tvd")


def answer_distribution(primitive: Column, answer: Column, labels: Column, allow_rounding: bool = False) -> Column:
    """Struct(p, reason) of an answer over the labels."""
    noul = answer["noul"]
    listed = F.transform(labels, lambda k: F.try_element_at(answer["probabilities"], k))
    p = F.when(primitive == "noul", F.array(1 - noul, noul)).otherwise(listed)
    extra = F.when(primitive == "noul", F.lit(False)).otherwise(
        F.coalesce(F.size(F.array_except(F.map_keys(answer["probabilities"]), labels)) > 0, F.lit(True)))
    return valid_probabilities(p, extra, allow_rounding)


def score_records(records: DataFrame, predictions: DataFrame, allow_rounding: bool = False) -> DataFrame:
    """One row per record: reason (null when valid), chosen label, correctness, and every metric.

    records: id, primitive, question, label, and optionally soft; other columns pass through.
    """
    pred = predictions.select("id", F.col("error").alias("_error"), F.col("answer").alias("_answer"), "latency_ms", F.lit(True).alias("_has"))
    return score_joined(records.join(pred, "id", "left"), allow_rounding)


def score_joined(j: DataFrame, allow_rounding: bool = False) -> DataFrame:
    """score_records after its join: record columns with _has, _error, _answer and latency_ms. Batch or stream."""
    columns = j.columns
    primitive, label = F.col("primitive"), F.col("label")
    j = j.withColumn("labels", expected_labels(F.col("question")))
    j = j.withColumn("_d", answer_distribution(primitive, F.col("_answer"), F.col("labels"), allow_rounding))
    j = j.withColumn("p", F.col("_d.p"))
    labels, p = F.col("labels"), F.col("p")
    soft = human_distribution(F.col("soft"), labels) if "soft" in columns else F.struct(
        F.lit(None).cast("array<double>").alias("h"), F.lit(None).cast("string").alias("reason"))
    j = j.withColumn("_h", soft).withColumn("chosen", chosen(primitive, F.col("_answer.choice"), labels, p))
    at = F.array_position(labels, label)
    picked = F.array_position(labels, F.col("chosen"))
    not_maximal = (primitive == "choice") & ~F.coalesce(F.try_element_at(p, F.nullif(picked, F.lit(0)).cast("int")) == F.array_max(p), F.lit(False))
    failed = F.coalesce(F.col("_error"), F.lit("")) != ""
    reason = F.coalesce(
        F.when(F.col("_has").isNull() | failed, F.lit("missing or failed prediction")),
        F.when(F.col("_answer").isNull(), F.lit("missing answer")),
        F.col("_d.reason"),
        F.when(at == 0, F.lit("gold label is not an option")),
        F.when(not_maximal, F.lit("choice does not have maximal probability")),
        F.col("_h.reason"),
    )
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    gold = F.element_at(p, at.cast("int"))
    ordinal = ok & (primitive == "score")
    cuts = F.size(p) - 1
    # Ranked probability score: squared gaps between the running sum and the step at the label, over the cut points.
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def cut_point(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x
        gap = cum - F.when(label.cast("int") <= acc["i"], 1.0).otherwise(0.0)
        return F.struct(cum.alias("cum"), (acc["sum"] + gap * gap).alias("sum"), (acc["i"] + 1).alias("i"))

    squared_gaps = F.aggregate(F.slice(p, F.lit(1), cuts), start, cut_point, lambda acc: acc["sum"])
    brier = total(F.transform(p, lambda x, i: F.pow(x - F.when(i == at - 1, 1.0).otherwise(0.0), F.lit(2))))
    out = j.withColumns({
        "correct": F.coalesce(ok & (F.col("chosen") == label), F.lit(False)),
        "p_gold": F.when(ok, gold),
        "top_probability": F.when(ok, F.array_max(p)),
        "nll": F.when(ok, -F.log(F.greatest(gold, F.lit(FLOOR)))),
        "brier_multiclass": F.when(ok, brier),
        "brier_binary": F.when(ok & (primitive == "noul"), F.pow(F.element_at(p, 2) - label.cast("int"), F.lit(2))),
        "score_mae": F.when(ordinal, F.abs(total(F.transform(p, lambda x, i: x * i)) - label.cast("double"))),
        "rps": F.when(ordinal, squared_gaps / cuts),
        "human_tvd": F.when(ok, tvd(p, F.col("_h.h"))),
    })
    return out.drop("_error", "_answer", "_has", "_d", "_h")


def _measures() -> list[Column]:
    valid = F.col("reason").isNull()
    n, correct = F.count(F.lit(1)), F.count_if(F.col("correct"))
    out = [
        n.alias("n"), F.count_if(valid).alias("valid"), correct.alias("correct"), (correct / n).alias("accuracy"),
        wilson_low(correct, n).alias("wilson_low"), wilson_high(correct, n).alias("wilson_high"),
    ]
    for m in METRICS:
        out += [F.avg(m).alias(m), F.count(m).alias(f"{m}_n")]
    return out


def summarize(scored: DataFrame) -> DataFrame:
    return scored.agg(*_measures())


def summarize_by(scored: DataFrame, column: str) -> DataFrame:
    return scored.groupBy(column).agg(*_measures())


def failures(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("reason").isNotNull()).select("id", "reason")


def report(scored: DataFrame, by: str = "source") -> DataFrame:
    """Overall and per-group summary in one pass; `scope` is 'overall' or the group."""
    return scored.groupingSets([[], [by]], by).agg(*_measures(), F.grouping(by).alias("_g")).withColumn(
        "scope", F.when(F.col("_g") == 1, "overall").otherwise(F.col(by))
    ).drop("_g", by)


def reliability_bins(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Ten equal-width bins of the top probability; empty bins are kept with n = 0."""
    keys = [by] if by else []
    bin_of = F.least(F.lit(9), F.floor(F.col("top_probability") * 10).cast("int"))
    valid = scored.filter(F.col("reason").isNull()).withColumn("bin", bin_of)
    found = valid.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("top_probability").alias("probability"),
    )
    ten = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")
    frame = scored.select(*keys).distinct().select(*keys, ten) if by else scored.sparkSession.range(1).select(ten)
    return frame.join(found, [*keys, "bin"], "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "lower": F.col("bin") / 10, "upper": (F.col("bin") + 1) / 10,
    })


def ece(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Calibration error of the top label over the ten bins."""
    keys = [by] if by else []
    weighted = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("probability")))
    return reliability_bins(scored, by).groupBy(*keys).agg((weighted / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def latency_stats(df: DataFrame, by: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """n, median and p95 by rounded rank, per group."""
    return rank_percentile(df, list(by), value, {"median": 0.5, "p95": 0.95})


def value_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, sum, mean, minimum and maximum of a measurement per group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )


def group_macro(scored: DataFrame, by: str = "group") -> DataFrame:
    """Mean of group accuracies, failures wrong, and the mean over answered rows of groups that have any."""
    per = scored.groupBy(by).agg(
        F.avg(F.col("correct").cast("double")).alias("a"),
        (F.count_if(F.col("correct")) / F.nullif(F.count_if(F.col("reason").isNull()), F.lit(0))).alias("o"),
    )
    return per.agg(F.count(F.lit(1)).alias("groups"), F.avg("a").alias("macro"), F.avg("o").alias("macro_observed"))


def expected_level() -> Column:
    return total(F.transform("p", lambda x, i: x * i))


def rounded_ev(scored: DataFrame) -> DataFrame:
    """Score rows judged by floor(expected level + 0.5): valid, correct, accuracy."""
    rows = scored.filter((F.col("primitive") == "score") & F.col("reason").isNull())
    hit = F.floor(expected_level() + 0.5) == F.col("label").cast("bigint")
    return rows.agg(
        F.count(F.lit(1)).alias("valid"), F.count_if(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy")
    )


def top_ties(scored: DataFrame) -> DataFrame:
    """Valid rows where several options share the maximal probability."""
    tied = F.size(F.filter("p", lambda x: x == F.array_max("p"))) > 1
    return scored.filter(F.col("reason").isNull() & tied).select("id")


def analytic_values() -> dict[str, Column]:
    """Per row, against the known answer distribution `analytic` (aligned with the labels)."""
    q, p = F.col("analytic"), F.col("p")
    ce = -total(F.zip_with(p, q, lambda x, y: y * F.log(F.greatest(x, F.lit(FLOOR)))))
    entropy = -total(F.transform(q, lambda y: F.when(y > 0, y * F.log(y)).otherwise(0.0)))
    pick = F.array_position(F.col("labels"), F.col("chosen")).cast("int")
    return {
        "expected_accuracy": F.try_element_at(q, F.nullif(pick, F.lit(0))),
        "bayes_accuracy_ceiling": F.array_max(q),
        "cross_entropy": ce,
        "kl_divergence": ce - entropy,
        "tvd": tvd(p, q),
        "squared_distribution_error": total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))),
        "expected_brier": total(F.zip_with(p, q, lambda x, y: x * x - 2 * x * y + y)),
    }


def analytic_metrics(scored: DataFrame, by: str = "deterministic") -> DataFrame:
    """Means against the known distribution: all rows, and per value of `by`."""
    ok = F.col("reason").isNull()
    values = analytic_values()
    rows = scored.select(by, "reason", *[F.when(ok, v).alias(k) for k, v in values.items()])
    return rows.groupingSets([[], [by]], by).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(ok).alias("valid"), *[F.avg(k).alias(k) for k in values],
        F.grouping(by).alias("_g"),
    ).withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise(F.col(by).cast("string"))).drop("_g", by)


def suite_states(scored: DataFrame, dims: Sequence[str], suite: str = "suite", subset: str = "subset", group: str = "group") -> DataFrame:
    """One row of sums and counts per cell (suite, subset, dims, group); sums of cells give every measure of every coarser scope.

    Without a column `analytic` the sums against a known distribution are left out; where it is null a row does not count as planned.
    """
    ok = F.col("reason").isNull()
    ordinal = ok & (F.col("primitive") == "score")
    hit = F.floor(expected_level() + 0.5) == F.col("label").try_cast("bigint")
    tied = F.size(F.filter("p", lambda x: x == F.array_max("p"))) > 1
    states = [
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.count_if("correct").alias("correct"), F.count_if(ok & tied).alias("top_ties"),
        F.count_if(ordinal).alias("rounded_valid"), F.count_if(ordinal & hit).alias("rounded_correct"),
        *[F.sum(m).alias(f"{m}_sum") for m in METRICS], *[F.count(m).alias(f"{m}_n") for m in METRICS],
    ]
    keys = list(dict.fromkeys([suite, subset, *dims, group]))
    rows = scored
    if "analytic" in scored.columns:
        known = F.col("analytic").isNotNull()
        values = analytic_values()
        rows = scored.withColumns({f"_{k}": F.when(ok & known, v) for k, v in values.items()})
        states += [F.count_if(known).alias("analytic_planned"), F.count_if(ok & known).alias("analytic_valid"), *[F.sum(f"_{k}").alias(f"{k}_sum") for k in values]]
    return rows.groupBy(*keys).agg(*states)


def whole_suite_report(scored: DataFrame, dims: Sequence[str] = ("family", "primitive"), suite: str = "suite", subset: str = "subset", group: str = "group") -> DataFrame:
    """(suite, subset, dimension, value, measure, amount): every measure of every suite, in total (subset `all`) and by subset.

    A scope is everything (dimension `all`) or one value of a dimension. Measures: the summary with its interval, judged expected levels, exact ties,
    means against a known distribution, and for whole scopes the number of groups with both means of group accuracies. A measure that no row
    has is left out; a null value of a dimension is named `null`. Cells are summed once, so the scored rows are read once, whatever the number of dimensions.
    """
    cells = suite_states(scored, dims, suite, subset, group)
    sums = [c for c in cells.columns if c not in {suite, subset, group, *dims}]
    cells = cells.select(F.col(suite).alias("_suite"), F.col(subset).alias("_subset"), F.col(group).alias("_group"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)], *sums)
    split = [f"_d{i}" for i in range(len(dims))]
    sets = [[*base, *more] for base in (["_suite"], ["_suite", "_subset"]) for more in ([], *[[c] for c in split], ["_group"])]
    scopes = cells.groupingSets(sets, "_suite", "_subset", "_group", *split).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.grouping(c).alias(f"{c}_off") for c in ("_subset", "_group", *split)])
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    dimension, value = F.lit("all"), F.lit("all")
    for c, d in zip(split, dims, strict=True):
        dimension = F.when(F.col(f"{c}_off") == 0, F.lit(d)).otherwise(dimension)
        value = F.when(F.col(f"{c}_off") == 0, named(c)).otherwise(value)
    # Groups are folded once more: they give their two means to the whole scope that they belong to.
    of_group = F.col("_group_off") == 0
    folded = scopes.groupBy(F.col("_suite").alias("suite"), F.when(F.col("_subset_off") == 1, "all").otherwise(named("_subset")).alias("subset"), dimension.alias("dimension"), value.alias("value")).agg(
        *[F.sum(F.when(~of_group, F.col(c))).alias(c) for c in sums],
        F.nullif(F.count_if(of_group), F.lit(0)).alias("groups"), F.avg(F.when(of_group, F.col("correct") / F.col("n"))).alias("group_macro"),
        F.avg(F.when(of_group, F.try_divide("correct", "valid"))).alias("group_macro_observed"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    measures = {c: F.col(c) for c in ("n", "valid", "correct", "top_ties", "rounded_valid", "rounded_correct", *[f"{m}_n" for m in METRICS], "groups", "group_macro", "group_macro_observed")}
    measures |= {"accuracy": ratio("correct", "n"), "wilson_low": wilson_low(F.col("correct"), F.col("n")), "wilson_high": wilson_high(F.col("correct"), F.col("n")),
                 "rounded_accuracy": ratio("rounded_correct", "rounded_valid")} | {m: ratio(f"{m}_sum", f"{m}_n") for m in METRICS}
    if "analytic_valid" in sums:
        some = F.col("analytic_planned") > 0
        measures |= {c: F.when(some, F.col(c)) for c in ("analytic_planned", "analytic_valid")} | {k: ratio(f"{k}_sum", "analytic_valid") for k in analytic_values()}
    listed = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("amount")) for k, v in measures.items()])
    return folded.select("suite", "subset", "dimension", "value", F.inline(listed)).filter(F.col("amount").isNotNull())


def suite_report(scored: DataFrame, dims: Sequence[str] = ("family", "primitive")) -> DataFrame:
    """Long format (dimension, value, measures) for the whole suite, every dimension, in one grouping-sets pass."""
    out = scored.groupingSets([[], *[[d] for d in dims]], *dims).agg(*_measures(), F.grouping_id(*dims).alias("_g"))
    full = (1 << len(dims)) - 1
    dimension, value = F.when(F.col("_g") == full, "all"), F.when(F.col("_g") == full, "all")
    for i, d in enumerate(dims):
        bit = full ^ (1 << (len(dims) - 1 - i))
        dimension = dimension.when(F.col("_g") == bit, d)
        value = value.when(F.col("_g") == bit, F.col(d))
    return out.withColumns({"dimension": dimension, "value": value}).drop("_g", *dims)


def held_out_report(scored: DataFrame, train_sources: DataFrame) -> DataFrame:
    """The report over sources absent from training. Sources are few; the anti-join side is their list."""
    return report(scored.join(train_sources.select("source").distinct(), "source", "left_anti"))


def probe_summary(df: DataFrame, size: str = "target", depth: str = "position") -> DataFrame:
    """Correct probes by size, by depth, by both and overall."""
    return df.cube(size, depth).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("correct"),
        F.grouping(size).alias("all_sizes"), F.grouping(depth).alias("all_positions"),
    )


def renormalised_count(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Answers whose probabilities miss one by more than 1e-6 and were therefore renormalised."""
    s = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    off = F.coalesce((F.size(probabilities) > 0) & (F.abs(s - 1) > 1e-6), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("renormalised"))


def accuracy_table(report_df: DataFrame, held_out: DataFrame) -> DataFrame:
    """Per source (with run columns kept): n, correct, accuracy, interval, NLL and whether the source was held out."""
    held = held_out.select(F.col("source").alias("scope"), F.lit(True).alias("_h")).distinct()
    keep = [c for c in ("device", "model") if c in report_df.columns]
    return report_df.filter(F.col("scope") != "overall").join(held, "scope", "left").select(
        F.col("scope").alias("source"), F.coalesce("_h", F.lit(False)).alias("held_out"), *keep, "n", "correct", "accuracy",
        "wilson_low", "wilson_high", "nll",
    )
