"""Comparison of two runs on the same records, parity checks and release gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.buckets import OPTION_BUCKETS, STATE_BUCKETS, bucket_order, option_bucket, state_bucket
from weighbridge.functions.probability import argmax, expected_labels, softmax, total, tvd, wilson_high, wilson_low
from weighbridge.functions.text import canonical_json, let, parse_whole
from weighbridge.operators.ranking import rank_percentile
from weighbridge.operators.readout import Calibration, replay, same_answer
from weighbridge.operators.resampling import poisson_intervals
from weighbridge.operators.scoring import METRICS, answer_distribution

# Bootstrap sizes and gate limits.
RESAMPLES = 10_000
SOURCE_RESAMPLES = 2_000
TABLE_RESAMPLES = 20_000
GATES = {"accuracy_gain": 0.03, "ood_lower_bound": -0.015, "parity_agreement": 0.99, "parity_mean_tvd": 0.01,
         "readout_nll": 0.05, "readout_accuracy": 0.02}


def inventory_check(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids by status: matched, missing, unexpected, duplicate or with another input hash."""
    # Repeated ids collapse in a partial aggregate, however many copies one id has.
    pred = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("input_sha256").alias("_lo"), F.max("input_sha256").alias("_hi"))
    both = records.select("id", "input_sha256", F.lit(1).alias("_r")).join(pred, "id", "full")
    same = F.col("_lo").eqNullSafe(F.col("input_sha256")) & F.col("_hi").eqNullSafe(F.col("input_sha256"))
    status = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_r").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")
        .when(~same, "input differs").otherwise("matched")
    )
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("ids"))


def paired_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per record present in both scored runs, with both outcomes and probabilities. Dimensions come from old."""
    # Length of a string state, or of its canonical JSON when it is structured.
    chars = F.when(parse_whole(F.col("state")).isNull(), F.char_length("state")).otherwise(F.char_length(canonical_json(F.col("state"))))
    dims = [c for c in ("source", "subset", "family", "group", "primitive", "label") if c in old.columns]
    picked = lambda: F.try_element_at("p", F.nullif(F.array_position("labels", F.col("chosen")), F.lit(0)).cast("int"))
    left = old.select(
        "id", *dims, F.size("labels").alias("n_options"), *([chars.alias("state_chars")] if "state" in old.columns else []),
        F.col("correct").alias("old"), F.col("p_gold").alias("old_prob_gold"), F.when(F.col("reason").isNull(), picked()).alias("old_prob_chosen"),
    )
    right = new.select(
        "id", F.col("correct").alias("new"), F.col("p_gold").alias("new_prob_gold"),
        F.when(F.col("reason").isNull(), picked()).alias("new_prob_chosen"),
    )
    return left.join(right, "id")


def _four(n: Column | None = None) -> list[Column]:
    old, new = F.col("old"), F.col("new")
    n = F.count(F.lit(1))
    return [
        n.alias("n"), F.count_if(old).alias("old_correct"), F.count_if(new).alias("new_correct"),
        F.count_if(old & new).alias("both_correct"), F.count_if(old & ~new).alias("old_only"), F.count_if(~old & new).alias("new_only"),
        F.count_if(~old & ~new).alias("both_wrong"), (F.count_if(old) / n).alias("old_accuracy"), (F.count_if(new) / n).alias("new_accuracy"),
        ((F.count_if(new) - F.count_if(old)) / n).alias("difference"),
    ]


def four_way(items: DataFrame) -> DataFrame:
    return items.agg(*_four())


def four_way_by(items: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Four-way counts by every dimension at once, long format, buckets in their declared order."""
    with_buckets = items
    if "options" in dims:
        with_buckets = with_buckets.withColumn("options", option_bucket(F.col("n_options")))
    if "state_length" in dims:
        with_buckets = with_buckets.withColumn("state_length", state_bucket(F.col("state_chars")))
    out = with_buckets.groupingSets([[d] for d in dims], *dims).agg(*_four(), F.grouping_id(*dims).alias("_g"))
    full = (1 << len(dims)) - 1
    dimension, value, place = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for i, d in enumerate(dims):
        here = F.col("_g") == (full ^ (1 << (len(dims) - 1 - i)))
        dimension, value = F.when(here, F.lit(d)).otherwise(dimension), F.when(here, F.col(d)).otherwise(value)
        table = {"options": OPTION_BUCKETS, "state_length": STATE_BUCKETS}.get(d)
        if table:
            place = F.when(here, bucket_order(F.col(d), table)).otherwise(place)
    return out.withColumns({"dimension": dimension, "value": value, "place": place}).drop("_g", *dims)


def _bootstrap(seed: int, interpolate: bool):
    """Percentile interval of (wins - losses)/n under resampling of n rows.

    Row differences are -1, 0 or 1, so a resample of the rows is a multinomial draw of (wins, losses, ties): the
    cost depends on the number of groups, not of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low, high = [], []
            for n, wins, losses, resamples in zip(pdf["n"], pdf["wins"], pdf["losses"], pdf["resamples"]):
                rng = np.random.default_rng([seed, int(n), int(wins), int(losses)])
                draws = rng.multinomial(n, [wins / n, losses / n, (n - wins - losses) / n], size=int(resamples))
                means = np.sort((draws[:, 0] - draws[:, 1]) / n)
                if interpolate:
                    a, b = np.quantile(means, [0.025, 0.975])
                else:
                    a, b = means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]
                low.append(float(a))
                high.append(float(b))
            yield pdf.assign(low=low, high=high)

    return run


def with_interval(counts: DataFrame, resamples: Column | int = RESAMPLES, seed: int = 20260926, interpolate: bool = False) -> DataFrame:
    """Add a bootstrap interval (low, high) to a table of n, wins and losses."""
    r = F.lit(resamples) if isinstance(resamples, int) else resamples
    rows = counts.withColumn("resamples", r.cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", low double, high double"
    return rows.mapInPandas(_bootstrap(seed, interpolate), schema)


def _wins(items: DataFrame, by: Sequence[str]) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("old") & F.col("new")).alias("wins"), F.count_if(F.col("old") & ~F.col("new")).alias("losses"),
    )


def _change(items: DataFrame) -> DataFrame:
    return items.withColumn("_change", F.col("new").cast("int") - F.col("old").cast("int"))


def paired_difference(items: DataFrame, by: str | None = None, resamples: int = RESAMPLES, seed: int = 20260926) -> DataFrame:
    """(by, n, wins, losses, mean, low, high): new-minus-old correctness with its 95% interval from weighted rows."""
    groups = [by] if by else []
    measure = {"change": (F.col("_change"), F.lit(1))}
    ends = poisson_intervals(_change(items), "id", measure, groups, resamples, seed).drop("measure", "n")
    counts = _wins(items, groups)
    return _joined(counts, ends, groups)


def _joined(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """Two tables of one row a group; without groups each has one row."""
    if groups:
        return a.join(b, groups)
    return a.withColumn("_all", F.lit(1)).join(b.withColumn("_all", F.lit(1)), "_all").drop("_all")


def dimension_intervals(items: DataFrame, dims: Sequence[str], resamples: int = RESAMPLES, seed: int = 20260926) -> DataFrame:
    """four_way_by with the interval of the difference for every value of every dimension."""
    place = {"options": option_bucket(F.col("n_options")), "state_length": state_bucket(F.col("state_chars"))} if "state_chars" in items.columns else {"options": option_bucket(F.col("n_options"))}
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), place.get(d, F.col(d)).cast("string").alias("value")) for d in dims])).alias("_d")
    long = _change(items).select("id", "_change", values).select("id", "_change", "_d.*")
    ends = poisson_intervals(long, "id", {"change": (F.col("_change"), F.lit(1))}, ["dimension", "value"], resamples, seed).select("dimension", "value", "low", "high")
    return four_way_by(items, dims).join(ends, ["dimension", "value"])


def paired_table(items: DataFrame, by: str | None = None) -> DataFrame:
    """Two-by-two outcome counts and the accuracy change in percentage points."""
    old, new = F.col("old"), F.col("new")
    n = F.count(F.lit(1))
    return items.groupBy(*([by] if by else [])).agg(
        n.alias("n"), F.count_if(old & new).alias("both_correct"), F.count_if(~old & ~new).alias("both_wrong"),
        F.count_if(~old & new).alias("wins"), F.count_if(old & ~new).alias("losses"),
        (100 * (F.count_if(~old & new) - F.count_if(old & ~new)) / n).alias("delta_pp"),
    )


def paired_table_interval(items: DataFrame, resamples: int = TABLE_RESAMPLES, seed: int = 20260922) -> DataFrame:
    """paired_table of all items with its interval, in percentage points."""
    ends = poisson_intervals(_change(items), "id", {"change": (100 * F.col("_change"), F.lit(1))}, (), resamples, seed, interpolate=True)
    return _joined(paired_table(items), ends.select("low", "high"), [])


def flip_rows(items: DataFrame, records: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Full rows whose correctness differs, with direction and both answers."""
    flips = items.filter(F.col("old") != F.col("new")).select(
        "id", F.when(F.col("old"), "old_only").otherwise("new_only").alias("direction"), "old_prob_gold", "new_prob_gold", "n_options", "state_chars"
    )
    return flips.join(records, "id").join(old.select("id", F.col("answer").alias("old_answer")), "id", "left").join(
        new.select("id", F.col("answer").alias("new_answer")), "id", "left")


def flip_confidence(items: DataFrame) -> DataFrame:
    """n, mean and quartiles (rounded rank) of the probabilities behind flips, per direction and measure."""
    old, new = F.col("old"), F.col("new")
    pairs = lambda direction, *names: [F.struct(F.lit(direction).alias("direction"), F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names]
    measures = F.when(old & ~new, F.array(*pairs("old_only", "new_prob_chosen", "new_prob_gold", "old_prob_gold"))).when(
        ~old & new, F.array(*pairs("new_only", "old_prob_chosen", "old_prob_gold", "new_prob_gold"))
    ).when(old & new, F.array(F.struct(
        F.lit("both_correct").alias("direction"), F.lit("gold_probability_change").alias("measure"),
        (F.col("new_prob_gold") - F.col("old_prob_gold")).alias("value"))))
    long = items.select(F.explode(measures).alias("m")).select("m.*").filter(F.col("value").isNotNull())
    keys = ["direction", "measure"]
    ranks = rank_percentile(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ranks.join(long.groupBy(*keys).agg(F.avg("value").alias("mean")), keys)


def group_consistency(items: DataFrame, by: str = "group") -> DataFrame:
    """Groups of two or more items: how many each run answers entirely correctly."""
    per = items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bool_and("old").alias("o"), F.bool_and("new").alias("w")).filter(F.col("n") >= 2)
    o, w = F.col("o"), F.col("w")
    groups = F.count(F.lit(1))
    return per.agg(
        groups.alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count_if(o).alias("old_all_correct"), F.count_if(w).alias("new_all_correct"),
        (F.count_if(o) / F.nullif(groups, F.lit(0))).alias("old_share"), (F.count_if(w) / F.nullif(groups, F.lit(0))).alias("new_share"),
        F.count_if(o & w).alias("both"), F.count_if(o & ~w).alias("old_only"), F.count_if(w & ~o).alias("new_only"),
    )


def families_beyond(items: DataFrame, margin: float = 0.05, by: str = "family") -> DataFrame:
    """Families whose accuracy moved by more than the margin."""
    per = items.groupBy(by).agg(F.avg(F.col("new").cast("int") - F.col("old").cast("int")).alias("d"))
    return per.agg(F.count_if(F.col("d") > margin).alias("improved"), F.count_if(F.col("d") < -margin).alias("regressed"), F.count(F.lit(1)).alias("total"))


def order_pairs(records: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Per planned pair: validity, answer flip and label-aligned distance of two readings of one choice question."""
    side = lambda df, n: df.select("id", F.col("error").alias(f"_e{n}"), F.col("answer").alias(f"_a{n}"))
    labels = expected_labels(F.col("question"))
    at = lambda a: F.transform(labels, lambda k: F.try_element_at(a["probabilities"], k))
    ok = F.col("_a1").isNotNull() & F.col("_a2").isNotNull() & F.col("_e1").isNull() & F.col("_e2").isNull()
    j = records.join(side(first, 1), "id", "left").join(side(second, 2), "id", "left").withColumn("valid", ok)
    right = lambda n: F.coalesce(F.col(f"_a{n}.choice") == F.col("label"), F.lit(False))
    return j.select(
        "id", "valid", F.size(labels).alias("options"), (ok & (F.col("_a1.choice") != F.col("_a2.choice"))).alias("flip"),
        F.when(ok, tvd(at(F.col("_a1")), at(F.col("_a2")))).alias("tvd"), (ok & right(1)).alias("first_correct"), (ok & right(2)).alias("second_correct"),
    )


def order_flips(pairs: DataFrame) -> DataFrame:
    """Flip rate with interval and distances: all pairs, and by whether one pass could hold the options."""
    size = F.when(F.col("options") <= 52, "at_most_52").otherwise("over_52")
    valid, flips = F.count_if(F.col("valid")), F.count_if(F.col("flip"))
    return pairs.withColumn("size", size).groupingSets([[], ["size"]], "size").agg(
        F.count(F.lit(1)).alias("planned"), valid.alias("valid"), flips.alias("flips"), (flips / F.nullif(valid, F.lit(0))).alias("flip_rate"),
        wilson_low(flips, valid).alias("wilson_low"), wilson_high(flips, valid).alias("wilson_high"),
        F.count_if(F.col("first_correct")).alias("first_correct"), F.count_if(F.col("second_correct")).alias("second_correct"),
        F.avg("tvd").alias("mean_tvd"), F.max("tvd").alias("max_tvd"), F.grouping("size").alias("_g"),
    ).withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise(F.col("size"))).drop("_g", "size")


def _aligned(records: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, n: df.select("id", F.col("error").alias(f"_e{n}"), F.col("answer").alias(f"_a{n}"), F.col("input_sha256").alias(f"_i{n}"), F.col("traces").alias(f"_t{n}"))
    labels = expected_labels(F.col("question"))
    j = records.select("id", "primitive", "question").join(side(a, 1), "id", "left").join(side(b, 2), "id", "left")
    return j.withColumns({f"_p{n}": answer_distribution(F.col("primitive"), F.col(f"_a{n}"), labels)["p"] for n in (1, 2)})


def _told(n: int) -> Column:
    return F.transform(F.col(f"_t{n}"), lambda t: t["prompt_sha256"])


def parity(records: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: agreement and distance of two runs over comparable pairs, pairs that are not comparable, and the gate."""
    j = _aligned(records, a, b)
    problem = (
        F.when(F.col("_i1").isNull() | F.col("_i2").isNull(), "missing prediction")
        .when(F.col("_e1").isNotNull() | F.col("_e2").isNotNull(), "failed prediction")
        .when(F.col("_i1") != F.col("_i2"), "input hash differs")
        .when(~_told(1).eqNullSafe(_told(2)), "prompt hashes differ")
        .when(F.col("_p1").isNull() | F.col("_p2").isNull(), "invalid probabilities")
    )
    ok = problem.isNull()
    agree = F.when(ok, (argmax(F.col("_p1")) == argmax(F.col("_p2"))).cast("double"))
    rows = j.select(problem.alias("problem"), agree.alias("agree"), F.when(ok, tvd(F.col("_p1"), F.col("_p2"))).alias("tvd"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("problem").alias("problems"), F.avg("agree").alias("argmax_agreement"),
        F.avg("tvd").alias("mean_tvd"), F.max("tvd").alias("max_tvd"),
    )
    return out.withColumn("passed", (F.col("problems") == 0) & (F.col("argmax_agreement") >= GATES["parity_agreement"]) & (F.col("mean_tvd") <= GATES["parity_mean_tvd"]))


def cross_run_parity(records: DataFrame, a: DataFrame, b: DataFrame, calibration: Calibration = Calibration(), check_prompts: bool = True) -> DataFrame:
    """Parity of two independently replayed runs; only the last prompt of a composed answer may differ.

    One row: pairs, problems by kind, agreement, distances, the id of the largest distance and how many composed
    answers took another final prompt.
    """
    ra = replay(records, a, calibration, check_prompts=check_prompts).select("id", F.col("reason").alias("_r1"), same_answer(F.col("answer"), F.col("recorded")).alias("_s1"))
    rb = replay(records, b, calibration, check_prompts=check_prompts).select("id", F.col("reason").alias("_r2"), same_answer(F.col("answer"), F.col("recorded")).alias("_s2"))
    j = _aligned(records, a, b).join(ra, "id").join(rb, "id")
    ids = lambda n: F.transform(F.col(f"_t{n}"), lambda t: t["candidate_ids"])
    same = F.zip_with(_told(1), _told(2), lambda x, y: x.eqNullSafe(y))
    static = F.forall(F.slice(same, 1, F.size(same) - 1), lambda s: s) & (F.size(same) > 1)
    problem = (
        F.when(F.col("_r1").isNotNull() | F.col("_r2").isNotNull(), "replay rejected")
        .when(~(F.col("_s1") & F.col("_s2")), "recorded answer differs from replay")
        .when(ids(1) != ids(2), "candidate ids differ")
        .when(~F.forall(same, lambda s: s) & ~static, "static prompts differ")
        .when(F.col("_p1").isNull() | F.col("_p2").isNull(), "invalid probabilities")
    )
    ok = problem.isNull()
    rows = j.select(
        "id", problem.alias("problem"), F.when(ok, (argmax(F.col("_p1")) == argmax(F.col("_p2"))).cast("double")).alias("agree"),
        F.when(ok, tvd(F.col("_p1"), F.col("_p2"))).alias("tvd"), F.when(ok, ~F.element_at(same, -1)).alias("branch"),
    )
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("problem").alias("problems"), F.avg("agree").alias("argmax_agreement"),
        F.count_if(F.col("agree") == 0).alias("argmax_disagreements"), F.avg("tvd").alias("mean_tvd"), F.max("tvd").alias("max_tvd"),
        F.max_by("id", F.struct("tvd", "id")).alias("max_tvd_id"), F.count_if(F.col("branch")).alias("adaptive_final_prompt_differences"),
    )
    return out.withColumn("passed", (F.col("argmax_agreement") >= GATES["parity_agreement"]) & (F.col("mean_tvd") <= GATES["parity_mean_tvd"]))


def logit_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Centred-logit error, distance and agreement of two tables (id, logits)."""
    j = a.select("id", F.col("logits").alias("x")).join(b.select("id", F.col("logits").alias("y")), "id")
    centred = lambda l: let(total(l) / F.size(l), lambda m: F.transform(l, lambda v: v - m))
    squares = total(F.zip_with(centred(F.col("x")), centred(F.col("y")), lambda u, v: (u - v) * (u - v)))
    rows = j.select(squares.alias("s"), F.size("x").alias("k"), tvd(softmax(F.col("x")), softmax(F.col("y"))).alias("t"), (argmax(F.col("x")) == argmax(F.col("y"))).cast("double").alias("agree"))
    return rows.agg(
        F.count(F.lit(1)).alias("prompts"), F.sqrt(F.sum("s") / F.sum("k")).alias("centered_logit_rmse"), F.avg("t").alias("mean_tvd"),
        F.max("t").alias("max_tvd"), F.avg("agree").alias("argmax_agreement"),
    )


CHANGE_METRICS = ("accuracy", *METRICS, "ece")


def metric_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Scope by metric: both values, the change and whether it is worse. Inputs are reports with `ece` joined on.

    denominators_match is false where the runs do not count the same rows; such a comparison is not valid.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"),
                          F.col(f"{m}_n" if m in METRICS else "n").cast("bigint").alias("d")) for m in CHANGE_METRICS]
        return df.select("scope", F.explode(F.array(*parts)).alias("m")).select(
            "scope", "m.metric", F.col("m.v").alias(name), F.col("m.d").alias(f"_{name}"))

    j = long(previous, "previous").join(long(current, "current"), ["scope", "metric"])
    j = j.filter(F.col("previous").isNotNull() & F.col("current").isNotNull()).withColumn("delta", F.col("current") - F.col("previous"))
    worse = F.when(F.col("metric") == "accuracy", F.col("delta") < -1e-12).otherwise(F.col("delta") > 1e-12)
    return j.select("scope", "metric", "previous", "current", "delta", worse.alias("worse"), (F.col("_previous") == F.col("_current")).alias("denominators_match"))


def latency_changes(previous: DataFrame, current: DataFrame, by: str = "group") -> DataFrame:
    """Median and p95 of both runs per group, with absolute and relative change."""
    long = lambda df, n: df.select(by, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in ("median", "p95")])).alias("m")).select(by, "m.stat", F.col("m.v").alias(n))
    j = long(previous, "previous_ms").join(long(current, "current_ms"), [by, "stat"])
    return j.withColumns({
        "delta_ms": F.col("current_ms") - F.col("previous_ms"),
        "delta_percent": 100 * (F.col("current_ms") / F.nullif(F.col("previous_ms"), F.lit(0.0)) - 1),
        "worse": F.col("current_ms") > F.col("previous_ms"),
    })


def release_gates(overall: DataFrame, ood: DataFrame, by_source: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Gate rows (gate, passed, value, detail).

    overall, ood: paired_difference of the test and out-of-distribution rows; by_source: paired_difference per
    source; old, new: one-row overall reports with nll and ece.
    """
    row = lambda gate, passed, value, detail="": [F.lit(gate).alias("gate"), passed.alias("passed"), value.alias("value"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")]
    gain = overall.select(*row("test_accuracy_gain", (F.col("mean") >= GATES["accuracy_gain"]) & (F.col("low") > 0), F.col("mean")))
    tagged = old.select(F.lit("old").alias("run"), "nll", "ece").unionByName(new.select(F.lit("new").alias("run"), "nll", "ece"))
    pick = lambda m, run: F.max(F.when(F.col("run") == run, F.col(m)))
    both = tagged.agg(*[pick(m, r).alias(f"{r}_{m}") for m in ("nll", "ece") for r in ("old", "new")])
    nll = both.select(*row("test_nll_not_worse", F.col("new_nll") <= F.col("old_nll"), F.col("new_nll")))
    ece = both.select(*row("test_ece_not_worse", F.col("new_ece") <= F.col("old_ece"), F.col("new_ece")))
    bound = ood.select(*row("ood_lower_bound", F.col("low") >= GATES["ood_lower_bound"], F.col("low")))
    worse = by_source.filter(F.col("high") < 0).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("s"))
    regressions = worse.select(*row("source_regressions", F.col("n") == 0, F.col("n").cast("double"), F.col("s")))
    return gain.unionByName(nll).unionByName(ece).unionByName(bound).unionByName(regressions)


def readout_gate(given: DataFrame, canonical: DataFrame) -> DataFrame:
    """Whether the sorted-options readout is acceptable next to the given order (one-row reports)."""
    tagged = given.select(F.lit("g").alias("r"), "nll", "accuracy").unionByName(canonical.select(F.lit("c").alias("r"), "nll", "accuracy"))
    pick = lambda m, r: F.max(F.when(F.col("r") == r, F.col(m)))
    both = tagged.agg(pick("nll", "g").alias("input_nll"), pick("nll", "c").alias("canonical_nll"), pick("accuracy", "g").alias("input_accuracy"), pick("accuracy", "c").alias("canonical_accuracy"))
    return both.withColumn("accepted", (F.col("canonical_nll") <= F.col("input_nll") + GATES["readout_nll"]) & (F.col("canonical_accuracy") >= F.col("input_accuracy") - GATES["readout_accuracy"]))


def phase_consistency(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per phase: complete, error-free; and whether the run has one value of each provenance key throughout."""
    counted = rows.groupBy("phase").agg(F.count(F.lit(1)).alias("completed"), F.count("error").alias("errors"))
    phases = expected.join(counted, "phase", "left").select(
        F.lit("phase").alias("check"), F.col("phase").alias("name"),
        ((F.coalesce("completed", F.lit(0)) == F.col("expected")) & (F.coalesce("errors", F.lit(0)) == 0)).alias("passed"),
        F.coalesce("completed", F.lit(0)).alias("value"),
    )
    # Minimum equal to maximum, with no nulls, says "one value" without a distinct aggregate.
    spread = rows.agg(*[F.struct(((F.min(k) == F.max(k)) & (F.count(k) == F.count(F.lit(1)))).alias("one"), F.count(k).alias("n")).alias(k) for k in keys])
    facts = spread.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("s")) for k in keys])).alias("f")).select(
        F.lit("provenance").alias("check"), F.col("f.k").alias("name"), F.col("f.s.one").alias("passed"), F.col("f.s.n").alias("value"))
    return phases.unionByName(facts)


def model_delta(reports: DataFrame, base: str, candidate: str) -> DataFrame:
    """Per scope: candidate minus base in percentage points for accuracy and, where present, flip rate."""
    measures = [m for m in ("accuracy", "flip_rate") if m in reports.columns]
    pick = lambda m, name: F.max(F.when(F.col("model") == name, F.col(m)))
    return reports.groupBy("scope").agg(*[(100 * (pick(m, candidate) - pick(m, base))).alias(f"{m}_delta_pp") for m in measures])
