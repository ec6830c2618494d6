"""Small hand-made records with known scores."""

import math

import pytest
from pyspark.sql import functions as F

from weighbridge.functions.probability import soft_label_map
from weighbridge.operators import comparison as cmp
from weighbridge.operators import scoring as ops

RECORD = "id string, source string, group string, primitive string, question struct<type:string,instructions:string,options:array<struct<key:string,description:string>>>, label string, soft map<string,double>"
PREDICTION = "id string, error string, input_sha256 string, answer struct<choice:string,score:double,noul:double,probabilities:map<string,double>,confidence:double>, latency_ms double"


def rec(i, kind, keys, label, soft=None, source="s", group="g"):
    return (i, source, group, kind, (kind, "?", [(k, None) for k in keys]), label, soft)


def pred(i, choice=None, noul=None, p=None, error=None, latency=1.0):
    return (i, error, "h", (choice, None, noul, p, None), latency)


def score(spark, records, predictions, **kw):
    return ops.score_records(spark.createDataFrame(records, RECORD), spark.createDataFrame(predictions, PREDICTION), **kw)


def test_known_values(spark):
    records = [
        rec("score", "score", ["0", "1"], "1"), rec("tie", "noul", [], "1"), rec("no", "noul", [], "0"), rec("gone", "choice", ["a", "b"], "a"),
        rec("choice", "choice", ["a", "b", "c"], "b", {"a": 1.0, "b": 3.0}),
    ]
    predictions = [
        pred("score", p={"0": 0.25, "1": 0.75}), pred("tie", noul=0.5), pred("no", noul=0.9), pred("choice", choice="b", p={"a": 0.2, "b": 0.5, "c": 0.3}),
    ]
    rows = {r["id"]: r for r in score(spark, records, predictions).collect()}
    assert rows["score"]["rps"] == pytest.approx(0.0625)
    assert rows["score"]["score_mae"] == pytest.approx(0.25)
    assert rows["tie"]["correct"] and rows["tie"]["brier_binary"] == pytest.approx(0.25)
    assert not rows["no"]["correct"]
    assert rows["gone"]["reason"] == "missing or failed prediction"
    assert rows["choice"]["nll"] == pytest.approx(-math.log(0.5))
    assert rows["choice"]["brier_multiclass"] == pytest.approx(0.04 + 0.25 + 0.09)
    assert rows["choice"]["human_tvd"] == pytest.approx(0.5 * (0.05 + 0.25 + 0.3))


def test_failures_stay_in_the_denominator(spark):
    out = ops.summarize(score(spark, [rec("1", "noul", [], "1"), rec("2", "noul", [], "1")], [pred("1", noul=0.8)])).first()
    assert (out["n"], out["valid"], out["accuracy"], out["nll_n"]) == (2, 1, 0.5, 1)


@pytest.mark.parametrize("prediction, reason", [
    (pred("1", choice="a", p={"a": 0.6}), "invalid probability keys or values"),
    (pred("1", choice="a", p={"a": 0.6, "b": 0.4, "c": 0.0}), "invalid probability keys or values"),
    (pred("1", choice="a", p={"a": 1.2, "b": -0.2}), "invalid probability keys or values"),
    (pred("1", choice="a", p={"a": 0.6, "b": 0.3}), "probabilities do not sum to one"),
    (pred("1", choice="b", p={"a": 0.6, "b": 0.4}), "choice does not have maximal probability"),
    (pred("1", choice="a", p={"a": 0.6, "b": 0.4}, error="late"), "missing or failed prediction"),
    (pred("1", choice="a", p={"a": float("nan"), "b": 0.4}), "invalid probability keys or values"),
])
def test_failure_reasons(spark, prediction, reason):
    assert score(spark, [rec("1", "choice", ["a", "b"], "a")], [prediction]).first()["reason"] == reason


def test_rounding_may_be_allowed(spark):
    row = score(spark, [rec("1", "choice", ["a", "b"], "a")], [pred("1", choice="a", p={"a": 0.6, "b": 0.3})], allow_rounding=True).first()
    assert row["reason"] is None and row["p_gold"] == pytest.approx(2 / 3)


def test_bad_votes_and_labels(spark):
    good = pred("1", choice="a", p={"a": 0.6, "b": 0.4})
    assert score(spark, [rec("1", "choice", ["a", "b"], "a", {"z": 1.0})], [good]).first()["reason"] == "unexpected human-label key"
    assert score(spark, [rec("1", "choice", ["a", "b"], "a", {"a": 0.0})], [good]).first()["reason"] == "invalid human distribution"
    assert score(spark, [rec("1", "choice", ["a", "b"], "z")], [good]).first()["reason"] == "gold label is not an option"


def test_group_macro(spark):
    records = [rec("1", "noul", [], "1", group="a"), rec("2", "noul", [], "1", group="a"), rec("3", "noul", [], "1", group="b")]
    out = ops.group_macro(score(spark, records, [pred("1", noul=0.9)])).first()
    assert (out["groups"], out["macro"], out["macro_observed"]) == (2, 0.25, 1.0)


def test_reliability_keeps_empty_bins(spark):
    s = score(spark, [rec("1", "noul", [], "1")], [pred("1", noul=1.0)])
    bins = ops.reliability_bins(s).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [0] * 9 + [1]
    assert ops.ece(s).first()["ece"] == pytest.approx(0.0)


def test_bootstrap_matches_row_resampling(spark):
    import random

    old = [1] * 60 + [0] * 40
    new = [1] * 50 + [0] * 10 + [1] * 30 + [0] * 10
    items = spark.createDataFrame([(str(i), bool(a), bool(b)) for i, (a, b) in enumerate(zip(old, new))], "id string, old boolean, new boolean")
    got = cmp.paired_difference(items).first()
    rng, d = random.Random(0), [b - a for a, b in zip(old, new)]
    means = sorted(sum(rng.choices(d, k=100)) / 100 for _ in range(4000))
    assert got["mean"] == pytest.approx(sum(d) / 100)
    assert got["low"] == pytest.approx(means[100], abs=0.02) and got["high"] == pytest.approx(means[3899], abs=0.02)


def test_interval_needs_no_rows_per_group(spark):
    counts = spark.createDataFrame([(10**12, 4 * 10**11, 3 * 10**11)], "n long, wins long, losses long")
    row = cmp.with_interval(counts, 1000).first()
    assert row["low"] == pytest.approx(0.1, abs=1e-4) and row["high"] == pytest.approx(0.1, abs=1e-4)


def test_single_item_groups_do_not_count(spark):
    items = spark.createDataFrame([("1", "a", True, True), ("2", "a", True, False), ("3", "b", True, True)], "id string, group string, old boolean, new boolean")
    row = cmp.group_consistency(items).first()
    assert (row["groups"], row["items"], row["old_all_correct"], row["new_all_correct"]) == (1, 2, 1, 0)


def test_family_margin(spark):
    rows = [("a", True, False)] * 2 + [("b", False, True)] * 2 + [("c", True, True)] * 3
    row = cmp.families_beyond(spark.createDataFrame(rows, "family string, old boolean, new boolean")).first()
    assert tuple(row) == (1, 1, 3)


def test_changed_denominators_are_flagged(spark):
    a = ops.report(score(spark, [rec("1", "noul", [], "1"), rec("2", "noul", [], "1")], [pred("1", noul=0.9)])).withColumn("ece", F.lit(0.1))
    b = ops.report(score(spark, [rec("1", "noul", [], "1"), rec("2", "noul", [], "1")], [pred("1", noul=0.8), pred("2", noul=0.8)])).withColumn("ece", F.lit(0.1))
    out = {r["metric"]: r for r in cmp.metric_changes(a, b).filter("scope = 'overall'").collect()}
    assert out["accuracy"]["denominators_match"] and not out["accuracy"]["worse"]
    assert not out["nll"]["denominators_match"] and out["nll"]["worse"]


def test_whole_suite_report(spark):
    records = [
        rec("a", "noul", [], "1", group="g"), rec("b", "noul", [], "1", group="g"), rec("c", "choice", ["a", "b"], "a", group="h"),
        rec("d", "score", ["0", "1"], "1", group=None),
    ]
    predictions = [pred("a", noul=0.5), pred("b", error="no"), pred("c", choice="a", p={"a": 0.5, "b": 0.5}), pred("d", p={"0": 0.25, "1": 0.75})]
    s = score(spark, records, predictions).withColumns({
        "suite": F.lit("x"), "subset": F.when(F.col("id") == "d", None).otherwise("s"), "family": F.lit(None).cast("string"),
        "analytic": F.when(F.col("id") == "c", F.array(F.lit(0.25), F.lit(0.75)))})
    out = ops.whole_suite_report(s, ("family", "primitive"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # records meet predictions once, and nothing is read a second time
    got = {(r["subset"], r["dimension"], r["value"], r["measure"]): r["amount"] for r in out.collect()}
    at = lambda measure, subset="all", dimension="all", value="all": got.get((subset, dimension, value, measure))
    assert (at("n"), at("valid"), at("correct"), at("top_ties"), at("groups")) == (4, 3, 3, 2, 3)
    assert at("group_macro") == pytest.approx((0.5 + 1 + 1) / 3) and at("group_macro_observed") == 1
    assert at("n", "null") == 1 and at("n", "s") == 3 and at("rounded_correct", "null") == 1
    assert at("n", "all", "family", "null") == 4 and at("correct", "s", "primitive", "noul") == 1
    assert at("analytic_planned") == 1 and at("expected_accuracy") == 0.25 and at("tvd", "s", "primitive", "choice") == pytest.approx(0.25)
    assert at("analytic_planned", "null") is None and at("groups", "all", "family", "null") is None
    assert ops.whole_suite_report(s.limit(0)).count() == 0


def test_votes_as_number_list_or_map(spark):
    rows = [("p", 0.25, None, None), ("l", None, [1.0, 3.0], None), ("m", None, None, {"a": 2.0}), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "id string, number double, levels array<double>, options map<string,double>")
    got = {r["id"]: r["soft"] for r in df.select("id", soft_label_map(F.col("number"), F.col("levels"), F.col("options")).alias("soft")).collect()}
    assert got == {"p": {"0": 0.75, "1": 0.25}, "l": {"0": 1.0, "1": 3.0}, "m": {"a": 2.0}, "none": None}


def test_sums_are_bound_once(spark):
    """A sum inside a lambda is added up again for every value."""
    from weighbridge.functions.probability import human_distribution, valid_probabilities

    df = spark.createDataFrame([(["a", "b"], [0.5, 0.5], {"a": 1.0})], "labels array<string>, p array<double>, soft map<string,double>")
    made = df.select(valid_probabilities(F.col("p"), F.lit(False)).alias("v"), human_distribution(F.col("soft"), F.col("labels")).alias("h"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2
    assert made.first() == ((([0.5, 0.5], None)), ([1.0, 0.0], None))


def test_an_answer_may_be_read_for_scoring_only(spark):
    from weighbridge.operators.readout import SCORED, answers

    df = spark.createDataFrame([("i", ("choice", "?", [("a", None), ("b", None)]), [([1.0, 3.0],)])], "id string, question struct<type:string,instructions:string,options:array<struct<key:string,description:string>>>, traces array<struct<logits:array<double>>>")
    few, all_ = answers(df, fields=SCORED).first()["answer"], answers(df).first()["answer"]
    assert few.asDict() == {f: all_[f] for f in SCORED}
