"""Queries: scoring of one run and comparison of two, over the decisions made from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.probability import total
from weighbridge.operators import comparison as cmp
from weighbridge.operators import resampling
from weighbridge.operators import scoring as ops
from weighbridge.operators.prompts import reverse_options
from weighbridge.operators.readout import Calibration, answers
from weighbridge.plans.fixtures import decisions, r6, run, table, traces
from weighbridge.plans.registry import query, view
from weighbridge.session import cut, scratch
from weighbridge.sources import records as src

M = ops.METRICS


def scored(spark, d, which: str) -> DataFrame:
    items = decisions(spark, d)
    return ops.score_records(items.drop("e", "k"), run(items, which))


NARROW = ("id", "source", "subset", "family", "group", "primitive", "label", "labels", "p", "chosen", "reason", "correct", "p_gold", "top_probability", *M)


def kept(spark, d, which: str) -> DataFrame:
    """Scored rows without their texts, written once: several reports read them."""
    return cut(scored(spark, d, which).select(*NARROW))


def rounded(df: DataFrame) -> DataFrame:
    """All floating-point columns at six decimals."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


_Z = 1.959963984540054


def wilson_sql(c: str, n: str, side: str) -> str:
    z2 = _Z * _Z
    return (f"(({c} / {n} + {z2} / (2.0 * {n})) {side} {_Z} * sqrt(({c} / {n}) * (1 - {c} / {n}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n})")


_MEASURES = (
    "count(*) AS n, count(*) FILTER (valid) AS valid, sum(correct)::BIGINT AS correct, round(sum(correct) / count(*), 6) AS accuracy, "
    f"round({wilson_sql('sum(correct)', 'count(*)', '-')}, 6) AS wilson_low, round({wilson_sql('sum(correct)', 'count(*)', '+')}, 6) AS wilson_high, "
    + ", ".join(f"round(avg({m}) FILTER (valid), 6) AS {m}, count({m}) FILTER (valid) AS {m}_n" for m in M)
)


@query("e01_score_records", """
SELECT id, reason, correct = 1 AS correct, CASE WHEN valid THEN chosen END AS chosen, """
       + ", ".join(f"round(CASE WHEN valid THEN {m} END, 6) AS {m}" for m in ("top",) + M) + " FROM fx_scored_old")
def _e01(spark, d):
    s = scored(spark, d, "old")
    chosen = F.when(F.col("reason").isNull(), F.col("chosen")).alias("chosen")
    return rounded(s.select("id", "reason", "correct", chosen, F.col("top_probability").alias("top"), *M))


@query("e02_summarize", f"SELECT {_MEASURES} FROM fx_scored_old")
def _e02(spark, d):
    return rounded(ops.summarize(scored(spark, d, "old")))


@query("e03_failures", "SELECT id, reason FROM fx_scored_old WHERE NOT valid")
def _e03(spark, d):
    return ops.failures(scored(spark, d, "old"))


@query("e04_report", f"SELECT coalesce(source, 'overall') AS scope, {_MEASURES} FROM fx_scored_old GROUP BY GROUPING SETS ((source), ())")
def _e04(spark, d):
    return rounded(ops.report(scored(spark, d, "old")))


_BINS = """
SELECT g.source, b.bin, count(s.id) AS n, avg(s.correct) AS accuracy, avg(s.top) AS probability
FROM (SELECT DISTINCT source FROM fx_decisions) g, unnest(range(0, 10)) AS b(bin)
LEFT JOIN fx_scored_old s ON s.source = g.source AND s.valid AND least(9, floor(s.top * 10)) = b.bin GROUP BY g.source, b.bin"""


@query("e05_reliability_bins", f"""
SELECT source, bin, n, round(accuracy, 6) AS accuracy, round(probability, 6) AS probability, round(bin / 10, 6) AS lower, round((bin + 1) / 10, 6) AS upper FROM ({_BINS})""")
def _e05(spark, d):
    return rounded(ops.reliability_bins(scored(spark, d, "old"), "source").withColumn("bin", F.col("bin").cast("bigint")))


@query("e06_ece", f"SELECT source, round(sum(n * abs(accuracy - probability)) / sum(n), 6) AS ece FROM ({_BINS}) GROUP BY source")
def _e06(spark, d):
    return rounded(ops.ece(scored(spark, d, "old"), "source"))


_RANK = "max(v) FILTER (rn = round_even((n - 1) * {f}, 0)) AS {name}"


def percentile_sql(source: str, by: str, fractions: dict[str, float]) -> str:
    """source yields v and the group columns."""
    picks = ", ".join(_RANK.format(f=f, name=name) for name, f in fractions.items())
    return (f"SELECT {by}, max(n) AS n, {picks} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS rn, "
            f"count(*) OVER (PARTITION BY {by}) AS n FROM ({source})) GROUP BY {by}")


_LATENCY = {"median": 0.5, "p95": 0.95}


@query("e07_latency_stats", percentile_sql('SELECT event_type AS "group", value AS v FROM events WHERE value IS NOT NULL', '"group"', _LATENCY))
def _e07(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("group"), F.col("value").alias("latency_ms"))
    return ops.latency_stats(events, ["group"])


@query("e07_latency_overall", "SELECT n, median, p95 FROM (" + percentile_sql("SELECT 0 AS g, l_extendedprice AS v FROM lineitem", "g", _LATENCY) + ")")
def _e07_all(spark, d):
    return ops.latency_stats(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("latency_ms")))


@query("e07_value_summary", """
SELECT event_type AS "group", count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS minimum, max(value) AS maximum
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def _e07_values(spark, d):
    events = table(spark, d, "events").withColumn("group", F.col("event_type"))
    return rounded(ops.value_summary(events, ["group"], "value").withColumn("total", F.round("total", 4)))


@query("e08_grouped", f"SELECT family, {_MEASURES} FROM fx_scored_old GROUP BY family")
def _e08(spark, d):
    return rounded(ops.summarize_by(scored(spark, d, "old"), "family"))


@query("e09_group_macro", """
SELECT count(*) AS groups, round(avg(a), 6) AS macro, round(avg(o), 6) AS macro_observed FROM (
  SELECT avg(correct) AS a, sum(correct) / nullif(count(*) FILTER (valid), 0) AS o FROM fx_scored_old GROUP BY "group")""")
def _e09(spark, d):
    return rounded(ops.group_macro(scored(spark, d, "old")))


@query("e10_rounded_ev", """
SELECT count(*) AS valid, count(*) FILTER (floor(ev + 0.5) = label::INT) AS correct, round(avg((floor(ev + 0.5) = label::INT)::INT), 6) AS accuracy
FROM fx_scored_old WHERE valid AND primitive = 'score'""")
def _e10(spark, d):
    return rounded(ops.rounded_ev(scored(spark, d, "old")))


# Quarter logits make exact ties common: the same numbers in both engines, since equal logits give equal terms.
view("fx_coarse", "SELECT d.vec_id, d.id, u.pos, floor(2 * d.embedding[u.pos]::DOUBLE) AS logit FROM fx_decisions d, unnest(range(1, d.k + 1)) AS u(pos)")


@query("e11_top_ties", "SELECT id FROM (SELECT id, logit, max(logit) OVER (PARTITION BY id) AS top FROM fx_coarse) WHERE logit = top GROUP BY id HAVING count(*) > 1")
def _e11(spark, d):
    items = decisions(spark, d).withColumn("e", F.transform("e", lambda x: F.floor(2 * x).cast("double") / 8))
    preds = answers(traces(items, 0), Calibration()).select("id", F.lit(None).cast("string").alias("error"), "answer", F.lit(1.0).alias("latency_ms"))
    return ops.top_ties(ops.score_records(items.drop("e", "k"), preds))


view("fx_analytic", """
SELECT s.id, s.vec_id % 2 = 0 AS deterministic, s.valid, sum(h.h) FILTER (h.key = s.chosen) AS expected_accuracy, max(h.h) AS bayes_accuracy_ceiling,
  -sum(h.h * ln(greatest(p.p, 1e-12))) AS cross_entropy, -sum(h.h * ln(greatest(p.p, 1e-12))) + sum(h.h * ln(h.h)) AS kl_divergence,
  0.5 * sum(abs(p.p - h.h)) AS tvd, sum((p.p - h.h) ** 2) AS squared_distribution_error, sum(p.p ** 2 - 2 * p.p * h.h + h.h) AS expected_brier
FROM fx_scored_new s JOIN fx_p_new p ON p.vec_id = s.vec_id JOIN fx_human h ON h.vec_id = s.vec_id AND h.key = p.key
GROUP BY ALL""")
_ANALYTIC = ("expected_accuracy", "bayes_accuracy_ceiling", "cross_entropy", "kl_divergence", "tvd", "squared_distribution_error", "expected_brier")


def with_analytic(items: DataFrame) -> DataFrame:
    """A known answer distribution for every decision."""
    votes = F.transform(F.slice("e", F.lit(21), F.col("k")), lambda x: F.abs(x))
    return items.withColumn("_v", votes).withColumn("analytic", F.transform("_v", lambda x: x / total(F.col("_v")))).drop("_v")


@query("e12_analytic_metrics", "SELECT coalesce(deterministic::VARCHAR, 'all') AS scope, count(*) AS planned, count(*) FILTER (valid) AS valid, "
       + ", ".join(f"round(avg({c}) FILTER (valid), 6) AS {c}" for c in _ANALYTIC) + " FROM fx_analytic GROUP BY GROUPING SETS ((deterministic), ())")
def _e12(spark, d):
    items = with_analytic(decisions(spark, d)).withColumn("deterministic", F.col("vec_id") % 2 == 0)
    return rounded(ops.analytic_metrics(ops.score_records(items.drop("e", "k"), run(items, "new"))))


@query("e13_suite_report", f"""
SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(primitive) = 0 THEN 'primitive' WHEN grouping(subset) = 0 THEN 'subset' ELSE 'all' END AS dimension,
  coalesce(family, primitive, subset, 'all') AS value, {_MEASURES} FROM fx_scored_old GROUP BY GROUPING SETS ((family), (primitive), (subset), ())""")
def _e13(spark, d):
    return rounded(ops.suite_report(scored(spark, d, "old"), ("family", "primitive", "subset")))


_SUITE_DIMS = ("family", "primitive", "deterministic")
_SCOPES = ", ".join(f"({', '.join([*base, *more])})" for base in (("suite",), ("suite", "subset")) for more in ((), *[(x,) for x in _SUITE_DIMS]))
_DOUBLES = ("count(*)::DOUBLE AS n, (count(*) FILTER (valid))::DOUBLE AS valid, sum(correct)::DOUBLE AS correct, sum(correct)::DOUBLE / count(*) AS accuracy, "
            f"{wilson_sql('sum(correct)', 'count(*)', '-')} AS wilson_low, {wilson_sql('sum(correct)', 'count(*)', '+')} AS wilson_high, "
            + ", ".join(f"avg({m}) FILTER (valid) AS {m}, (count({m}) FILTER (valid))::DOUBLE AS {m}_n" for m in M)
            + ", (count(*) FILTER (valid AND tied))::DOUBLE AS top_ties, (count(*) FILTER (valid AND primitive = 'score'))::DOUBLE AS rounded_valid, "
            "(count(*) FILTER (valid AND primitive = 'score' AND floor(ev + 0.5) = try_cast(label AS INT)))::DOUBLE AS rounded_correct, "
            "avg((floor(ev + 0.5) = try_cast(label AS INT))::INT) FILTER (valid AND primitive = 'score') AS rounded_accuracy, "
            "nullif(count(a_id), 0)::DOUBLE AS analytic_planned, CASE WHEN count(a_id) > 0 THEN (count(a_id) FILTER (valid))::DOUBLE END AS analytic_valid, "
            + ", ".join(f"avg({c}) FILTER (valid) AS {c}" for c in _ANALYTIC))


@query("e13_whole_suite", f"""
WITH s AS (
  SELECT n.*, 't' || ((n.vec_id // 12) % 2) AS suite, 'g' || (n.vec_id // 12) AS grp, n.vec_id % 7 < 4 AS deterministic, a.id AS a_id, {", ".join("a." + c for c in _ANALYTIC)},
    n.vec_id IN (SELECT vec_id FROM (SELECT vec_id, logit, max(logit) OVER (PARTITION BY vec_id) AS top FROM fx_logits_new) WHERE logit = top GROUP BY vec_id HAVING count(*) > 1) AS tied
  FROM fx_scored_new n LEFT JOIN fx_analytic a ON a.id = n.id AND (n.vec_id // 12) % 2 = 0),
m AS (
  SELECT suite, coalesce(subset, 'all') AS subset, CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(primitive) = 0 THEN 'primitive' WHEN grouping(deterministic) = 0 THEN 'deterministic' ELSE 'all' END AS dimension,
    coalesce(family, primitive, deterministic::VARCHAR, 'all') AS value, {_DOUBLES} FROM s GROUP BY GROUPING SETS ({_SCOPES})),
g AS (
  SELECT suite, coalesce(subset, 'all') AS subset, 'all' AS dimension, 'all' AS value, count(*)::DOUBLE AS groups, avg(a) AS group_macro, avg(o) AS group_macro_observed FROM (
    SELECT suite, subset, avg(correct) AS a, sum(correct) / nullif(count(*) FILTER (valid), 0) AS o FROM s GROUP BY GROUPING SETS ((suite, grp), (suite, subset, grp))) GROUP BY ALL)
SELECT suite, subset, dimension, value, measure, round(amount, 6) AS amount FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (suite, subset, dimension, value)) INTO NAME measure VALUE amount)
UNION ALL SELECT suite, subset, dimension, value, measure, round(amount, 6) FROM (UNPIVOT g ON COLUMNS(* EXCLUDE (suite, subset, dimension, value)) INTO NAME measure VALUE amount)""")
def _e13_whole(spark, d):
    block = F.floor(F.col("vec_id") / 12)
    items = with_analytic(decisions(spark, d)).withColumns({
        "suite": F.concat(F.lit("t"), (block % 2).cast("string")), "group": F.concat(F.lit("g"), block.cast("string")), "deterministic": F.col("vec_id") % 7 < 4})
    items = items.withColumn("analytic", F.when(F.col("suite") == "t0", F.col("analytic")))
    return rounded(ops.whole_suite_report(ops.score_records(items.drop("e", "k"), run(items, "new")), _SUITE_DIMS))


@query("e14_held_out_report", f"SELECT coalesce(source, 'overall') AS scope, {_MEASURES} FROM fx_scored_new WHERE source NOT IN ('s0', 's1', 's2') GROUP BY GROUPING SETS ((source), ())")
def _e14(spark, d):
    s = scored(spark, d, "new")
    train = s.select("source").distinct().filter(F.col("source").isin("s0", "s1", "s2"))
    return rounded(ops.held_out_report(s, train))


@query("e16_renormalised_count", """
SELECT count(*) AS n, count(*) FILTER (vec_id % 43 = 0 AND primitive <> 'noul') AS renormalised FROM fx_decisions WHERE vec_id % 53 <> 0""")
def _e16(spark, d):
    return ops.renormalised_count(run(decisions(spark, d), "old").select(F.col("answer.probabilities").alias("probabilities")))


@query("s06_accuracy_csv", f"""
SELECT source, source IN ('s3', 's4') AS held_out, count(*) AS n, sum(correct)::BIGINT AS correct, round(sum(correct) / count(*), 6) AS accuracy,
 round({wilson_sql('sum(correct)', 'count(*)', '-')}, 6) AS wilson_low, round({wilson_sql('sum(correct)', 'count(*)', '+')}, 6) AS wilson_high, round(avg(nll) FILTER (valid), 6) AS nll
FROM fx_scored_new GROUP BY source""")
def _s06(spark, d):
    s = scored(spark, d, "new")
    table_ = rounded(ops.accuracy_table(ops.report(s), s.select("source").filter(F.col("source").isin("s3", "s4"))))
    path = scratch(spark, "accuracy") + "/accuracy.csv"
    src.write_csv(table_, path)
    return src.read_csv(spark, path, table_.schema)


# --- two runs ------------------------------------------------------------------------------------------------

def items(spark, d) -> DataFrame:
    return cmp.paired_items(scored(spark, d, "old"), scored(spark, d, "new"))


def kept_items(spark, d) -> DataFrame:
    return cut(items(spark, d))


view("fx_items", """
SELECT o.id, o.source, o.subset, o.family, o."group", o.primitive, o.k AS n_options, length(d.state) AS state_chars, o.correct AS o, n.correct AS w,
  CASE WHEN o.valid THEN o.p_gold END AS old_prob_gold, CASE WHEN n.valid THEN n.p_gold END AS new_prob_gold,
  CASE WHEN o.valid THEN o.p_chosen END AS old_prob_chosen, CASE WHEN n.valid THEN n.p_chosen END AS new_prob_chosen
FROM (SELECT s.*, (SELECT max(p.p) FROM fx_p_old p WHERE p.vec_id = s.vec_id AND p.key = s.chosen) AS p_chosen FROM fx_scored_old s) o
JOIN (SELECT s.*, (SELECT max(p.p) FROM fx_p_new p WHERE p.vec_id = s.vec_id AND p.key = s.chosen) AS p_chosen FROM fx_scored_new s) n ON n.id = o.id
JOIN fx_decisions d ON d.id = o.id""")
_FOUR = ("count(*) AS n, sum(o)::BIGINT AS old_correct, sum(w)::BIGINT AS new_correct, sum(o * w)::BIGINT AS both_correct, sum(o * (1 - w))::BIGINT AS old_only, "
         "sum(w * (1 - o))::BIGINT AS new_only, sum((1 - o) * (1 - w))::BIGINT AS both_wrong, round(avg(o), 6) AS old_accuracy, round(avg(w), 6) AS new_accuracy, round(avg(w - o), 6) AS difference")


@query("e17_inventory_check", """
SELECT status, count(*) AS ids FROM (
  SELECT CASE WHEN vec_id % 53 = 0 THEN 'missing' WHEN vec_id % 17 = 0 THEN 'duplicate' WHEN vec_id % 19 = 0 THEN 'input differs' ELSE 'matched' END AS status FROM embeddings
  UNION ALL SELECT 'unexpected' FROM embeddings WHERE vec_id % 23 = 0 AND vec_id % 53 <> 0) GROUP BY status""")
def _e17(spark, d):
    recs = decisions(spark, d).select("vec_id", "id", "input_sha256")
    v = F.col("vec_id")
    there = recs.filter(v % 53 != 0)
    changed = there.withColumn("input_sha256", F.when(v % 19 == 0, F.lit("other")).otherwise(F.col("input_sha256")))
    preds = changed.unionByName(changed.filter(v % 17 == 0)).unionByName(there.filter(v % 23 == 0).withColumn("id", F.concat("id", F.lit("/x"))))
    return cmp.inventory_check(recs, preds)


_CHANGE = "SELECT {by}id AS key, w - o AS top, 1 AS bottom FROM fx_items"
_PAIRED = "count(*) AS n, sum(w * (1 - o))::BIGINT AS wins, sum(o * (1 - w))::BIGINT AS losses, avg(w - o) AS mean"


def paired_sql(resamples: int, source_resamples: int) -> str:
    """Paired differences with their intervals, overall and by source."""
    overall = resampling.intervals_sql(_CHANGE.format(by=""), "", resamples)
    by_source = resampling.intervals_sql(_CHANGE.format(by="source, "), "source", source_resamples)
    return (f"SELECT 'overall' AS source, c.*, i.* FROM (SELECT {_PAIRED} FROM fx_items) c, ({overall}) i "
            f"UNION ALL SELECT c.*, i.low, i.high FROM (SELECT source, {_PAIRED} FROM fx_items GROUP BY source) c JOIN ({by_source}) i ON i.source = c.source")


view("fx_paired", paired_sql(cmp.RESAMPLES, cmp.SOURCE_RESAMPLES))


@query("e18_paired_difference", "SELECT source, n, wins, losses, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM fx_paired")
def _e18(spark, d):
    pairs = kept_items(spark, d)
    overall = cmp.paired_difference(pairs).withColumn("source", F.lit("overall"))
    return rounded(overall.unionByName(cmp.paired_difference(pairs, "source", cmp.SOURCE_RESAMPLES)))


@query("e18_paired_means", "SELECT source, count(*) AS n, sum(w * (1 - o))::BIGINT AS wins, sum(o * (1 - w))::BIGINT AS losses, round(avg(w - o), 6) AS mean FROM fx_items GROUP BY source")
def _e18_means(spark, d):
    return rounded(cmp.paired_difference(items(spark, d), "source", resamples=4).select("source", "n", "wins", "losses", "mean"))


@query("e19_paired_table", """
SELECT source, count(*) AS n, sum(o * w)::BIGINT AS both_correct, sum((1 - o) * (1 - w))::BIGINT AS both_wrong, sum(w * (1 - o))::BIGINT AS wins, sum(o * (1 - w))::BIGINT AS losses,
  round(100 * avg(w - o), 6) AS delta_pp FROM fx_items GROUP BY source""")
def _e19(spark, d):
    return rounded(cmp.paired_table(items(spark, d), "source"))


@query("e19_paired_interval", f"""
SELECT c.*, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT count(*) AS n, sum(o * w)::BIGINT AS both_correct, sum((1 - o) * (1 - w))::BIGINT AS both_wrong, sum(w * (1 - o))::BIGINT AS wins, sum(o * (1 - w))::BIGINT AS losses,
  round(100 * avg(w - o), 6) AS delta_pp FROM fx_items) c, ({resampling.intervals_sql("SELECT id AS key, 100 * (w - o) AS top, 1 AS bottom FROM fx_items", "", cmp.TABLE_RESAMPLES, 20260922, True)}) i""")
def _e19_interval(spark, d):
    return rounded(cmp.paired_table_interval(kept_items(spark, d)))


@query("e20_four_way", f"SELECT {_FOUR} FROM fx_items")
def _e20(spark, d):
    return rounded(cmp.four_way(items(spark, d)))


_OPTION = "CASE WHEN n_options < 3 THEN '2' WHEN n_options < 5 THEN '3-4' WHEN n_options < 9 THEN '5-8' WHEN n_options < 25 THEN '9-24' WHEN n_options < 53 THEN '25-52' ELSE '>52' END"
_LENGTH = "CASE WHEN state_chars < 500 THEN '<500' WHEN state_chars < 2000 THEN '500-2k' WHEN state_chars < 8000 THEN '2k-8k' ELSE '>8k' END"
_PLACE = "coalesce(list_position(['2', '3-4', '5-8', '9-24', '25-52', '>52'], value), list_position(['<500', '500-2k', '2k-8k', '>8k'], value), 1) - 1"
_DIMS = {"primitive": "primitive", "family": "family", "subset": "subset", "options": _OPTION, "state_length": _LENGTH}


@query("e21_four_way_by", f"SELECT *, ({_PLACE})::INT AS place FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, {_FOUR} FROM fx_items GROUP BY 2" for k, v in _DIMS.items()) + ")")
def _e21(spark, d):
    return rounded(cmp.four_way_by(items(spark, d), list(_DIMS)))


_THREE = ("primitive", "family", "options")
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS dimension, {_DIMS[k]} AS value, id AS key, w - o AS top, 1 AS bottom FROM fx_items" for k in _THREE)


@query("e21_four_way_intervals", f"SELECT c.*, ({_PLACE.replace('value', 'c.value')})::INT AS place, round(low, 6) AS low, round(high, 6) AS high FROM ("
       + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {_DIMS[k]} AS value, {_FOUR} FROM fx_items GROUP BY 2" for k in _THREE)
       + f") c JOIN ({resampling.intervals_sql(_LONG, 'dimension, value', cmp.SOURCE_RESAMPLES)}) i ON i.dimension = c.dimension AND i.value = c.value")
def _e21_intervals(spark, d):
    return rounded(cmp.dimension_intervals(kept_items(spark, d), _THREE, cmp.SOURCE_RESAMPLES))


# --- bootstrap intervals of any metric ------------------------------------------------------------------------

_DRAWS = 1000
_BOTH = ("SELECT o.id, o.source, o.family, o.\"group\", CASE WHEN o.valid AND n.valid THEN n.nll - o.nll END AS nll, CASE WHEN o.valid AND n.valid THEN n.brier_multiclass - o.brier_multiclass END AS brier "
         "FROM fx_scored_old o JOIN fx_scored_new n ON n.id = o.id")
view("fx_changes", f"SELECT id, source, family, \"group\" AS grp, u.measure, u.x FROM ({_BOTH}), unnest([{{'measure': 'nll', 'x': nll}}, {{'measure': 'brier', 'x': brier}}]) AS t(u)")


def metric_changes_rows(spark, d) -> DataFrame:
    """New minus old loss of every record valid in both runs, with its dimensions."""
    side = lambda which, *dims: scored(spark, d, which).select("id", *dims, *[F.when(F.col("reason").isNull(), F.col(m)).alias(f"{which}_{m}") for m in ("nll", "brier_multiclass")])
    both = side("old", "source", "family", "group").join(side("new"), "id")
    change = lambda m, name: (F.col(f"new_{m}") - F.col(f"old_{m}")).alias(name)
    return cut(both.select("id", "source", "family", "group", change("nll", "nll"), change("brier_multiclass", "brier")))


@query("b02_poisson_intervals", f"""
SELECT c.source, c.measure, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT source, measure, count(x) AS n, avg(x) AS mean FROM fx_changes GROUP BY source, measure) c
JOIN ({resampling.intervals_sql("SELECT source, measure, id AS key, x AS top, 1 AS bottom FROM fx_changes", "source, measure", _DRAWS)}) i ON i.source = c.source AND i.measure = c.measure""")
def _b02(spark, d):
    measures = {m: (F.col(m), F.lit(1)) for m in ("nll", "brier")}
    return rounded(resampling.poisson_intervals(metric_changes_rows(spark, d), "id", measures, ["source"], _DRAWS))


_CLUSTERS = "SELECT family, measure, grp AS key, sum(x) AS top, nullif(count(x), 0) AS bottom FROM fx_changes GROUP BY family, measure, grp"


@query("b03_cluster_intervals", f"""
SELECT c.family, c.measure, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT family, measure, count(top) AS n, sum(top) / sum(bottom) AS mean FROM ({_CLUSTERS}) GROUP BY family, measure) c
JOIN ({resampling.intervals_sql(_CLUSTERS, "family, measure", _DRAWS)}) i ON i.family = c.family AND i.measure = c.measure""")
def _b03(spark, d):
    return rounded(resampling.cluster_intervals(metric_changes_rows(spark, d), "group", {m: F.col(m) for m in ("nll", "brier")}, ["family"], _DRAWS))


_SPREAD = """
SELECT 'old_only' AS direction, m AS measure, v FROM (UNPIVOT (SELECT new_prob_chosen, new_prob_gold, old_prob_gold FROM fx_items WHERE o = 1 AND w = 0) ON new_prob_chosen, new_prob_gold, old_prob_gold INTO NAME m VALUE v)
UNION ALL SELECT 'new_only', m, v FROM (UNPIVOT (SELECT old_prob_chosen, old_prob_gold, new_prob_gold FROM fx_items WHERE o = 0 AND w = 1) ON old_prob_chosen, old_prob_gold, new_prob_gold INTO NAME m VALUE v)
UNION ALL SELECT 'both_correct', 'gold_probability_change', new_prob_gold - old_prob_gold FROM fx_items WHERE o = 1 AND w = 1"""


@query("e22_flip_confidence", f"""
WITH s AS ({_SPREAD})
SELECT p.direction, p.measure, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean
FROM ({percentile_sql('SELECT * FROM s', 'direction, measure', {'q1': 0.25, 'median': 0.5, 'q3': 0.75})}) p
JOIN (SELECT direction, measure, avg(v) AS mean FROM s GROUP BY ALL) a ON a.direction = p.direction AND a.measure = p.measure""")
def _e22(spark, d):
    return rounded(cmp.flip_confidence(kept_items(spark, d)))


@query("e23_group_consistency", """
SELECT count(*) AS groups, sum(n)::BIGINT AS items, sum(o)::BIGINT AS old_all_correct, sum(w)::BIGINT AS new_all_correct, round(avg(o), 6) AS old_share, round(avg(w), 6) AS new_share,
  sum(o * w)::BIGINT AS both, sum(o * (1 - w))::BIGINT AS old_only, sum(w * (1 - o))::BIGINT AS new_only
FROM (SELECT "group", count(*) AS n, min(o) AS o, min(w) AS w FROM fx_items GROUP BY "group" HAVING count(*) >= 2)""")
def _e23(spark, d):
    return rounded(cmp.group_consistency(items(spark, d)))


@query("e24_families_beyond", """
SELECT count(*) FILTER (d > 0.05) AS improved, count(*) FILTER (d < -0.05) AS regressed, count(*) AS total FROM (SELECT family, avg(w - o) AS d FROM fx_items GROUP BY family)""")
def _e24(spark, d):
    return cmp.families_beyond(items(spark, d))


@query("s09_flip_dump", """
SELECT i.id, CASE WHEN o = 1 THEN 'old_only' ELSE 'new_only' END AS direction, round(old_prob_gold, 6) AS old_prob_gold, round(new_prob_gold, 6) AS new_prob_gold, d.state, d.label
FROM fx_items i JOIN fx_decisions d ON d.id = i.id WHERE o <> w""")
def _s09(spark, d):
    recs = decisions(spark, d)
    flips = cmp.flip_rows(items(spark, d), recs.drop("e", "k"), run(recs, "old"), run(recs, "new"))
    return rounded(flips.select("id", "direction", "old_prob_gold", "new_prob_gold", "state", "label"))


# --- option order --------------------------------------------------------------------------------------------

def _nudge(key, id_col):
    """A small offset for every (record, option), from a hash."""
    return F.conv(F.substring(F.md5(F.concat(id_col, F.lit("/"), key)), 1, 4), 16, 10).cast("double") / 65536


def order_pairs(spark, d) -> DataFrame:
    """Choice questions read as given and with reversed options, plus 60-option questions read twice in chunks."""
    choice = decisions(spark, d).filter(F.col("primitive") == "choice")
    first = run(choice, "old")
    logits = F.zip_with(F.reverse(F.slice("e", 1, 10)), F.col("question.options"), lambda x, o: 8 * x + _nudge(o["key"], F.col("id")))
    turned = reverse_options(choice).withColumn("traces", F.transform(F.array(logits), lambda l: F.struct(
        l.alias("logits"), F.sequence(F.lit(65), F.lit(74)).alias("candidate_ids"), F.lit(1).alias("input_tokens"), F.lit(1.0).alias("prefill_ms"), F.lit(None).cast("string").alias("prompt_sha256"))))
    second = answers(turned).select("id", F.lit(None).cast("string").alias("error"), "answer")
    small = cmp.order_pairs(choice, first, second)
    many = chunked(spark, d)
    read = lambda offset: answers(chunk_traces(many, offset)).select("id", F.lit(None).cast("string").alias("error"), "answer")
    return small.unionByName(cmp.order_pairs(many, read(0), read(1)))


def chunked(spark, d) -> DataFrame:
    """Choice questions with 60 options from every vector."""
    options = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(
        F.concat(F.lit("k"), F.lpad(i.cast("string"), 2, "0")).alias("key"), F.lit(None).cast("string").alias("description")))
    return decisions(spark, d).withColumn("primitive", F.lit("choice")).withColumn(
        "question", F.struct(F.lit("choice").alias("type"), F.lit("Which of sixty?").alias("instructions"), options.alias("options"))
    ).withColumn("label", F.concat(F.lit("k"), F.lpad((F.col("vec_id") % 60).cast("string"), 2, "0"))).withColumn("id", F.concat(F.lit("w/"), F.col("vec_id").cast("string")))


def chunk_traces(items: DataFrame, offset: int) -> DataFrame:
    """Two chunk passes of 30 and a final pass over the two winners."""
    def one(start: int, n: int):
        return F.struct(
            F.transform(F.slice("e", offset + start, n), lambda x: 8 * x).alias("logits"), F.sequence(F.lit(65), F.lit(64 + n)).alias("candidate_ids"),
            F.lit(40).alias("input_tokens"), F.lit(1.5).alias("prefill_ms"), F.lit(None).cast("string").alias("prompt_sha256"))

    return items.withColumn("traces", F.array(one(1, 30), one(31, 30), one(61, 2)))


def _chunk_view(name: str, offset: int) -> None:
    view(name, f"""
SELECT vec_id, pos, v / sum(v) OVER (PARTITION BY vec_id) AS p FROM (
  SELECT l.vec_id, l.pos, exp(l.logit - max(l.logit) OVER (PARTITION BY l.vec_id, l.part)) * f.f AS v
  FROM (SELECT d.vec_id, u.pos, (u.pos - 1) // 30 AS part, 8 * d.embedding[{offset} + u.pos]::DOUBLE AS logit FROM fx_decisions d, unnest(range(1, 61)) AS u(pos)) l
  JOIN (SELECT vec_id, part, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS f FROM (
    SELECT d.vec_id, u.part, 8 * d.embedding[{offset} + 61 + u.part]::DOUBLE AS l FROM fx_decisions d, unnest([0, 1]) AS u(part))) f
  ON f.vec_id = l.vec_id AND f.part = l.part)""")


_chunk_view("fx_wide_old", 0)
_chunk_view("fx_wide_new", 1)
view("fx_order_pairs", """
SELECT d.id, 10 AS options, s.valid AND x.vec_id IS NOT NULL AS valid, s.chosen <> x.chosen AS flip, x.tvd, (s.chosen = d.label)::INT AS c1, (x.chosen = d.label)::INT AS c2
FROM fx_decisions d JOIN (SELECT vec_id, chosen, NOT (vec_id % 53 = 0 OR vec_id % 37 = 0) AS valid FROM fx_scored_old) s ON s.vec_id = d.vec_id
JOIN (SELECT a.vec_id, arg_min(a.key, (-a.q, -a.pos)) AS chosen, 0.5 * sum(abs(a.p - a.q)) AS tvd FROM (
  SELECT p.vec_id, p.pos, p.key, p.p * CASE WHEN p.vec_id % 43 = 0 THEN 1.01 ELSE 1 END AS p, exp(l.logit + n.nudge) / sum(exp(l.logit + n.nudge)) OVER (PARTITION BY p.vec_id) AS q
  FROM fx_p_old p JOIN fx_logits_old l ON l.vec_id = p.vec_id AND l.pos = p.pos
  JOIN (SELECT vec_id, u.pos, ('0x' || substr(md5('v/' || vec_id || '/c' || (u.pos - 1)), 1, 4))::BIGINT / 65536 AS nudge FROM embeddings, unnest(range(1, 11)) AS u(pos)) n ON n.vec_id = p.vec_id AND n.pos = p.pos
  WHERE p.primitive = 'choice') a GROUP BY a.vec_id) x ON x.vec_id = d.vec_id
WHERE d.primitive = 'choice'
UNION ALL
SELECT 'w/' || a.vec_id, 60, true, a.chosen <> b.chosen, t.tvd, (a.chosen - 1 = a.vec_id % 60)::INT, (b.chosen - 1 = a.vec_id % 60)::INT
FROM (SELECT vec_id, arg_min(pos, (-p, pos)) AS chosen FROM fx_wide_old GROUP BY vec_id) a
JOIN (SELECT vec_id, arg_min(pos, (-p, pos)) AS chosen FROM fx_wide_new GROUP BY vec_id) b ON b.vec_id = a.vec_id
JOIN (SELECT x.vec_id, 0.5 * sum(abs(x.p - y.p)) AS tvd FROM fx_wide_old x JOIN fx_wide_new y ON y.vec_id = x.vec_id AND y.pos = x.pos GROUP BY x.vec_id) t ON t.vec_id = a.vec_id""")


@query("e25_order_flips", f"""
SELECT coalesce(size, 'all') AS scope, count(*) AS planned, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND flip) AS flips,
  round(count(*) FILTER (valid AND flip) / count(*) FILTER (valid), 6) AS flip_rate,
  round({wilson_sql('count(*) FILTER (valid AND flip)', 'count(*) FILTER (valid)', '-')}, 6) AS wilson_low,
  round({wilson_sql('count(*) FILTER (valid AND flip)', 'count(*) FILTER (valid)', '+')}, 6) AS wilson_high,
  count(*) FILTER (valid AND c1 = 1) AS first_correct, count(*) FILTER (valid AND c2 = 1) AS second_correct,
  round(avg(tvd) FILTER (valid), 6) AS mean_tvd, round(max(tvd) FILTER (valid), 6) AS max_tvd
FROM (SELECT *, CASE WHEN options <= 52 THEN 'at_most_52' ELSE 'over_52' END AS size FROM fx_order_pairs) GROUP BY GROUPING SETS ((size), ())""")
def _e25(spark, d):
    return rounded(cmp.order_flips(order_pairs(spark, d)))


# --- parity --------------------------------------------------------------------------------------------------

view("fx_parity", """
SELECT o.vec_id, o.id, o.valid AND n.valid AS ok, x.agree, x.tvd,
  o.vec_id % 53 = 0 OR o.vec_id % 59 = 0 OR o.vec_id % 37 = 0 OR o.vec_id % 41 = 0 OR NOT o.valid AS problem
FROM fx_scored_old o JOIN fx_scored_new n ON n.id = o.id
JOIN (SELECT p.vec_id, arg_min(p.key, (-p.p, p.ord)) = arg_min(p.key, (-p.q, p.ord)) AS agree, 0.5 * sum(abs(p.p - p.q)) AS tvd FROM (
  SELECT a.vec_id, a.key, a.p, b.p AS q, CASE a.key WHEN '0' THEN 0 ELSE a.pos END AS ord FROM fx_p_old a JOIN fx_p_new b ON b.vec_id = a.vec_id AND b.pos = a.pos) p GROUP BY p.vec_id) x
ON x.vec_id = o.vec_id""")
_PARITY = ("count(*) AS n, count(*) FILTER (problem) AS problems, round(avg(agree::INT) FILTER (NOT problem), 6) AS argmax_agreement, "
           "round(avg(tvd) FILTER (NOT problem), 6) AS mean_tvd, round(max(tvd) FILTER (NOT problem), 6) AS max_tvd")


@query("e26_parity", f"SELECT {_PARITY}, false AS passed FROM fx_parity")
def _e26(spark, d):
    recs = decisions(spark, d)
    return rounded(cmp.parity(recs, run(recs, "old"), run(recs, "new")))


@query("e27_cross_run_parity", f"""
SELECT {_PARITY}, count(*) FILTER (NOT problem AND NOT agree) AS argmax_disagreements, arg_max(id, (tvd, id)) FILTER (NOT problem) AS max_tvd_id,
  0::BIGINT AS adaptive_final_prompt_differences, false AS passed FROM fx_parity""")
def _e27(spark, d):
    recs = decisions(spark, d)
    return rounded(cmp.cross_run_parity(recs, run(recs, "old"), run(recs, "new"), check_prompts=False))


@query("e28_logit_parity", """
SELECT count(*) AS prompts, round(sqrt(sum(s) / sum(k)), 6) AS centered_logit_rmse, round(avg(tvd), 6) AS mean_tvd, round(max(tvd), 6) AS max_tvd, round(avg(agree::INT), 6) AS argmax_agreement
FROM (SELECT c.vec_id, count(*) AS k, sum((c.x - c.y) ** 2) AS s, any_value(f.tvd) AS tvd, arg_min(c.pos, (-c.x, c.pos)) = arg_min(c.pos, (-c.y, c.pos)) AS agree FROM (
  SELECT o.vec_id, o.pos, o.logit - avg(o.logit) OVER w AS x, n.logit - avg(n.logit) OVER w AS y FROM fx_logits_old o JOIN fx_logits_new n ON n.vec_id = o.vec_id AND n.pos = o.pos WINDOW w AS (PARTITION BY o.vec_id)) c
  JOIN fx_parity f ON f.vec_id = c.vec_id GROUP BY c.vec_id)""")
def _e28(spark, d):
    recs = decisions(spark, d)
    logits = lambda offset: traces(recs, offset).select("id", F.element_at("traces", 1)["logits"].alias("logits"))
    return rounded(cmp.logit_parity(logits(0), logits(10)))


# --- reports against each other ------------------------------------------------------------------------------

def full_report(s: DataFrame) -> DataFrame:
    """Report with calibration error, overall and by source."""
    by = ops.ece(s, "source").withColumnRenamed("source", "scope").unionByName(ops.ece(s).withColumn("scope", F.lit("overall")))
    return ops.report(s).join(by, "scope")


def _report_view(which: str) -> None:
    ece = "SELECT {g} AS scope, sum(n * abs(a - p)) / sum(n) AS ece FROM (SELECT {k} least(9, floor(top * 10)) AS bin, count(*) AS n, avg(correct) AS a, avg(top) AS p FROM fx_scored_" + which + " WHERE valid GROUP BY ALL) {by}"
    view(f"fx_report_{which}", f"""
SELECT r.*, e.ece FROM (SELECT coalesce(source, 'overall') AS scope, count(*) AS n, sum(correct) / count(*) AS accuracy, """
         + ", ".join(f"avg({m}) FILTER (valid) AS {m}, count({m}) FILTER (valid) AS {m}_n" for m in M)
         + f""" FROM fx_scored_{which} GROUP BY GROUPING SETS ((source), ())) r
JOIN ({ece.format(g='source', k='source,', by='GROUP BY source')} UNION ALL {ece.format(g="'overall'", k='', by='')}) e ON e.scope = r.scope""")


_report_view("old")
_report_view("new")
_CHANGES = " UNION ALL ".join(
    f"SELECT a.scope, '{m}' AS metric, a.{m} AS x, b.{m} AS y, a.{n} = b.{n} AS denominators_match FROM fx_report_old a JOIN fx_report_new b ON b.scope = a.scope"
    for m, n in [("accuracy", "n"), ("ece", "n"), *[(m, f"{m}_n") for m in M]])


@query("e29_metric_changes", f"""
SELECT scope, metric, round(x, 6) AS previous, round(y, 6) AS current, round(y - x, 6) AS delta,
  CASE WHEN metric = 'accuracy' THEN y - x < -1e-12 ELSE y - x > 1e-12 END AS worse, denominators_match FROM ({_CHANGES}) WHERE x IS NOT NULL AND y IS NOT NULL""")
def _e29(spark, d):
    return rounded(cmp.metric_changes(full_report(kept(spark, d, "old")), full_report(kept(spark, d, "new"))))


_LAT = lambda factor, absent: percentile_sql(f"SELECT 's' || (vec_id % 5) AS \"group\", 40.0 + (vec_id * {factor}) % 97 AS v FROM embeddings WHERE vec_id % {absent} <> 0", '"group"', _LATENCY)


@query("e30_latency_changes", f"""
SELECT p."group", s.stat, CASE s.stat WHEN 'median' THEN p.median ELSE p.p95 END AS previous_ms, CASE s.stat WHEN 'median' THEN c.median ELSE c.p95 END AS current_ms,
  CASE s.stat WHEN 'median' THEN c.median - p.median ELSE c.p95 - p.p95 END AS delta_ms,
  round(100 * (CASE s.stat WHEN 'median' THEN c.median / p.median ELSE c.p95 / p.p95 END - 1), 6) AS delta_percent, CASE s.stat WHEN 'median' THEN c.median > p.median ELSE c.p95 > p.p95 END AS worse
FROM ({_LAT(7, 53)}) p JOIN ({_LAT(11, 59)}) c ON c."group" = p."group", unnest(['median', 'p95']) AS s(stat)""")
def _e30(spark, d):
    recs = decisions(spark, d).drop("group").withColumnRenamed("source", "group")
    both = [ops.latency_stats(run(recs, w).join(recs.select("id", "group"), "id"), ["group"]) for w in ("old", "new")]
    return rounded(cmp.latency_changes(*both))


view("fx_ood", resampling.intervals_sql(_CHANGE.format(by="") + " WHERE source = 's4'", "", cmp.RESAMPLES))


@query("e31_release_gates", f"""
WITH o AS (SELECT nll, ece FROM fx_report_old WHERE scope = 'overall'), n AS (SELECT nll, ece FROM fx_report_new WHERE scope = 'overall')
SELECT 'test_accuracy_gain' AS gate, mean >= 0.03 AND low > 0 AS passed, round(mean, 6) AS value, '' AS detail FROM fx_paired WHERE source = 'overall'
UNION ALL SELECT 'test_nll_not_worse', n.nll <= o.nll, round(n.nll, 6), '' FROM o, n
UNION ALL SELECT 'test_ece_not_worse', n.ece <= o.ece, round(n.ece, 6), '' FROM o, n
UNION ALL SELECT 'ood_lower_bound', low >= -0.015, round(low, 6), '' FROM fx_ood
UNION ALL SELECT 'source_regressions', count(*) = 0, count(*)::DOUBLE, coalesce(string_agg(source, ',' ORDER BY source), '') FROM fx_paired WHERE source <> 'overall' AND high < 0""")
def _e31(spark, d):
    old, new = kept(spark, d, "old"), kept(spark, d, "new")
    pairs = cut(cmp.paired_items(old, new))
    overall = lambda s: full_report(s).filter(F.col("scope") == "overall")
    by_source = cmp.paired_difference(pairs, "source", cmp.SOURCE_RESAMPLES)
    change = F.col("new").cast("int") - F.col("old").cast("int")
    measures = {"test": (change, F.lit(1)), "ood": (F.when(F.col("source") == "s4", change), F.lit(1))}  # one pass for both
    ends = cut(resampling.poisson_intervals(pairs, "id", measures, resamples=cmp.RESAMPLES))
    return rounded(cmp.release_gates(ends.filter("measure = 'test'"), ends.filter("measure = 'ood'"), by_source, overall(old), overall(new)))


@query("e32_readout_gate", """
SELECT round(a.nll, 6) AS input_nll, round(b.nll, 6) AS canonical_nll, round(a.accuracy, 6) AS input_accuracy, round(b.accuracy, 6) AS canonical_accuracy,
  b.nll <= a.nll + 0.05 AND b.accuracy >= a.accuracy - 0.02 AS accepted
FROM fx_report_old a JOIN fx_report_new b ON b.scope = a.scope WHERE a.scope = 'overall'""")
def _e32(spark, d):
    return rounded(cmp.readout_gate(ops.summarize(scored(spark, d, "old")), ops.summarize(scored(spark, d, "new"))))


@query("e33_phase_consistency", """
WITH r AS (SELECT CASE vec_id % 3 WHEN 0 THEN 'canary' WHEN 1 THEN 'test' ELSE 'shuffle' END AS phase, vec_id % 53 <> 0 AS there, vec_id % 3 = 1 AND vec_id % 37 = 0 AS failed, vec_id FROM embeddings)
SELECT 'phase' AS "check", phase AS name, count(*) FILTER (there) = count(*) AND count(*) FILTER (there AND failed) = 0 AS passed, count(*) FILTER (there) AS value FROM r GROUP BY phase
UNION ALL SELECT 'provenance', 'code', true, count(*) FROM r WHERE there
UNION ALL SELECT 'provenance', 'weights', false, count(*) FROM r WHERE there""")
def _e33(spark, d):
    v = F.col("vec_id")
    phase = F.when(v % 3 == 0, "canary").when(v % 3 == 1, "test").otherwise("shuffle").alias("phase")
    vectors = table(spark, d, "embeddings")
    expected = vectors.select(phase).groupBy("phase").agg(F.count(F.lit(1)).alias("expected"))
    rows = vectors.filter(v % 53 != 0).select(phase, F.when((v % 3 == 1) & (v % 37 == 0), "timeout").alias("error"), F.lit("r1").alias("code"), F.when(v % 3 == 2, "w2").otherwise("w1").alias("weights"))
    return cmp.phase_consistency(rows, expected, ["code", "weights"])


@query("e34_model_delta", "SELECT a.scope, round(100 * (b.accuracy - a.accuracy), 6) AS accuracy_delta_pp FROM fx_report_old a JOIN fx_report_new b ON b.scope = a.scope")
def _e34(spark, d):
    both = ops.report(scored(spark, d, "old")).withColumn("model", F.lit("base")).unionByName(ops.report(scored(spark, d, "new")).withColumn("model", F.lit("adapter")))
    return rounded(cmp.model_delta(both, "base", "adapter"))
