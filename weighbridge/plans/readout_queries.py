"""Queries: answers from logits, replay, calibration fitting and checkpoint choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators import calibration as cal
from weighbridge.operators import checkpoints as ckpt
from weighbridge.operators.readout import Calibration, answers, replay, replay_audit, told_prompts
from weighbridge.plans.fixtures import decisions, run, table, traces
from weighbridge.plans.registry import query, view
from weighbridge.plans.scoring_queries import chunk_traces, chunked, rounded

FITTED = Calibration(1.25, 0.8, 0.5)

view("fx_hot", """
SELECT l.vec_id, d.id, d.primitive, d.k, d.label, l.pos, l.logit, exp(l.logit / 1.25) / sum(exp(l.logit / 1.25)) OVER (PARTITION BY l.vec_id) AS p
FROM fx_logits_old l JOIN fx_decisions d ON d.vec_id = l.vec_id""")


@query("r01_readout_single", "SELECT id, pos - 1 AS option, round(p, 6) AS p FROM fx_hot WHERE primitive <> 'noul'")
def _r01(spark, d):
    rows = answers(traces(decisions(spark, d), 0), FITTED).filter(F.col("primitive") != "noul")
    keys = F.transform("question.options", lambda o: o["key"])
    return rounded(rows.select("id", F.posexplode(F.transform(keys, lambda k: F.element_at(F.col("answer.probabilities"), k))).alias("option", "p")).withColumn("option", F.col("option").cast("bigint")))


@query("r02_readout_chunked", "SELECT 'w/' || vec_id AS id, pos - 1 AS option, round(p, 6) AS p FROM fx_wide_old")
def _r02(spark, d):
    rows = answers(chunk_traces(chunked(spark, d), 0))
    keys = F.transform("question.options", lambda o: o["key"])
    return rounded(rows.select("id", F.posexplode(F.transform(keys, lambda k: F.element_at(F.col("answer.probabilities"), k))).alias("option", "p")).withColumn("option", F.col("option").cast("bigint")))


@query("r03_answer", """
SELECT id, CASE WHEN primitive = 'choice' THEN 'c' || (arg_min(pos, (-p, pos)) - 1) END AS choice,
  round(CASE WHEN primitive = 'score' THEN sum((pos - 1) * p) END, 6) AS score,
  round(CASE WHEN primitive = 'noul' THEN 1 / (1 + exp(-((max(logit) FILTER (pos = 1) - max(logit) FILTER (pos = 2)) / 1.25 / 0.8 + 0.5))) END, 6) AS noul,
  round(CASE primitive WHEN 'choice' THEN greatest(0, (10 * max(p) - 1) / 9) WHEN 'score' THEN greatest(0, 1 - sum(p * abs(pos - mode)) / 1.2) END, 6) AS confidence,
  CASE WHEN primitive = 'score' THEN string_agg((pos - 1) || '=Level ' || (pos - 1), ';' ORDER BY pos) END AS legend
FROM (SELECT *, first_value(pos) OVER (PARTITION BY id ORDER BY p DESC, pos) AS mode FROM fx_hot) GROUP BY id, primitive""")
def _r03(spark, d):
    rows = answers(traces(decisions(spark, d), 0), FITTED)
    legend = F.array_join(F.transform(F.array_sort(F.map_entries("answer.legend")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rounded(rows.select("id", "answer.choice", "answer.score", "answer.noul", "answer.confidence", legend.alias("legend")))


def recorded(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records of both sizes and their run with prompt hashes; some runs are tampered with."""
    recs = decisions(spark, d).unionByName(chunked(spark, d))
    small = traces(decisions(spark, d), 0)
    both = small.unionByName(chunk_traces(chunked(spark, d), 0))
    v = F.col("vec_id")
    told = F.col("prompt_hashes")
    hashed = F.zip_with("traces", F.when(v % 31 == 0, F.transform(told, lambda h: F.concat(h, F.lit("x")))).otherwise(told), lambda t, h: t.withField("prompt_sha256", h))
    both = told_prompts(both).withColumn("_hashed", hashed).drop("_o")
    hashed = F.col("_hashed")
    tampered = F.when(v % 29 == 0, F.concat(hashed, F.slice(hashed, 1, 1))).when(v % 23 == 0, F.transform(hashed, lambda t: t.withField("logits", F.slice(t["logits"], 2, F.size(t["logits"]) - 1)))).otherwise(hashed)
    runs = answers(both.withColumn("traces", tampered)).select(
        "id", F.when(v % 37 == 0, "timeout").alias("error"), F.when(v % 19 == 0, F.lit("other")).otherwise(F.col("input_sha256")).alias("input_sha256"), "answer", "traces")
    return recs, runs


view("fx_replay", """
SELECT id, vec_id, wide, CASE WHEN vec_id % 37 = 0 OR vec_id % 19 = 0 THEN 'prediction failed or input hash differs' WHEN vec_id % 29 = 0 THEN 'unused traces'
  WHEN vec_id % 23 = 0 THEN 'candidate count differs' WHEN vec_id % 31 = 0 THEN 'prompt differs from recorded run' END AS reason
FROM (SELECT id, vec_id, false AS wide FROM fx_decisions UNION ALL SELECT 'w/' || vec_id, vec_id, true FROM fx_decisions)""")


@query("r04_replay", "SELECT id, reason FROM fx_replay")
def _r04(spark, d):
    recs, runs = recorded(spark, d)
    return replay(recs, runs).select("id", "reason")


@query("r05_replay_audit", """
SELECT count(*) AS records, count(*) FILTER (reason IS NULL) AS replayed, count(*) FILTER (reason IS NOT NULL) AS failures,
  sum(CASE WHEN wide THEN 3 ELSE 1 END) FILTER (reason IS NULL)::BIGINT AS verified_traces,
  max(CASE WHEN wide THEN 40 ELSE vec_id % 50 + 10 END) FILTER (reason IS NULL) AS maximum_input_tokens, 0::BIGINT AS letters_with_changed_candidate FROM fx_replay""")
def _r05(spark, d):
    recs, runs = recorded(spark, d)
    return replay_audit(recs, runs)[1].withColumn("maximum_input_tokens", F.col("maximum_input_tokens").cast("bigint"))


# --- calibration ---------------------------------------------------------------------------------------------

def _runs(spark, d):
    recs = decisions(spark, d)
    return recs, run(recs, "old")


_T = "[" + ", ".join(str(t) for t in cal.TEMPERATURES) + "]"
_B = "[" + ", ".join(str(b) for b in cal.BIASES) + "]"
view("fx_choice_trials", f"""
SELECT t, avg(-ln(greatest(p, 1e-12))) AS nll, count(*) AS n FROM (
  SELECT l.vec_id, u.t, max(e) FILTER (key = label) / sum(e) AS p FROM (
    SELECT l.vec_id, u.t, d.label, CASE d.primitive WHEN 'choice' THEN 'c' || (l.pos - 1) ELSE (l.pos - 1)::VARCHAR END AS key, exp(l.logit / u.t) AS e
    FROM fx_logits_old l JOIN fx_decisions d ON d.vec_id = l.vec_id, unnest({_T}::DOUBLE[]) AS u(t)
    WHERE d.primitive <> 'noul' AND d.vec_id % 53 <> 0 AND d.vec_id % 37 <> 0) l, (SELECT 0) z, (SELECT l.t) u(t) GROUP BY l.vec_id, u.t)
GROUP BY t""".replace("l, (SELECT 0) z, (SELECT l.t) u(t) GROUP BY l.vec_id, u.t)", "l GROUP BY l.vec_id, l.t)").replace("SELECT l.vec_id, u.t, max(e)", "SELECT l.vec_id, l.t, max(e)"))
view("fx_noul_trials", f"""
SELECT t, b, avg(-ln(greatest(CASE WHEN label = '1' THEN y ELSE 1 - y END, 1e-12))) AS nll, count(*) AS n FROM (
  SELECT a.vec_id, d.label, u.t, w.b, 1 / (1 + exp(-((a.logit - c.logit) / u.t + w.b))) AS y
  FROM fx_logits_old a JOIN fx_logits_old c ON c.vec_id = a.vec_id AND a.pos = 1 AND c.pos = 2 JOIN fx_decisions d ON d.vec_id = a.vec_id,
    unnest({_T}::DOUBLE[]) AS u(t), unnest({_B}::DOUBLE[]) AS w(b)
  WHERE d.primitive = 'noul' AND d.vec_id % 53 <> 0 AND d.vec_id % 37 <> 0) GROUP BY t, b""")


@query("k01_mean_nll", """
SELECT kind, n, round(nll, 6) AS nll, (SELECT count(*) FROM fx_decisions WHERE (vec_id % 53 = 0 OR vec_id % 37 = 0) AND (primitive = 'noul') = (kind = 'noul')) AS rejected
FROM (SELECT 'choice_score' AS kind, n, nll FROM fx_choice_trials WHERE t = 1.25 UNION ALL SELECT 'noul', n, nll FROM fx_noul_trials WHERE t = 1.0 AND b = 0.5)""")
def _k01(spark, d):
    return rounded(cal.mean_nll(*_runs(spark, d), FITTED))


@query("k02_grid_trials", """
SELECT 'choice_score' AS kind, t AS temperature, 0.0::DOUBLE AS bias, round(nll, 6) AS nll FROM fx_choice_trials UNION ALL SELECT 'noul', t, b, round(nll, 6) FROM fx_noul_trials""")
def _k02_trials(spark, d):
    return rounded(cal.grid_trials(*_runs(spark, d)).select("kind", "temperature", "bias", "nll"))


def _fit_sql(noul: str) -> str:
    return f"""
WITH c AS (SELECT arg_min(t, (nll, abs(t - 1))) AS t, min(nll) AS nll, max(nll) FILTER (t = 1) AS before, max(n) AS n FROM fx_choice_trials),
b AS (SELECT arg_min(t, (x.nll, abs(b), abs(t / (SELECT c.t FROM c) - 1))) AS t, arg_min(b, (x.nll, abs(b), abs(t / (SELECT c.t FROM c) - 1))) AS b, min(x.nll) AS nll, max(x.nll) FILTER (t = 1 AND b = 0) AS before, max(x.n) AS n FROM fx_noul_trials x {noul})
SELECT c.t AS temperature, round(b.t / c.t, 6) AS noul_temperature, b.b AS noul_bias, c.n AS choice_score_records, b.n AS noul_records,
  (SELECT count(*) FROM fx_decisions WHERE vec_id % 53 = 0 OR vec_id % 37 = 0) AS rejected, round(c.before, 6) AS before_choice_score_nll, round(b.before, 6) AS before_noul_nll,
  round(c.nll, 6) AS after_choice_score_nll, round(b.nll, 6) AS after_noul_nll FROM c, b"""


@query("k02_fit_grid", _fit_sql(""))
def _k02(spark, d):
    return rounded(cal.fit_grid(*_runs(spark, d)))


@query("k03_fit_temperatures", _fit_sql("WHERE b = 0"))
def _k03(spark, d):
    return rounded(cal.fit_temperatures(*_runs(spark, d)))


@query("k04_noul_pool", """
SELECT coalesce(source, 'overall') AS scope, count(*) AS records, count(*) FILTER (label = '1') AS gold_yes, round(count(*) FILTER (label = '1') / count(*), 6) AS gold_yes_share
FROM fx_decisions WHERE primitive = 'noul' GROUP BY GROUPING SETS ((source), ())""")
def _k04(spark, d):
    return rounded(cal.binary_pool(decisions(spark, d)))


@query("k05_fit_guards", """
SELECT count(*) + count(*) FILTER (vec_id % 47 = 0) AS rows, count(*) FILTER (vec_id % 47 = 0) AS duplicate_ids,
  count(*) FILTER (vec_id % 10 = 0) + count(*) FILTER (vec_id % 10 = 0 AND vec_id % 47 = 0) AS outside_validation, false AS passed FROM fx_decisions""")
def _k05(spark, d):
    recs = decisions(spark, d).select("vec_id", "id", F.when(F.col("vec_id") % 10 == 0, "test").otherwise("validation").alias("split"))
    return cal.fit_guards(recs.unionByName(recs.filter(F.col("vec_id") % 47 == 0)))


@query("k06_calibration_match", """
SELECT p_brand AS model, n % 7 <> 0 AS calibrated, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN 'fitted to different weights: model_sha256' WHEN n % 3 = 0 THEN 'fitted to different weights: adapter_sha256'
  WHEN n % 2 = 0 THEN 'different readout version' END AS reason FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def _k06(spark, d):
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    n, sha = F.col("n"), F.sha2("model", 256)
    identities = brands.select("model", sha.alias("model_sha256"), F.sha2(F.concat("model", F.lit("+")), 256).alias("adapter_sha256"))
    fitted = brands.filter(n % 7 != 0).select(
        "model", F.when(n % 5 == 0, "old").otherwise(sha).alias("model_sha256"), F.when(n % 3 == 0, F.lit(None)).otherwise(F.sha2(F.concat("model", F.lit("+")), 256)).alias("adapter_sha256"),
        F.when(n % 2 != 0, "sorted-2").alias("readout_version"))
    return cal.calibration_match(fitted, identities, "sorted-2", "letters-1")


# --- checkpoints ---------------------------------------------------------------------------------------------

def log(spark, d) -> DataFrame:
    """An evaluation log per event type: one update per day, losses from the day's mean value."""
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), day.alias("update")).agg(
        F.round(F.avg("value") / 10, 9).alias("dev_nll"), F.round(F.avg((F.col("value") < 10).cast("double")), 9).alias("dev_accuracy"))


view("fx_log", """
SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS "update", round(avg(value) / 10, 9) AS dev_nll, round(avg((value < 10)::INT), 9) AS dev_accuracy FROM events GROUP BY ALL""")


@query("w02_checkpoint_select", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dev_nll, "update") AS rn, first_value(dev_nll) OVER u AS z, first_value(dev_accuracy) OVER u AS za FROM fx_log WINDOW u AS (PARTITION BY run ORDER BY "update"))
SELECT run, "update", round(dev_nll, 6) AS dev_nll, round(dev_accuracy, 6) AS dev_accuracy, "update" > 0 AND dev_nll < z AND dev_accuracy >= za - 0.02 AS passed FROM b WHERE rn = 1""")
def _w02(spark, d):
    return rounded(ckpt.checkpoint_select(log(spark, d)).withColumn("update", F.col("update").cast("bigint")))


@query("w03_stale_streak", """
WITH i AS (SELECT run, "update", coalesce(dev_nll < min(dev_nll) OVER (PARTITION BY run ORDER BY "update" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM fx_log),
s AS (SELECT *, "update" - max("update") FILTER (improved) OVER w AS gap, count(*) FILTER (NOT improved) OVER w - coalesce((SELECT count(*) FROM i j WHERE j.run = i.run AND NOT j.improved AND j."update" < (SELECT max(k."update") FROM i k WHERE k.run = i.run AND k.improved AND k."update" <= i."update")), 0) AS stale
  FROM i WINDOW w AS (PARTITION BY run ORDER BY "update")),
t AS (SELECT run, min("update") AS stop FROM s WHERE stale >= 2 GROUP BY run)
SELECT s.run, s."update", s.improved, s.stale, s."update" = t.stop AS stops_here, s."update" > t.stop AS after_stop FROM s JOIN t ON t.run = s.run""")
def _w03(spark, d):
    return ckpt.stale_streak(log(spark, d)).select("run", F.col("update").cast("bigint").alias("update"), "improved", "stale", "stops_here", "after_stop")
