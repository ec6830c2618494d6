"""Queries: the scoring core at the size of the largest table, one decision per order line, two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators import calibration as cal
from weighbridge.operators import comparison as cmp
from weighbridge.operators import scoring as ops
from weighbridge.operators.readout import SCORED, answers
from weighbridge.plans.fixtures import table
from weighbridge.plans.registry import query, view
from weighbridge.plans.scoring_queries import _FOUR, rounded, wilson_sql

LEVELS = 5


def line_records(spark, d) -> DataFrame:
    """Choice (even orders) or score (odd orders) questions with five options; the label follows the line's flags."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    label = (flag * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)) % LEVELS
    even = F.col("l_orderkey") % 2 == 0
    options = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.lit(None).cast("string").alias("description")) for i in range(LEVELS)])
    primitive = F.when(even, "choice").otherwise("score")
    # The four keys repeat now and then; with the quantity a line is unique.
    parts = [F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey")] + [F.col("l_quantity").cast("int")]
    ids = F.concat_ws("/", *[c.cast("string") for c in parts])
    return table(spark, d, "lineitem", "l_orderkey").select(
        ids.alias("id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("source"), F.col("l_orderkey").cast("string").alias("group"),
        primitive.alias("primitive"), F.struct(primitive.alias("type"), F.lit("").alias("instructions"), options.alias("options")).alias("question"),
        label.cast("string").alias("label"), ids.alias("input_sha256"))


def line_traces(recs: DataFrame, salt: str) -> DataFrame:
    """Five logits from a hash of the line; the new run leans towards the label."""
    lean = 1.0 if salt == "new" else 0.5
    unit = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("id"), F.lit(f"|{salt}|{i}"))), 1, 8), 16, 10).cast("double") / 2**32
    logits = F.array(*[4 * unit(i) + F.when(F.col("label") == str(i), lean).otherwise(0.0) for i in range(LEVELS)])
    return recs.withColumn("traces", F.array(F.struct(
        logits.alias("logits"), F.sequence(F.lit(65), F.lit(64 + LEVELS)).alias("candidate_ids"), F.lit(20).alias("input_tokens"), F.lit(None).cast("string").alias("prompt_sha256"))))


def line_run(spark, d, salt: str) -> DataFrame:
    failed = F.substring(F.md5("id"), 1, 2) == ("00" if salt == "old" else "01")
    return answers(line_traces(line_records(spark, d), salt), fields=SCORED).select(
        "id", F.when(failed, "timeout").alias("error"), "input_sha256", "answer", "traces", F.lit(1.0).alias("latency_ms"))


def _line_view(salt: str, lean: float, failing: str) -> None:
    view(f"fx_line_p_{salt}", f"""
SELECT id, i, label, source, grp, primitive, failed, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY id) AS p FROM (
  SELECT l.*, u.i, 4 * (('0x' || substr(md5(id || '|{salt}|' || u.i), 1, 8))::BIGINT / 4294967296) + CASE WHEN label = u.i THEN {lean} ELSE 0 END AS logit, substr(md5(id), 1, 2) = '{failing}' AS failed
  FROM (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::INT AS id, 's' || (l_suppkey % 7) AS source, l_orderkey::VARCHAR AS grp,
          CASE WHEN l_orderkey % 2 = 0 THEN 'choice' ELSE 'score' END AS primitive,
          (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) % 5 AS label FROM lineitem) l, unnest(range(0, 5)) AS u(i))""")
    view(f"fx_line_{salt}", f"""
SELECT id, any_value(source) AS source, any_value(grp) AS grp, NOT any_value(failed) AS valid, (NOT any_value(failed) AND arg_min(i, (-p, i)) = any_value(label))::INT AS correct,
  -ln(greatest(max(p) FILTER (i = label), 1e-12)) AS nll, sum((p - (i = label)::INT) ** 2) AS brier_multiclass,
  CASE WHEN any_value(primitive) = 'score' THEN abs(sum(i * p) - any_value(label)) END AS score_mae,
  CASE WHEN any_value(primitive) = 'score' THEN sum((cum - (label <= i)::INT) ** 2) FILTER (i < 4) / 4 END AS rps
FROM (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY i) AS cum FROM fx_line_p_{salt}) GROUP BY id""")


_line_view("old", 0.5, "00")
_line_view("new", 1.0, "01")
_L = ("nll", "brier_multiclass", "score_mae", "rps")


def line_scored(spark, d, salt: str) -> DataFrame:
    return ops.score_records(line_records(spark, d), line_run(spark, d, salt))


@query("e04_report_lines", "SELECT coalesce(source, 'overall') AS scope, count(*) AS n, count(*) FILTER (valid) AS valid, sum(correct)::BIGINT AS correct, round(sum(correct) / count(*), 6) AS accuracy, "
       + f"round({wilson_sql('sum(correct)', 'count(*)', '-')}, 6) AS wilson_low, round({wilson_sql('sum(correct)', 'count(*)', '+')}, 6) AS wilson_high, "
       + ", ".join(f"round(avg({m}) FILTER (valid), 6) AS {m}" for m in _L) + " FROM fx_line_new GROUP BY GROUPING SETS ((source), ())")
def _report(spark, d):
    return rounded(ops.report(line_scored(spark, d, "new")).select("scope", "n", "valid", "correct", "accuracy", "wilson_low", "wilson_high", *_L))


_PAIR = "(SELECT o.id, o.source, o.grp, o.correct AS o, n.correct AS w FROM fx_line_old o JOIN fx_line_new n ON n.id = o.id)"


@query("e21_four_way_lines", f"SELECT 'source' AS dimension, source AS value, 0::INT AS place, {_FOUR} FROM {_PAIR} GROUP BY source")
def _four_way(spark, d):
    return rounded(cmp.four_way_by(cmp.paired_items(line_scored(spark, d, "old"), line_scored(spark, d, "new")), ["source"]))


@query("e23_consistency_lines", f"""
SELECT count(*) AS groups, sum(n)::BIGINT AS items, sum(o)::BIGINT AS old_all_correct, sum(w)::BIGINT AS new_all_correct, round(avg(o), 6) AS old_share, round(avg(w), 6) AS new_share,
  sum(o * w)::BIGINT AS both, sum(o * (1 - w))::BIGINT AS old_only, sum(w * (1 - o))::BIGINT AS new_only FROM (SELECT grp, count(*) AS n, min(o) AS o, min(w) AS w FROM {_PAIR} GROUP BY grp HAVING count(*) >= 2)""")
def _consistency(spark, d):
    return rounded(cmp.group_consistency(cmp.paired_items(line_scored(spark, d, "old"), line_scored(spark, d, "new"))))


_TEMPS = "[" + ", ".join(str(t) for t in cal.TEMPERATURES) + "]"


@query("k02_trials_lines", f"""
SELECT 'choice_score' AS kind, t AS temperature, 0.0::DOUBLE AS bias, round(avg(nll), 6) AS nll, count(*) AS n FROM (
  SELECT id, u.t, -ln(greatest(sum(exp(logit / u.t)) FILTER (i = label) / sum(exp(logit / u.t)), 1e-12)) AS nll FROM fx_line_p_new, unnest({_TEMPS}::DOUBLE[]) AS u(t) WHERE NOT failed GROUP BY id, u.t) GROUP BY t""")
def _trials(spark, d):
    return rounded(cal.grid_trials(line_records(spark, d), line_run(spark, d, "new")).select("kind", "temperature", "bias", "nll", "n"))
