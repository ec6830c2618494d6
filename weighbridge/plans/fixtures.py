"""Records, traces, predictions, requests and logs derived from the given tables, in Spark and in checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.plans.registry import view
from weighbridge.session import spread

SEED = "weighbridge-2026"


def table(spark: SparkSession, d: str, name: str, *spread_by: str) -> DataFrame:
    """A given table; heavy queries name a key to spread a single-file table over the cores."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df, *spread_by) if spread_by else df


def r6(c) -> Column:
    """Six decimals, for comparison with the checking SQL; negative zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


# --- documents as labelled records -------------------------------------------------------------------------

def records(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents", "doc_id"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "source",
        F.col("text").alias("state"), F.sha2("text", 256).alias("state_sha256"),
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train").alias("pool"),
    )


view("fx_records", """
SELECT 'doc/' || d.doc_id AS id, d.doc_id, d.source, d.text AS state, sha256(d.text) AS state_sha256,
       l.quality::VARCHAR AS label,
       CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS pool
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")


def evaluation_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("id"), "text")


def prior(recs: DataFrame) -> DataFrame:
    """Earlier splits: a tenth of the records was evaluated before, a tenth trained on."""
    slot = F.col("doc_id") % 10
    return recs.filter(slot.isin(0, 1)).select(
        F.when(slot == 0, "eval").otherwise("train").alias("kind"),
        F.concat(F.lit("prior-"), slot.cast("string")).alias("file"), "id", "state_sha256",
    )


view("fx_prior", """
SELECT CASE doc_id % 10 WHEN 0 THEN 'eval' ELSE 'train' END AS kind, 'prior-' || (doc_id % 10) AS file, id, state_sha256
FROM fx_records WHERE doc_id % 10 IN (0, 1)""")


def source_order(recs: DataFrame) -> DataFrame:
    """Each source's place, by name. Sources are few: this is the quota table, not the data."""
    from pyspark.sql.window import Window

    return recs.select("source").distinct().withColumn("seq", F.row_number().over(Window.orderBy("source")))


view("fx_order", "SELECT source, row_number() OVER (ORDER BY source) AS seq FROM (SELECT DISTINCT source FROM fx_records)")


# --- embeddings as decisions, with two model runs ------------------------------------------------------------

def decisions(spark: SparkSession, d: str) -> DataFrame:
    """One labelled question per vector: choice (10 options), score (5 levels) or yes/no, by vec_id mod 3."""
    v, lab = F.col("vec_id"), F.col("label")
    kind = v % 3
    k = F.when(kind == 0, 10).when(kind == 1, 5).otherwise(2)
    options = F.when(kind < 2, F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(
            F.when(kind == 0, F.concat(F.lit("c"), i.cast("string"))).otherwise(i.cast("string")).alias("key"),
            F.concat(F.lit("Level "), i.cast("string")).alias("description")),
    )).otherwise(F.array().cast("array<struct<key:string,description:string>>"))
    primitive = F.when(kind == 0, "choice").when(kind == 1, "score").otherwise("noul")
    e = F.transform("embedding", lambda x: x.cast("double"))
    votes = F.transform(F.slice(F.col("e"), 21, F.col("k")), lambda x: F.abs(x))
    keys = F.when(kind == 2, F.array(F.lit("0"), F.lit("1"))).otherwise(F.transform(F.col("question.options"), lambda o: o["key"]))
    # v and its hash stand in for the state text and its identity.
    state = F.concat(F.lit("Vector "), v.cast("string"), F.lit(" of cluster "), lab.cast("string"))
    return table(spark, d, "embeddings", "vec_id").select(
        "vec_id", F.concat(F.lit("v/"), v.cast("string")).alias("id"),
        F.concat(F.lit("s"), (v % 5).cast("string")).alias("source"),
        F.concat(F.lit("g"), F.floor(v / 3).cast("string")).alias("group"),
        F.concat(F.lit("f"), (v % 4).cast("string")).alias("family"),
        F.when(v % 2 == 0, "even").otherwise("odd").alias("subset"),
        primitive.alias("primitive"), state.alias("state"),
        F.struct(primitive.alias("type"), F.lit("Which cluster is it?").alias("instructions"), options.alias("options")).alias("question"),
        F.when(kind == 0, F.concat(F.lit("c"), lab.cast("string"))).when(kind == 1, F.floor(lab / 2).cast("string"))
        .otherwise((lab % 2).cast("string")).alias("label"),
        F.sha2(state, 256).alias("input_sha256"), e.alias("e"), k.alias("k"),
    ).withColumn("soft", F.when(v % 5 == 0, F.map_from_arrays(keys, votes)))


view("fx_decisions", """
SELECT vec_id, 'v/' || vec_id AS id, 's' || (vec_id % 5) AS source, 'g' || (vec_id // 3) AS "group",
       'f' || (vec_id % 4) AS family, CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS subset,
       CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS primitive,
       'Vector ' || vec_id || ' of cluster ' || label AS state,
       CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 2 END AS k,
       CASE vec_id % 3 WHEN 0 THEN 'c' || label WHEN 1 THEN (label // 2)::VARCHAR ELSE (label % 2)::VARCHAR END AS label,
       embedding FROM embeddings""")


def traces(items: DataFrame, offset: int) -> DataFrame:
    """items plus one forward pass: logits are eight times a slice of the vector, in option order (yes, no)."""
    logits = F.transform(F.slice("e", offset + 1, F.col("k")), lambda x: 8 * x)
    return items.withColumn("traces", F.array(F.struct(
        logits.alias("logits"), F.sequence(F.lit(65), F.lit(64) + F.col("k")).alias("candidate_ids"),
        (F.col("vec_id") % 50 + 10).cast("int").alias("input_tokens"), F.lit(1.5).alias("prefill_ms"),
        F.lit(None).cast("string").alias("prompt_sha256"),
    )))


def run(items: DataFrame, which: str) -> DataFrame:
    """Predictions of the old or new run: some failed, some missing, some with a broken sum (old only)."""
    from weighbridge.operators.readout import Calibration, answers

    offset, failing, absent = (0, 37, 53) if which == "old" else (10, 41, 59)
    v = F.col("vec_id")
    rows = answers(traces(items, offset), Calibration())
    if which == "old":
        broken = F.col("answer.probabilities")
        rows = rows.withColumn("answer", F.when(v % 43 == 0, F.col("answer").withField(
            "probabilities", F.transform_values(broken, lambda _, p: p * 1.01))).otherwise(F.col("answer")))
    return rows.filter(v % absent != 0).select(
        "id", F.when(v % failing == 0, "timeout").alias("error"), "input_sha256", "answer", "traces",
        (F.lit(40.0) + (v * (7 if which == "old" else 11)) % 97).alias("latency_ms"),
    )


def _run_views(which: str, offset: int, failing: int, absent: int, factor: int) -> None:
    broken = "(d.vec_id % 43 = 0 AND d.primitive <> 'noul')" if which == "old" else "false"
    view(f"fx_logits_{which}", f"""
SELECT d.vec_id, u.pos, 8 * d.embedding[{offset} + u.pos]::DOUBLE AS logit
FROM fx_decisions d, unnest(range(1, d.k + 1)) AS u(pos)""")
    view(f"fx_p_{which}", f"""
SELECT l.vec_id, l.pos, d.primitive,
       CASE d.primitive WHEN 'choice' THEN 'c' || (l.pos - 1) WHEN 'score' THEN (l.pos - 1)::VARCHAR
            ELSE CASE l.pos WHEN 1 THEN '1' ELSE '0' END END AS key,
       exp(l.logit - max(l.logit) OVER w) / sum(exp(l.logit - m.top)) OVER w AS p
FROM fx_logits_{which} l JOIN fx_decisions d ON d.vec_id = l.vec_id
JOIN (SELECT vec_id, max(logit) AS top FROM fx_logits_{which} GROUP BY vec_id) m ON m.vec_id = l.vec_id
WINDOW w AS (PARTITION BY l.vec_id)""")
    view(f"fx_scored_{which}", f"""
SELECT s.*, CASE WHEN valid AND chosen = label THEN 1 ELSE 0 END AS correct FROM (
SELECT d.vec_id, d.id, d.source, d."group", d.family, d.subset, d.primitive, d.label, d.k,
  CASE WHEN d.vec_id % {absent} = 0 OR d.vec_id % {failing} = 0 THEN 'missing or failed prediction'
       WHEN {broken} AND max(p.p) * 1.01 > 1 THEN 'invalid probability keys or values'
       WHEN {broken} THEN 'probabilities do not sum to one' END AS reason,
  NOT (d.vec_id % {absent} = 0 OR d.vec_id % {failing} = 0 OR {broken}) AS valid,
  CASE WHEN d.primitive = 'noul' THEN CASE WHEN max(p.p) FILTER (p.key = '1') >= 0.5 THEN '1' ELSE '0' END
       ELSE arg_min(p.key, (-p.p, p.pos)) END AS chosen,
  max(p.p) AS top, max(p.p) FILTER (p.key = d.label) AS p_gold,
  -ln(greatest(max(p.p) FILTER (p.key = d.label), 1e-12)) AS nll,
  sum((p.p - CASE WHEN p.key = d.label THEN 1 ELSE 0 END) ** 2) AS brier_multiclass,
  CASE WHEN d.primitive = 'noul' THEN (max(p.p) FILTER (p.key = '1') - try_cast(d.label AS INT)) ** 2 END AS brier_binary,
  CASE WHEN d.primitive = 'score' THEN abs(sum((p.pos - 1) * p.p) - try_cast(d.label AS INT)) END AS score_mae,
  CASE WHEN d.primitive = 'score' THEN sum((p.cum - CASE WHEN try_cast(d.label AS INT) <= p.pos - 1 THEN 1 ELSE 0 END) ** 2)
       FILTER (p.pos < d.k) / (d.k - 1) END AS rps,
  CASE WHEN d.primitive = 'score' THEN sum((p.pos - 1) * p.p) END AS ev,
  CASE WHEN d.vec_id % 5 = 0 THEN 0.5 * sum(abs(p.p - p.h)) END AS human_tvd,
  CASE WHEN d.vec_id % {absent} <> 0 THEN 40.0 + (d.vec_id * {factor}) % 97 END AS latency_ms
FROM fx_decisions d JOIN (
  SELECT q.*, sum(q.p) OVER (PARTITION BY q.vec_id ORDER BY q.pos) AS cum, h.h
  FROM fx_p_{which} q JOIN fx_human h ON h.vec_id = q.vec_id AND h.key = q.key) p ON p.vec_id = d.vec_id
GROUP BY d.vec_id, d.id, d.source, d."group", d.family, d.subset, d.primitive, d.label, d.k) s""")


view("fx_human", """
SELECT vec_id, key, v / sum(v) OVER (PARTITION BY vec_id) AS h FROM (
  SELECT d.vec_id, CASE d.primitive WHEN 'choice' THEN 'c' || (u.pos - 1) ELSE (u.pos - 1)::VARCHAR END AS key,
         abs(d.embedding[20 + u.pos]::DOUBLE) AS v
  FROM fx_decisions d, unnest(range(1, d.k + 1)) AS u(pos))""")
_run_views("old", 0, 37, 53, 7)
_run_views("new", 10, 41, 59, 11)
