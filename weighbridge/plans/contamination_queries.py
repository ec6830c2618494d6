"""Queries: n-gram contamination of the documents by the benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.functions.hashing import seeded_order
from weighbridge.operators import contamination as ops
from weighbridge.operators import diversity
from weighbridge.plans.fixtures import SEED, evaluation_texts, r6, records
from weighbridge.plans.registry import query, view


def _documents(spark, d):
    return records(spark, d).select(
        "id", "source", seeded_order(SEED, F.concat(F.col("source"), F.lit("/train")), "id").alias("h"), F.col("state").alias("text")
    )


def measured(spark, d):
    return ops.ngram_contamination(_documents(spark, d), evaluation_texts(spark, d))


_WORDS = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
view("fx_grams", f"""
SELECT DISTINCT id, source, g FROM (
  SELECT id, source, array_to_string(w[i:i + 12], ' ') AS g FROM (
    SELECT id, source, w, unnest(range(1, len(w) - 11)) AS i FROM (
      SELECT id, source, {_WORDS.format(t='state')} AS w FROM fx_records) WHERE len(w) >= 13))""")
view("fx_eval_grams", f"""
SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS g FROM (
  SELECT w, unnest(range(1, len(w) - 11)) AS i FROM (
    SELECT {_WORDS.format(t='text')} AS w FROM benchmark) WHERE len(w) >= 13)""")
view("fx_contamination", f"""
SELECT r.id, r.source, sha256('{SEED}|' || r.source || '/train|' || r.id) AS h, count(g.g) AS grams,
       count(e.g) AS hits, count(e.g) / nullif(count(g.g), 0) AS ratio
FROM fx_records r LEFT JOIN fx_grams g ON g.id = r.id LEFT JOIN fx_eval_grams e ON e.g = g.g
GROUP BY r.id, r.source""")


@query("d11_ngram_contamination", "SELECT id, source, grams, hits, round(ratio, 6) AS ratio FROM fx_contamination")
def _d11(spark, d):
    return measured(spark, d).select("id", "source", "grams", "hits", r6("ratio").alias("ratio"))


@query("d12_near_duplicate_filter", "SELECT id, source, hits FROM fx_contamination WHERE grams = 0 OR ratio <= 0.2")
def _d12(spark, d):
    return ops.near_duplicate_filter(measured(spark, d)).select("id", "source", "hits")


@query("d13_contamination_report", """
SELECT c.source, count(*) AS records, count(*) FILTER (hits > 0) AS ngram_hits,
       coalesce(string_agg(id, ',' ORDER BY rn) FILTER (hits > 0 AND rn <= 5), '') AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY source, hits > 0 ORDER BY h) AS rn FROM fx_contamination) c
GROUP BY c.source""")
def contamination_by_source(spark, d):
    return ops.contamination_report(measured(spark, d))


@query("x05_ngrams", "SELECT source, count(*) AS rows, count(DISTINCT g) AS grams FROM fx_grams GROUP BY source")
def _x05(spark, d):
    return ops.gram_counts(records(spark, d).select("source", F.col("state").alias("text")), "source")


_MASKED = "regexp_replace(regexp_replace(state, '[0-9]+([.,][0-9]+)*', '#', 'g'), '[A-Z][A-Za-z]*', '@', 'g')"
view("fx_five", f"""
SELECT source, state, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT DISTINCT source, state, {_WORDS.format(t='state')} AS w FROM fx_records) WHERE len(w) >= 5""")


@query("d22_diversity", f"""
WITH g AS (SELECT source, md5(state) AS k, len(s) AS n, unnest(s) AS g FROM fx_five),
near AS (
  SELECT source, count(DISTINCT k) AS near FROM (
    SELECT a.source, a.k FROM g a JOIN g b ON a.source = b.source AND a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 95 * greatest(a.n, b.n)
    GROUP BY a.source, a.k, b.k, a.n, b.n HAVING 195 * count(*) >= 95 * (a.n + b.n)) GROUP BY source),
shapes AS (SELECT source, max(n) AS top FROM (SELECT source, {_MASKED} AS t, count(*) AS n FROM fx_records GROUP BY ALL) GROUP BY source)
SELECT r.source, r.records, r.exact_copies, round(top / records, 6) AS template_share, round(coalesce(near, 0) / records, 6) AS near_share
FROM (SELECT source, count(*) AS records, count(*) - count(DISTINCT state) AS exact_copies FROM fx_records GROUP BY source) r
JOIN shapes t ON t.source = r.source LEFT JOIN near n ON n.source = r.source""")
def _d22(spark, d):
    out = diversity.diversity_report(records(spark, d).select("source", "state"))
    return out.select("source", "records", "exact_copies", r6("template_share").alias("template_share"), r6("near_share").alias("near_share"))
