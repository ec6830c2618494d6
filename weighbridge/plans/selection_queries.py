"""Queries: hash-ordered selection, isolation, balance and staged splits over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.hashing import seeded_bucket, seeded_order
from weighbridge.functions.text import digest, normalized_state, words
from weighbridge.operators import selection as ops
from weighbridge.operators.ranking import ranked
from weighbridge.plans.fixtures import SEED, prior, r6, records, source_order, table
from weighbridge.plans.registry import query, view
from weighbridge.session import cut


def narrow(spark, d) -> DataFrame:
    """Records without their texts, written once: stages and rounds read keys only."""
    return cut(records(spark, d).drop("state"))


# --- single selections ---------------------------------------------------------------------------------------

view("fx_allowed", """
SELECT * FROM fx_records WHERE id NOT IN (SELECT id FROM fx_prior)
AND state_sha256 NOT IN (SELECT state_sha256 FROM fx_prior)""")


def _firsts_sql(rows: str, tag: str, by: str = "source") -> str:
    """Allowed rows, one per (group, state), with their hash."""
    key = "|| '/' ||".join(by.split(","))
    return (
        f"SELECT {by}, id, state_sha256, h FROM (SELECT *, row_number() OVER (PARTITION BY {by}, state_sha256 ORDER BY h, id) AS first "
        f"FROM (SELECT *, sha256('{SEED}|' || {key} || '/{tag}|' || id) AS h FROM {rows})) WHERE first = 1"
    )


view("fx_take", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, id) AS rank FROM ({_firsts_sql('fx_allowed', 'test')}))""")


@query("d01_take_k", "SELECT source, id, state_sha256, rank FROM fx_take WHERE rank <= 12")
def _d01(spark, d):
    recs = records(spark, d)
    return ops.take_k(recs, 12, SEED, "test", exclude=prior(recs)).select("source", "id", "state_sha256", "rank")


@query("d02_select_exact", """
SELECT s.source, 40 AS need, count(t.id) AS found FROM (SELECT DISTINCT source FROM fx_records) s
LEFT JOIN (SELECT * FROM fx_take WHERE rank <= 40) t ON t.source = s.source GROUP BY s.source HAVING count(t.id) < 40""")
def _d02(spark, d):
    recs = records(spark, d)
    return ops.select_exact(recs, 40, SEED, "test", exclude=prior(recs))[1]


@query("d03_select_unique_report", f"""
SELECT r.source, r.id FROM (SELECT *, sha256('{SEED}|' || source || '/test|' || id) AS h FROM fx_records) r
JOIN (SELECT source, max(h) AS last FROM fx_take WHERE rank <= 12 GROUP BY source) l ON l.source = r.source AND r.h < l.last
WHERE r.id NOT IN (SELECT id FROM fx_take WHERE rank <= 12)""")
def _d03(spark, d):
    recs = records(spark, d)
    return ops.select_unique_report(recs, 12, SEED, "test", exclude=prior(recs))[1].select("source", "id")


# --- quotas and stages ---------------------------------------------------------------------------------------

# The checking SQL walks the groups one after another, as a plain greedy loop would, over this many places.
WALK = 24


def _walk_sql(prefix: str, candidates: str, places: int = WALK) -> str:
    """CTEs picking group after group; candidates has seq, k, id, state_sha256, h and the group columns."""
    parts = []
    for i in range(1, places + 1):
        taken = f"AND state_sha256 NOT IN (SELECT state_sha256 FROM {prefix}{i - 1})" if i > 1 else ""
        before = f"SELECT * FROM {prefix}{i - 1} UNION ALL " if i > 1 else ""
        parts.append(
            f"{prefix}{i} AS MATERIALIZED ({before}SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS rank FROM {candidates} "
            f"WHERE seq = {i} {taken}) WHERE rank <= k)"
        )
    return ",\n".join(parts)


@query("d04_multi_quota", f"""
WITH cand AS MATERIALIZED (SELECT f.*, o.seq, 4 + o.seq % 5 AS k FROM ({_firsts_sql('fx_allowed', 'test')}) f JOIN fx_order o ON o.source = f.source),
{_walk_sql('pick', 'cand')}
SELECT source, id, rank FROM pick{WALK}""")
def _d04(spark, d):
    recs = narrow(spark, d)
    quotas = source_order(recs).withColumn("k", 4 + F.col("seq") % 5)
    cand = ops.firsts(recs, SEED, "test", exclude=prior(recs))
    return ops.multi_quota(cand, quotas, ["source"]).select("source", "id", "rank")


def _quotas(order: DataFrame, shares: dict[str, int]) -> DataFrame:
    """Every source gives shares[split] rows to each split, splits interleaved in order."""
    names = list(shares)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (n, k) in enumerate(shares.items())]))
    return order.select("source", "seq", pairs.alias("q")).select(
        "source", F.col("q.split").alias("split"), (F.col("seq") * len(names) + F.col("q.i") - len(names) + 1).alias("seq"), F.col("q.k").alias("k")
    )


def staged(recs: DataFrame) -> DataFrame:
    """test, then dev and calibration interleaved from one pool, then training outside every forbidden key."""
    order, earlier = source_order(recs), prior(recs)
    evaluation = [
        ops.Stage("test", F.col("pool") == "test", _quotas(order, {"test": 4}), exclude=earlier),
        ops.Stage("development", F.col("pool") == "validation", _quotas(order, {"dev": 3, "calibration": 2}), exclude=earlier),
    ]
    chosen = ops.staged_splits(recs, evaluation, SEED)
    barred = ops.forbidden_keys(earlier, chosen, recs)
    train = ops.staged_splits(recs, [ops.Stage("train", F.col("pool") == "train", _quotas(order, {"train": 9}), exclude=barred)], SEED)
    return chosen.unionByName(train)


def _stage_sql(name: str, rows: str, splits: dict[str, int]) -> str:
    n = len(splits)
    cands = " UNION ALL ".join(
        f"SELECT f.*, '{s}' AS split, o.seq * {n} + {i} - {n} + 1 AS seq, {k} AS k FROM ({_firsts_sql(rows, s)}) f JOIN fx_order o ON o.source = f.source"
        for i, (s, k) in enumerate(splits.items())
    )
    return f"{name}_cand AS MATERIALIZED ({cands}),\n{_walk_sql(name, name + '_cand', WALK * n)}"


_STAGED = f"""
WITH t_rows AS (SELECT * FROM fx_allowed WHERE pool = 'test'),
{_stage_sql('t', 't_rows', {'test': 4})},
v_rows AS (SELECT * FROM fx_allowed WHERE pool = 'validation' AND state_sha256 NOT IN (SELECT state_sha256 FROM t{WALK})),
{_stage_sql('v', 'v_rows', {'dev': 3, 'calibration': 2})},
barred AS (SELECT id, state_sha256 FROM fx_prior WHERE kind = 'eval' UNION SELECT id, state_sha256 FROM t{WALK}
           UNION SELECT id, state_sha256 FROM v{2 * WALK} UNION SELECT id, state_sha256 FROM fx_records WHERE pool <> 'train'),
r_rows AS (SELECT * FROM fx_records WHERE pool = 'train' AND id NOT IN (SELECT id FROM barred) AND state_sha256 NOT IN (SELECT state_sha256 FROM barred)),
{_stage_sql('r', 'r_rows', {'train': 9})},
chosen AS (SELECT split, source, id, state_sha256, rank FROM t{WALK} UNION ALL SELECT split, source, id, state_sha256, rank FROM v{2 * WALK}
           UNION ALL SELECT split, source, id, state_sha256, rank FROM r{WALK})
"""


@query("d05_staged_splits", _STAGED + "SELECT split, source, id, rank FROM chosen")
def _d05(spark, d):
    return staged(narrow(spark, d)).select("split", "source", "id", "rank")


@query("s10_split_manifest", _STAGED + """
SELECT split, coalesce(source, '*') AS source, count(*) AS records,
  round(count(*) / max(max(n)) OVER (PARTITION BY split), 6) AS share, sum(m)::VARCHAR AS checksum
FROM (SELECT c.*, count(*) OVER (PARTITION BY split) AS n, ('0x' || substr(md5(id || '|' || state_sha256), 1, 8))::BIGINT AS m FROM chosen c)
GROUP BY GROUPING SETS ((split, source), (split))""")
def _s10(spark, d):
    return ops.split_manifest(staged(narrow(spark, d))).withColumns({"share": r6("share"), "checksum": F.col("checksum").cast("string")})


# --- balanced yes/no -----------------------------------------------------------------------------------------

CAP = 6


def balanced(recs: DataFrame):
    yes_no = recs.filter(F.col("label").isNotNull()).select("id", "state_sha256", "source", "label")
    return ops.balanced_binary(yes_no, CAP, source_order(recs), SEED, "calibration", exclude=prior(recs))


def _balanced_sql() -> str:
    """Source after source: free states, counts, yes picks, then no picks outside the yes states."""
    parts = [f"cand AS MATERIALIZED (SELECT f.*, o.seq FROM ({_firsts_sql('(SELECT * FROM fx_allowed WHERE label IS NOT NULL)', 'calibration', 'source,label')}) f "
             "JOIN fx_order o ON o.source = f.source)"]
    for i in range(1, WALK + 1):
        taken = f"AND state_sha256 NOT IN (SELECT state_sha256 FROM b{i - 1})" if i > 1 else ""
        before = f"SELECT * FROM b{i - 1} UNION ALL " if i > 1 else ""
        parts += [
            f"free{i} AS MATERIALIZED (SELECT * FROM cand WHERE seq = {i} {taken})",
            f"size{i} AS MATERIALIZED (SELECT {i} AS seq, count(*) FILTER (label = '1') AS available_yes, count(*) FILTER (label = '0') AS available_no FROM free{i})",
            f"yes{i} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, id) AS rank FROM free{i} WHERE label = '1' "
            f"QUALIFY rank <= (SELECT least({CAP}, available_yes, available_no) FROM size{i}))",
            f"no{i} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, id) AS rank FROM free{i} WHERE label = '0' "
            f"AND state_sha256 NOT IN (SELECT state_sha256 FROM yes{i}) QUALIFY rank <= (SELECT least({CAP}, available_yes, available_no) FROM size{i}))",
            f"b{i} AS MATERIALIZED ({before}SELECT * FROM yes{i} UNION ALL SELECT * FROM no{i})",
        ]
    sizes = " UNION ALL ".join(f"SELECT * FROM size{i}" for i in range(1, WALK + 1))
    parts.append(f"""
composition AS (SELECT o.source, 2 * least(y, n) AS records, least(y, n) AS gold_yes, available_yes, available_no FROM ({sizes}) z
  JOIN fx_order o ON o.seq = z.seq LEFT JOIN (SELECT seq, count(*) FILTER (label = '1') AS y, count(*) FILTER (label = '0') AS n FROM b{WALK} GROUP BY seq) p ON p.seq = z.seq
  WHERE available_yes + available_no > 0)""")
    return "WITH " + ",\n".join(parts)


@query("d06_balanced_binary", _balanced_sql() + """
SELECT source, coalesce(records, 0) AS records, coalesce(gold_yes, 0) AS gold_yes, available_yes, available_no FROM composition""")
def _d06(spark, d):
    return balanced(narrow(spark, d))[1]


@query("d06_balanced_rows", _balanced_sql() + f"""
SELECT b.source, b.label, b.id, b.rank FROM b{WALK} b JOIN composition c ON c.source = b.source WHERE b.rank <= c.gold_yes""")
def _d06_rows(spark, d):
    return balanced(narrow(spark, d))[0].select("source", "label", "id", "rank")


@query("d07_balance_gate", _balanced_sql() + """
SELECT coalesce(sum(records), 0)::BIGINT AS records, coalesce(sum(gold_yes), 0)::BIGINT AS gold_yes, count(*) FILTER (records > 0) AS sources,
  round(coalesce(sum(gold_yes) / nullif(sum(records), 0), 0), 6) AS gold_yes_share,
  coalesce(sum(records), 0) >= 150 AND coalesce(sum(gold_yes) / nullif(sum(records), 0), 0) BETWEEN 0.4 AND 0.6 AND count(*) FILTER (records > 0) >= 3 AS passed
FROM composition""")
def _d07(spark, d):
    return ops.balance_gate(balanced(narrow(spark, d))[1]).withColumn("gold_yes_share", r6("gold_yes_share"))


# --- exclusion keys and leaks --------------------------------------------------------------------------------

@query("d08_synthetic_exclusions", """
SELECT id, state_sha256 FROM fx_prior WHERE kind = 'train' UNION SELECT id, state_sha256 FROM fx_take WHERE rank <= 12""")
def _d08(spark, d):
    recs = records(spark, d)
    return ops.synthetic_exclusions(prior(recs), ops.take_k(recs, 12, SEED, "test", exclude=prior(recs)))


@query("d09_forbidden_keys", """
SELECT id, state_sha256 FROM fx_prior WHERE kind = 'eval' UNION SELECT id, state_sha256 FROM fx_take WHERE rank <= 12
UNION SELECT id, state_sha256 FROM fx_records WHERE pool <> 'train'""")
def _d09(spark, d):
    recs = records(spark, d)
    return ops.forbidden_keys(prior(recs), ops.take_k(recs, 12, SEED, "test", exclude=prior(recs)), recs)


def dialogs(spark, d) -> DataFrame:
    """Prompt and response pairs: a user turn and the assistant turn after it; the state is their JSON."""
    conv = table(spark, d, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    reply = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("/", F.lit("dialog"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn",
        F.to_json(F.struct("prompt", "response")).alias("state"),
        F.when(F.col("conv_id") % 5 == 0, "eval").otherwise("train").alias("pool"),
    ).withColumn("prompt_sha256", F.sha2(F.try_variant_get(F.try_parse_json("state"), "$.prompt", "string"), 256))


view("fx_dialogs", """
SELECT 'dialog/' || r.conv_id || '/' || r.turn AS id, r.conv_id, r.turn, u.text AS prompt, r.text AS response,
       CASE r.conv_id % 5 WHEN 0 THEN 'eval' ELSE 'train' END AS pool
FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
WHERE u.role = 'user' AND r.role = 'assistant'""")


@query("d10_drop_prompt_groups", """
SELECT id FROM fx_dialogs WHERE pool = 'train' AND prompt NOT IN (SELECT prompt FROM fx_dialogs WHERE pool = 'eval')""")
def _d10(spark, d):
    rows = dialogs(spark, d)
    return ops.drop_prompt_groups(rows.filter(F.col("pool") == "train"), rows.filter(F.col("pool") == "eval")).select("id")


@query("d14_overlap_matrix", """
WITH s AS (SELECT DISTINCT pool AS split, state_sha256 FROM fx_records),
n AS (SELECT DISTINCT split FROM s)
SELECT a.split AS split_a, b.split AS split_b, count(x.state_sha256) AS shared
FROM n a JOIN n b ON a.split < b.split
LEFT JOIN (SELECT p.split AS pa, q.split AS pb, p.state_sha256 FROM s p JOIN s q ON q.state_sha256 = p.state_sha256 AND p.split < q.split) x
  ON x.pa = a.split AND x.pb = b.split GROUP BY a.split, b.split""")
def _d14(spark, d):
    return ops.overlap_matrix(records(spark, d).withColumn("split", F.col("pool")), ["test", "train", "validation"])


@query("d15_prior_hits", """
SELECT count(*) AS rows,
  count(*) FILTER (id IN (SELECT id FROM fx_prior WHERE kind = 'eval') OR state_sha256 IN (SELECT state_sha256 FROM fx_prior WHERE kind = 'eval')) AS prior_eval_hits,
  count(*) FILTER (id IN (SELECT id FROM fx_prior WHERE kind = 'train')) AS reused FROM fx_records""")
def _d15(spark, d):
    recs = records(spark, d)
    return ops.prior_hits(recs, prior(recs))


@query("d16_state_overlap", """
WITH n AS (SELECT id, doc_id, state_sha256, sha256(trim(regexp_replace(lower(nfc_normalize(state)), '\\s+', ' ', 'g'))) AS norm FROM fx_records),
p AS (SELECT p.file, n.* FROM fx_prior p JOIN n ON n.id = p.id)
SELECT file, match, count(*) AS matches FROM (
  SELECT DISTINCT p.file, n.id, 'exact' AS match FROM n JOIN p ON p.state_sha256 = n.state_sha256
  UNION ALL SELECT DISTINCT p.file, n.id, 'normalized' FROM n JOIN p ON p.norm = n.norm) GROUP BY file, match""")
def _d16(spark, d):
    recs = records(spark, d).withColumn("normalized_state_sha256", F.sha2(normalized_state(F.col("state")), 256))
    earlier = prior(recs).join(recs.select("id", "normalized_state_sha256"), "id")
    return ops.state_overlap(recs, earlier).groupBy("file", "match").agg(F.count(F.lit(1)).alias("matches"))


# --- samples -------------------------------------------------------------------------------------------------

@query("d17_prefix_sample", """
SELECT source, id, rank FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM fx_take WHERE rank <= 12) WHERE rank <= round_even(n / 3, 0)""")
def _d17(spark, d):
    recs = records(spark, d)
    return ops.prefix_sample(ops.take_k(recs, 12, SEED, "test", exclude=prior(recs)), 1 / 3).select("source", "id", "rank")


@query("d18_sample_per_group", f"""
SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|speed|' || id), id) AS rn FROM fx_records) WHERE rn <= 20""")
def _d18(spark, d):
    return ops.sample_per_group(records(spark, d), ["source"], 20, SEED, "speed").select("source", "id")


@query("d18_first_per_group", "SELECT source, min(doc_id) AS doc_id, 'doc/' || min(doc_id) AS id FROM fx_records GROUP BY source")
def _d18_first(spark, d):
    return ops.first_per_group(records(spark, d), ["source"], "doc_id")


@query("d19_length_filters", "SELECT id, length(state) AS chars FROM fx_records WHERE length(state) <= 7600")
def _d19(spark, d):
    return ops.length_filter(records(spark, d), F.col("state"), 7600).select("id", F.char_length("state").cast("bigint").alias("chars"))


def _budget(spark, d):
    rows = records(spark, d).select("id", "source", F.col("state").alias("prompt"), (F.col("doc_id") % 3 == 0).alias("is_synthetic"))
    return ops.token_budget(rows, lambda c: F.size(words(c)), 600)


_TOKENS = """WITH t AS (SELECT id, source, doc_id % 3 = 0 AS synthetic, len(regexp_extract_all(lower(state), '[a-z0-9]+')) AS tokens FROM fx_records)"""


@query("d20_token_budget", _TOKENS + """
SELECT count(*) AS prepared, coalesce(sum(tokens) FILTER (synthetic), 0)::BIGINT AS synthetic, coalesce(sum(tokens) FILTER (NOT synthetic), 0)::BIGINT AS natural,
  round(coalesce(sum(tokens) FILTER (synthetic), 0) / greatest(1, sum(tokens)), 6) AS synthetic_share,
  coalesce(sum(tokens) FILTER (synthetic), 0) / greatest(1, sum(tokens)) BETWEEN 0.32 AND 0.38 AS passed FROM t WHERE tokens <= 600""")
def _d20(spark, d):
    return _budget(spark, d)[2].withColumn("synthetic_share", r6("synthetic_share"))


@query("d20_over_budget", _TOKENS + "SELECT id, source, tokens FROM t WHERE tokens > 600")
def _d20_over(spark, d):
    return _budget(spark, d)[1]


@query("d21_exposure_summary", f"""
WITH p AS (SELECT r.id || '/p' || v AS id, r.id AS record_id, source, state_sha256, length(state) AS tokens FROM fx_records r, unnest([0, 1]) AS u(v)),
f AS (SELECT * FROM p ORDER BY sha256('{SEED}|order|' || id), id LIMIT 300)
SELECT source, source IS NULL AS overall, count(*) AS prompts, count(DISTINCT record_id) AS unique_records, count(DISTINCT state_sha256) AS unique_states,
  sum(tokens)::BIGINT AS tokens, min(tokens) AS minimum_tokens, max(tokens) AS maximum_tokens FROM f GROUP BY GROUPING SETS ((source), ())""")
def _d21(spark, d):
    prompts = records(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).select(
        F.concat(F.col("id"), F.lit("/p"), F.col("v").cast("string")).alias("id"), F.col("id").alias("record_id"), "source", "state_sha256",
        F.char_length("state").cast("bigint").alias("tokens"),
    ).withColumn("h", seeded_order(SEED, "order", "id"))
    return ops.exposure_summary(prompts, 300, "h")


@query("d23_missing_ids", """
SELECT id, 'missing' AS problem FROM fx_take WHERE rank <= 12 AND id NOT IN (SELECT 'doc/' || doc_id FROM labels)
UNION ALL SELECT 'doc/' || doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1""")
def _d23(spark, d):
    recs = records(spark, d)
    hosted = table(spark, d, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"))
    return ops.missing_ids(ops.take_k(recs, 12, SEED, "test", exclude=prior(recs)), hosted)


# --- helpers worth checking on whole tables ------------------------------------------------------------------

@query("x21_seeded_bucket", f"""
SELECT id, {' + '.join(f"(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT % 5) * {pow(2, 32 * (7 - i), 5)}" for i in range(8))} AS raw FROM (
  SELECT id, sha256('{SEED}|' || id) AS h FROM fx_records)""".replace("AS raw", "").replace("SELECT id, ", "SELECT id, (", 1).replace(" FROM (", ") % 5 AS bucket FROM (", 1))
def _x21(spark, d):
    return records(spark, d).select("id", seeded_bucket(F.concat(F.lit(SEED + "|"), F.col("id")), 5).cast("bigint").alias("bucket"))


@query("x22_seeded_order", f"SELECT id, row_number() OVER (ORDER BY sha256('{SEED}|order|' || id), id) AS rank FROM fx_records")
def _x22(spark, d):
    keys = records(spark, d).select("id", F.lit(0).alias("_one"), seeded_order(SEED, "order", "id").alias("h"))
    return ranked(keys, ["_one"], "h", "id").select("id", "rank")


@query("x01_digest", "SELECT id, sha256(to_json(state)::VARCHAR) AS digest FROM fx_records")
def _x01(spark, d):
    return records(spark, d).select("id", digest(F.col("state")).alias("digest"))
