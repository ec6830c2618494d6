"""Queries: converters, requests, licenses, planted errors, prompts and context probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.hashing import seeded_bucket
from weighbridge.functions.text import card_license, prompt_text, words
from weighbridge.operators import converters as conv
from weighbridge.operators import licenses as lic
from weighbridge.operators import planted_errors as planted
from weighbridge.operators import prompts
from weighbridge.operators import requests as req
from weighbridge.operators import scoring
from weighbridge.operators.readout import regroup_answers
from weighbridge.plans.fixtures import SEED, decisions, r6, records, run, source_order, table
from weighbridge.plans.registry import query, view
from weighbridge.plans.scoring_queries import chunked, rounded

# --- ratings -------------------------------------------------------------------------------------------------

ATTRIBUTES = ("helpfulness", "correctness", "coherence", "complexity", "verbosity")
SCALES = {a: (f"Rate the {a}.", [f"{a} {i}" for i in range(5)]) for a in ATTRIBUTES}


def ratings(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("row"), F.when(k % 10 == 0, "validation").otherwise("train").alias("split"), F.col("p_type").alias("prompt"), F.col("p_name").alias("response"),
        (F.col("p_size") % 6).cast("double").alias("helpfulness"), (F.floor("p_retailprice") % 5).cast("double").alias("correctness"),
        (F.char_length("p_name") % 5).cast("double").alias("coherence"), (k % 9 / 2).cast("double").alias("complexity"), (k % 5).cast("double").alias("verbosity"),
    )


view("fx_rating", """
SELECT p_partkey AS row, CASE WHEN p_partkey % 10 = 0 THEN 'validation' ELSE 'train' END AS split, p_type AS prompt, p_name AS response,
  (p_size % 6)::DOUBLE AS helpfulness, (floor(p_retailprice)::BIGINT % 5)::DOUBLE AS correctness, (length(p_name) % 5)::DOUBLE AS coherence,
  (p_partkey % 9) / 2 AS complexity, (p_partkey % 5)::DOUBLE AS verbosity FROM part""")
view("fx_rating_long", "SELECT * FROM (UNPIVOT fx_rating ON helpfulness, correctness, coherence, complexity, verbosity INTO NAME attribute VALUE value)")


@query("c01_convert_rating", """
SELECT 'rated/' || split || '/' || row || '/' || attribute AS id, split, attribute, (value::INT)::VARCHAR AS label,
  sha256(to_json({'prompt': prompt, 'response': response})::VARCHAR) AS state_sha256
FROM fx_rating_long WHERE value = floor(value) AND value BETWEEN 0 AND 4""")
def _c01(spark, d):
    return conv.convert_rating(ratings(spark, d), SCALES, "rated")[0].select("id", "split", "attribute", "label", "state_sha256")


@query("c01_rating_quarantine", "SELECT 'rated/' || split || '/' || row || '/' || attribute AS id, 'invalid rating' AS reason FROM fx_rating_long WHERE NOT (value = floor(value) AND value BETWEEN 0 AND 4)")
def _c01_bad(spark, d):
    return conv.convert_rating(ratings(spark, d), SCALES, "rated")[1].select("id", "reason")


def hex_mod_sql(h: str, k: int) -> str:
    return "((" + " + ".join(f"(('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT % {k}) * {pow(2, 32 * (7 - i), k)}" for i in range(8)) + f") % {k})"


@query("c02_one_attribute_per_row", f"""
WITH p AS (SELECT *, ['helpfulness', 'correctness', 'coherence', 'complexity', 'verbosity'][1 + {hex_mod_sql('h', 5)}] AS pick FROM (
  SELECT *, sha256('{SEED}|rated|' || split || '|' || row) AS h FROM fx_rating_long))
SELECT 'rated/' || split || '/' || row || '/' || attribute AS id, (value::INT)::VARCHAR AS label FROM p WHERE attribute = pick AND value = floor(value) AND value BETWEEN 0 AND 4""")
def _c02(spark, d):
    rows = conv.one_attribute(ratings(spark, d), ATTRIBUTES, SEED, "rated")
    return conv.convert_rating(rows, SCALES, "rated", "attribute")[0].select("id", "label")


@query("c11_held_out_quarter", f"""
WITH c AS (SELECT 'rated/' || split || '/' || row || '/verbosity' AS id, split, row, sha256(to_json({{'prompt': prompt, 'response': response}})::VARCHAR) AS s FROM fx_rating),
u AS (SELECT DISTINCT s FROM c WHERE row % 50 = 7)
SELECT id, CASE WHEN s NOT IN (SELECT s FROM u) AND (split = 'validation' OR {hex_mod_sql('s', 4)} = 0) THEN 'validation' WHEN split = 'train' THEN 'train' ELSE 'used' END AS pool FROM c""")
def _c11(spark, d):
    rows = conv.convert_rating(ratings(spark, d), {"verbosity": SCALES["verbosity"]}, "rated")[0]
    used = rows.filter(F.element_at(F.split("id", "/"), 3).cast("bigint") % 50 == 7)
    return conv.held_out_share(rows, used).select("id", "pool")


# --- options and blanks --------------------------------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEG = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"


@query("c03_convert_multichoice", f"""
SELECT 'segments/train/' || c_custkey AS id, c_mktsegment AS label FROM customer
WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND list_contains({_SEG}, c_mktsegment)""")
def _c03(spark, d):
    k = F.col("c_custkey")
    segs = F.array(*[F.lit(s) for s in SEGMENTS])
    choices = F.transform(segs, lambda s, i: F.struct(F.substr(F.lit("ABCDE"), i + 1, F.lit(1)).alias("label"), F.when((k % 11 == 0) & (i == 4), F.lit("AUTOMOBILE")).otherwise(s).alias("text")))
    at = F.array_position(segs, F.col("c_mktsegment")).cast("int")
    rows = table(spark, d, "customer").select(
        k.alias("row"), F.lit("train").alias("split"), k.cast("string").alias("upstream_id"), F.concat(F.lit("Segment of "), F.col("c_name")).alias("question"),
        F.when(k % 13 == 0, "Z").otherwise(F.substr(F.lit("ABCDE"), at, F.lit(1))).alias("answer_key"), choices.alias("choices"))
    return conv.convert_multichoice(rows, "segments", "Which segment?")[0].select("id", "label")


@query("c04_convert_blank", """
SELECT 'blank/train/' || p_partkey AS id, 'option' || (1 + p_partkey % 2) AS label FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 12 <> 0""")
def _c04(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("row"), F.lit("train").alias("split"), F.concat(F.lit("The _ is a "), F.col("p_name"), F.when(k % 9 == 0, " _").otherwise("")).alias("sentence"),
        F.lit("thing").alias("option1"), F.when(k % 10 == 0, "thing").otherwise("person").alias("option2"), F.when(k % 12 == 0, "3").otherwise((1 + k % 2).cast("string")).alias("answer"))
    return conv.convert_blank(rows, "blank", "Which option fills the blank?")[0].select("id", "label")


@query("c05_convert_spatial", """
SELECT 'spatial/' || vec_id AS id, 'f' || (vec_id % 3) AS family, (vec_id % 4)::VARCHAR AS label FROM embeddings WHERE vec_id % 31 <> 0 AND vec_id % 29 <> 0 AND vec_id % 23 <> 0""")
def _c05(spark, d):
    v = F.col("vec_id")
    mass = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    share = F.transform(mass, lambda x: x / F.aggregate(mass, F.lit(0.0), lambda a, y: a + y) * F.when(v % 31 == 0, 1.1).otherwise(1.0))
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("o"), F.when(v % 29 == 0, F.lit(0)).otherwise(i).cast("string")))
    rows = table(spark, d, "embeddings").select(
        v.cast("string").alias("upstream_id"), F.concat(F.lit("f"), (v % 3).cast("string")).alias("family"), F.concat(F.lit("Scene "), v.cast("string")).alias("state"),
        F.lit("Where?").alias("instructions"), options.alias("options"), (v % 4).cast("int").alias("answer_index"),
        F.concat(F.lit("o"), F.when(v % 23 == 0, (v + 1) % 4).otherwise(v % 4).cast("string")).alias("answer"), share.alias("answer_distribution"),
        (v % 2 == 0).alias("deterministic"), (v % 7 == 0).alias("seen_in_training"))
    return conv.convert_spatial(rows, "spatial")[0].select("id", "family", "label")


# --- scenarios and tasks -------------------------------------------------------------------------------------

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("c06_convert_scenarios", """
SELECT 'scenes/medium/' || o_orderkey || '/' || q AS id, o_orderkey::VARCHAR AS "group",
  CASE q WHEN 'open' THEN (o_orderstatus = 'O')::INT::VARCHAR WHEN 'status' THEN o_orderstatus ELSE (o_orderkey % 3)::VARCHAR END AS label,
  CASE q WHEN 'open' THEN 'noul' WHEN 'status' THEN 'choice' ELSE 'score' END AS primitive,
  CASE q WHEN 'open' THEN '' WHEN 'status' THEN 'P,O,F' ELSE '0,1,2' END AS keys
FROM orders, unnest(['open', 'status', 'urgency']) AS u(q) WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0""")
def _c06(spark, d):
    k = F.col("o_orderkey")
    questions = F.when(k % 17 == 0, F.lit('{"open": {"type": "noul", "instructions": "Open?"}}')).otherwise(F.lit(
        '{"open": {"type": "noul", "instructions": "Open?"}, "status": {"type": "choice", "instructions": "Which?", "criteria": {"P": null, "O": "open", "F": "filled"}},'
        ' "urgency": {"type": "score", "instructions": "How urgent?", "criteria": ["low", "middle", "high"]}}'))
    is_open = F.when(F.col("o_orderstatus") == "O", "true").otherwise("false")
    answers = F.concat(F.lit('{"open": '), F.when(k % 19 == 0, F.concat(F.lit('"'), is_open, F.lit('"'))).otherwise(is_open), F.lit(', "status": "'), F.col("o_orderstatus"),
                       F.lit('", "urgency": '), (k % 3).cast("string"), F.lit("}"))
    rows = table(spark, d, "orders", "o_orderkey").select(
        k.cast("string").alias("upstream_id"), F.col("o_orderpriority").alias("family"), F.lit(3).alias("n_questions"),
        F.to_json(F.struct(k.alias("order"), F.col("o_totalprice").alias("total"))).alias("state"), questions.alias("questions"), answers.alias("answers"))
    out = conv.convert_scenarios(rows, "scenes", "medium")[0]
    return out.select("id", "group", "label", "primitive", F.array_join(F.transform("question.options", lambda o: o["key"]), ",").alias("keys"))


@query("c07_convert_tasks", f"""
SELECT 'tasks/' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE 'n' || c_nationkey END AS "group",
  CASE WHEN c_custkey % 2 = 0 THEN (c_acctbal > 0)::INT::VARCHAR ELSE c_mktsegment END AS label
FROM customer WHERE c_custkey % 37 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 41 <> 0) AND (c_custkey % 2 = 0 OR list_contains({_SEG}, c_mktsegment))""")
def _c07(spark, d):
    k = F.col("c_custkey")
    even = k % 2 == 0
    segs = F.array(*[F.lit(s) for s in SEGMENTS])
    named = F.transform(segs, lambda s: F.struct(s.alias("key"), F.lit(None).cast("string").alias("description")))
    rows = table(spark, d, "customer").select(
        k.cast("string").alias("upstream_id"), F.when(k % 3 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("group"), F.lit("f").alias("family"),
        F.col("c_name").alias("state"), F.when(even, F.when(F.col("c_acctbal") > 0, "yes").otherwise("no")).otherwise(F.col("c_mktsegment")).alias("expected"),
        F.when(even, F.array(F.lit("yes"), F.lit("no"))).when(k % 41 == 0, F.slice(segs, 1, 3)).otherwise(F.reverse(segs)).alias("labels"),
        conv.question(F.when(even, "noul").otherwise("choice"), "Positive balance, or which segment?", F.when(even, F.array().cast(conv.OPTION_TYPE)).otherwise(named)).alias("question"),
        F.when(k % 37 == 0, "ambiguous").alias("exclude_reason"))
    return conv.convert_tasks(rows, "tasks", "easy")[0].select("id", "group", "label")


@query("c08_convert_hosted_predictions", """
SELECT source, count(*) AS n, count(*) FILTER (NOT (vec_id % 59 = 0 OR vec_id % 41 = 0)) AS valid, sum(correct)::BIGINT AS correct, round(avg(nll) FILTER (NOT (vec_id % 59 = 0 OR vec_id % 41 = 0)), 6) AS nll
FROM fx_scored_new WHERE vec_id % 4 <> 3 GROUP BY source""")
def _c08(spark, d):
    recs = decisions(spark, d)
    chosen = recs.filter(F.col("vec_id") % 4 != 3)
    # The hosted table rounds nothing but scales its shares to percentages of a slightly wrong total.
    off = F.transform_values(F.col("answer.probabilities"), lambda _, p: p * 0.98)
    hosted = run(recs, "new").join(recs.select("id", "primitive"), "id").select(
        "id", "primitive", F.col("answer.noul").alias("p_yes"), off.alias("probabilities"),
        F.coalesce(F.col("answer.choice"), F.col("answer.score").cast("string")).alias("answer"), F.col("answer.confidence").alias("confidence"), "error", "latency_ms")
    s = scoring.score_records(chosen.drop("e", "k"), conv.convert_hosted(hosted, chosen), allow_rounding=True)
    return rounded(scoring.summarize_by(s, "source").select("source", "n", "valid", "correct", "nll"))


# --- worked solutions ----------------------------------------------------------------------------------------

def solutions(spark, d) -> DataFrame:
    """Two-step arithmetic from every order line: quantity times size, plus the line number."""
    q, s, n = F.col("l_quantity").cast("bigint"), F.col("p_size").cast("bigint"), F.col("l_linenumber").cast("bigint")
    x, y = q * s, q * s + n
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    # The four keys repeat now and then; with the quantity a line is unique.
    key = F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "suppkey")], q.cast("string"))
    return table(spark, d, "lineitem", "l_orderkey").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("train").alias("split"), key.alias("row"), t("A box holds ", q, " packs of ", s, " parts and ", n, " spare parts. How many parts?").alias("question"),
        t("The packs hold ", q, "*", s, "=<<", q, "*", s, "=", x, ">>", x, " parts.\nIn total ", x, "+", n, "=<<", x, "+", n, "=", y, ">>", y, " parts.\n#### ", y).alias("answer"))


_VARIANT = f"""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS row, l_quantity::BIGINT AS q, p_size::BIGINT AS s, l_linenumber::BIGINT AS n,
  {hex_mod_sql(f"sha256('{SEED}|worked|train|' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT)", 6)} AS six FROM lineitem JOIN part ON p_partkey = l_partkey"""
view("fx_worked", f"SELECT *, CASE WHEN six % 2 = 0 THEN 'gold' ELSE ['final_wrong', 'step_wrong', 'step_wrong_propagated'][1 + six // 2] END AS variant FROM ({_VARIANT})")


@query("c09_planted_errors")
def _c09(spark, d):
    return planted.planted_errors(solutions(spark, d), SEED).select("id", "variant", "label", "step", "reason", "state")


_SKIPPED = """CASE WHEN variant LIKE 'step%' AND q * s = q * s + n THEN 'every intermediate equals the final answer'
  WHEN variant LIKE 'step%' AND q * s IN (q, s, n) THEN 'step value appears in the problem' ELSE '' END"""


# In these two-step solutions a wrong final answer shows twice, a wrong step once, and a carried error in four places.
@query("c09_changed_numbers", f"""
SELECT row, variant, CASE variant WHEN 'gold' THEN '1' ELSE '0' END AS label, {_SKIPPED} AS reason,
  CASE WHEN {_SKIPPED} = '' THEN CASE variant WHEN 'gold' THEN 0 WHEN 'final_wrong' THEN 2 WHEN 'step_wrong' THEN 1 ELSE 4 END END AS changed FROM fx_worked""")
def _c09_changed(spark, d):
    judged = planted.planted_errors(solutions(spark, d), SEED, keep=["answer"])
    plain = F.concat(F.regexp_replace(F.substring_index("answer", "\n#### ", 1), planted.MARKUP, ""), F.lit("\nAnswer: "), F.substring_index("answer", "\n#### ", -1))
    both = judged.select("row", "variant", "label", "reason", plain.alias("plain"), F.get_json_object("state", "$.response").alias("response"))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(planted.NUMBER), F.lit(0))
    differ = F.filter(F.zip_with(numbers("plain"), numbers("response"), lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    # Equal texts have equal numbers.
    changed = F.when(F.col("plain") == F.col("response"), 0).otherwise(F.size(differ))
    return both.select("row", "variant", "label", F.coalesce("reason", F.lit("")).alias("reason"), F.when(F.col("reason").isNull(), changed).alias("changed"))


@query("c10_skip_report", f"SELECT variant, {_SKIPPED} AS reason, count(*) AS rows FROM fx_worked GROUP BY ALL")
def _c10(spark, d):
    return planted.skip_report(planted.planted_errors(solutions(spark, d), SEED))


# --- requests ------------------------------------------------------------------------------------------------

MODELS = ("judge-1",)
KINDS = 17


def requests(spark, d) -> DataFrame:
    """One JSON request per conversation turn; the kind decides which rule, if any, it breaks."""
    kind = (F.col("conv_id") * 3 + F.col("turn")) % KINDS
    q = lambda text: F.lit('{"a": ' + text + "}")
    noul = '{"type": "noul", "instructions": "Is it polite?", "criteria": {"true": "polite"}}'
    choice = '{"type": "choice", "instructions": "Which tone?", "criteria": {"warm": null, "cold": "distant", "flat": null}}'
    score = '{"type": "score", "instructions": {"ask": "How clear?"}, "criteria": ["not", "hardly", "partly", "mostly", "fully"]}'
    wide = F.concat(F.lit('{"a": ' + noul + ', "b": {"type": "choice", "instructions": "Which?", "criteria": {'), F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": null'))), ", "), F.lit("}}}"))
    questions = (
        F.when(kind == 0, q(noul)).when(kind == 1, F.lit('{"a": ' + noul + ', "b": ' + choice + "}")).when(kind == 2, q(score)).when(kind == 4, q('{"type": "score", "instructions": "x", "criteria": ["one"]}'))
        .when(kind == 5, q('{"type": "choice", "instructions": "x", "criteria": {}}')).when(kind == 6, q('{"type": "noul", "instructions": "x", "criteria": {"maybe": "y"}}'))
        .when(kind == 7, q('{"type": "rank", "instructions": "x"}')).when(kind == 8, q('{"type": "noul"}')).when(kind == 11, wide)
        .when(kind == 12, q('{"type": "choice", "instructions": "x", "criteria": {"k": 5, "l": null}}')).when(kind == 13, q('{"type": "score", "instructions": "x", "criteria": ["a", null]}'))
        .when(kind == 14, q('{"type": "score", "instructions": "x", "criteria": ["a", ["b"], 3]}')).when(kind == 15, q('{"type": "noul", "instructions": "x", "criteria": {"true": null}}'))
        .when(kind == 16, q('{"type": "choice", "instructions": ["x"], "criteria": {"k": {"deep": [1, null]}, "l": ["y"], "m": null}}')).otherwise(q(noul))
    )
    text = F.to_json(F.struct("text"))
    state = F.when(kind == 9, F.lit('{"image": "data:image/png;base64,AAAA"}')).otherwise(text)
    model = F.when(kind == 10, "other-9").otherwise("judge-1")
    extra = F.when(kind == 3, ', "stream": true').otherwise("")
    body = F.concat(F.lit('{"model": "'), model, F.lit('", "state": '), state, F.lit(', "questions": '), questions, extra, F.lit("}"))
    return table(spark, d, "conversations").select(F.concat_ws("/", F.lit("r"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), body.alias("body"))


view("fx_requests", f"SELECT 'r/' || conv_id || '/' || turn AS request_id, (conv_id * 3 + turn) % {KINDS} AS kind, text FROM conversations")
_REASON = """CASE kind WHEN 3 THEN 'unknown request key' WHEN 4 THEN 'score needs 2 to 10 levels' WHEN 5 THEN 'choice needs 1 to 255 options' WHEN 6 THEN 'noul criteria keys must be true or false'
  WHEN 7 THEN 'unknown question type' WHEN 8 THEN 'instructions missing or of the wrong type' WHEN 9 THEN 'image input is not supported' WHEN 10 THEN 'unknown model'
  WHEN 11 THEN 'choice needs 1 to 255 options' WHEN 12 THEN 'descriptions of the wrong type' WHEN 13 THEN 'descriptions of the wrong type'
  WHEN 14 THEN 'descriptions of the wrong type' WHEN 15 THEN 'descriptions of the wrong type' ELSE '' END"""


@query("c12_validate_requests", f"SELECT request_id, {_REASON} AS reasons FROM fx_requests")
def _c12(spark, d):
    return req.validate_requests(requests(spark, d), MODELS).select("request_id", F.array_join("reasons", ";").alias("reasons"))


def valid_questions(spark, d) -> DataFrame:
    return req.explode_requests(req.validate_requests(requests(spark, d), MODELS).filter(F.size("reasons") == 0))


view("fx_questions", """
SELECT request_id, text, unnest(CASE kind WHEN 1 THEN ['a', 'b'] ELSE ['a'] END) AS question_key, kind FROM fx_requests WHERE kind IN (0, 1, 2, 16)""")


@query("c13_explode_requests", """
SELECT request_id, question_key, CASE WHEN kind = 2 THEN 'score' WHEN question_key = 'b' OR kind = 16 THEN 'choice' ELSE 'noul' END AS type,
  CASE WHEN kind = 2 THEN '0,1,2,3,4' WHEN kind = 16 THEN 'k,l,m' WHEN question_key = 'b' THEN 'warm,cold,flat' ELSE 'true' END AS keys FROM fx_questions""")
def _c13(spark, d):
    return valid_questions(spark, d).select("request_id", "question_key", F.col("question.type").alias("type"), F.array_join(F.transform("question.options", lambda o: o["key"]), ",").alias("keys"))


@query("c13_regroup_answers", """
SELECT request_id, count(*) AS questions, sum(length(question_key) + length(text))::BIGINT AS input_tokens FROM fx_questions GROUP BY request_id""")
def _c13_back(spark, d):
    # A stand-in scorer: the token count is the length of key and text.
    length = F.char_length(F.get_json_object("state", "$.text")) + F.char_length("question_key")
    answered = valid_questions(spark, d).withColumns({"answer": F.struct(F.lit(0.5).alias("noul")), "traces": F.array(F.struct(length.alias("input_tokens")))})
    return regroup_answers(answered).select("request_id", "questions", "input_tokens")


# --- probes --------------------------------------------------------------------------------------------------

def probes(spark, d) -> DataFrame:
    docs = records(spark, d).select("id", F.col("state").alias("text"))
    return conv.context_probes(docs, SEED)


_COLOR = f"['amber', 'teal', 'violet', 'silver'][1 + {hex_mod_sql('h', 4)}]"
view("fx_probes", f"""
SELECT 'probe/' || id || '/' || position AS id, CASE WHEN n <= 512 THEN 512 WHEN n <= 4096 THEN 4096 WHEN n <= 8192 THEN 8192 WHEN n <= 15000 THEN 15000 END AS target, position::DOUBLE AS position,
  {_COLOR} AS label, w, round_even(n * position::DOUBLE, 0)::BIGINT AS before
FROM (SELECT r.id, u.position, string_split(state, ' ') AS w, len(string_split(state, ' ')) AS n, sha256('{SEED}|probe|' || r.id || '|' || u.position) AS h
      FROM fx_records r, unnest(['0.0', '0.5', '1.0']) AS u(position))""")


@query("c14_context_probes", """
SELECT id, target, position, label, md5(array_to_string(list_concat(list_concat(w[1:before], ['Audit entry: the access color for room K17 is ' || label || '.']), w[before + 1:]), ' ')) AS state_md5 FROM fx_probes""")
def _c14(spark, d):
    return probes(spark, d).select("id", "target", "position", "label", F.md5("state").alias("state_md5"))


@query("e15_probe_summary", f"""
SELECT target, position, count(*) AS n, count(*) FILTER ({hex_mod_sql("sha256(id)", 3)} > 0) AS correct, grouping(target) = 1 AS all_sizes, grouping(position) = 1 AS all_positions
FROM fx_probes GROUP BY CUBE (target, position)""")
def _e15(spark, d):
    # A stand-in scorer that is right two times in three, by a hash of the id.
    judged = probes(spark, d).withColumn("correct", seeded_bucket(F.col("id"), 3) > 0)
    return scoring.probe_summary(judged).withColumns({c: F.col(c).cast("boolean") for c in ("all_sizes", "all_positions")})


# --- licenses ------------------------------------------------------------------------------------------------

_PHRASES = {"MIT License": "mit", "Apache License": "apache-2.0", "GNU General Public License": "gpl-3.0", "CC BY-NC": "cc-by-nc-4.0"}


def registry(spark, d) -> DataFrame:
    """Sources with a card that states the licenses found in their documents; some bring evidence instead."""
    recs = records(spark, d)
    has = [F.max(F.contains("state", F.lit(p))).alias(f"_{i}") for i, p in enumerate(_PHRASES)]
    per = recs.groupBy("source").agg(*has).join(source_order(recs), "source")
    stated = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(v)) for i, v in enumerate(_PHRASES.values())]))
    listed = F.concat(F.lit("---\nlicense:\n"), F.array_join(F.transform(stated, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n---\nCard"))
    single = F.concat(F.lit('---\nname: x\nlicense: "'), F.upper(F.element_at(stated, 1)), F.lit('"\n---\nCard'))
    card = F.when(F.size(stated) == 1, single).when(F.size(stated) > 1, listed).otherwise(F.lit("No front matter"))
    return per.select(
        "source", F.when(F.col("seq") % 5 == 0, "ood").when(F.col("seq") % 7 == 0, "excluded").otherwise("fit").alias("role"), F.when(F.size(stated) == 0, card).otherwise(card).alias("card"),
        F.when(F.col("seq") % 3 == 0, F.array(F.lit(True), F.col("seq") % 2 == 0)).alias("evidence"))


view("fx_licenses", """
SELECT r.source, o.seq, CASE WHEN o.seq % 5 = 0 THEN 'ood' WHEN o.seq % 7 = 0 THEN 'excluded' ELSE 'fit' END AS role,
  list_filter([CASE WHEN bool_or(contains(state, 'MIT License')) THEN 'mit' END, CASE WHEN bool_or(contains(state, 'Apache License')) THEN 'apache-2.0' END,
   CASE WHEN bool_or(contains(state, 'GNU General Public License')) THEN 'gpl-3.0' END, CASE WHEN bool_or(contains(state, 'CC BY-NC')) THEN 'cc-by-nc-4.0' END], lambda x: x IS NOT NULL) AS stated,
  o.seq % 3 = 0 AS has_evidence, o.seq % 6 = 0 AS found
FROM fx_records r JOIN fx_order o ON o.source = r.source GROUP BY r.source, o.seq""")
_CLEARED = """CASE WHEN role = 'fit' THEN (len(stated) > 0 AND len(list_filter(stated, lambda x: x NOT IN ('mit', 'apache-2.0'))) = 0) OR (len(stated) = 0 AND has_evidence AND found)
  WHEN role = 'excluded' AND has_evidence THEN found END"""


@query("c16_license_gate", f"SELECT source, role, array_to_string(stated, ',') AS stated, {_CLEARED} AS cleared FROM fx_licenses")
def _c16(spark, d):
    return lic.license_gate(registry(spark, d)).select("source", "role", F.array_join("stated", ",").alias("stated"), "cleared")


@query("c16_blocked_sources", f"SELECT source FROM fx_licenses WHERE role = 'fit' AND NOT coalesce({_CLEARED}, false)")
def _c16_blocked(spark, d):
    return lic.blocked_sources(lic.license_gate(registry(spark, d)))


@query("x19_card_license", "SELECT source, array_to_string(stated, ',') AS stated FROM fx_licenses")
def _x19(spark, d):
    return registry(spark, d).select("source", F.array_join(card_license(F.col("card")), ",").alias("stated"))


@query("c15_registry_check", """
SELECT source, 'only first' AS "where" FROM fx_order WHERE seq % 4 = 0 UNION ALL SELECT source || '-new', 'only second' FROM fx_order WHERE seq % 6 = 0""")
def _c15(spark, d):
    order = source_order(records(spark, d))
    other = order.filter(F.col("seq") % 4 != 0).select("source").unionByName(order.filter(F.col("seq") % 6 == 0).select(F.concat("source", F.lit("-new")).alias("source")))
    return lic.registry_check(order.select("source"), other)


@query("c17_allow_list", "SELECT source, count(*) AS rows FROM fx_records WHERE source IN (SELECT source FROM fx_order WHERE seq % 3 = 0) GROUP BY source")
def _c17(spark, d):
    recs = records(spark, d)
    return lic.allow_list_offenders(recs, source_order(recs).filter(F.col("seq") % 3 != 0))


# --- training prompts ----------------------------------------------------------------------------------------

def _prompt_rows(spark, d) -> DataFrame:
    base = decisions(spark, d).withColumn("state_sha256", F.col("input_sha256")).select("id", "source", "primitive", "state", "state_sha256", "question", "label", "soft")
    wide = chunked(spark, d).withColumn("state_sha256", F.col("input_sha256")).select("id", "source", "primitive", "state", "state_sha256", "question", "label").withColumn("soft", F.lit(None).cast("map<string,double>"))
    return base.unionByName(wide)


# Options in long form: key, its place after the shuffle, and what is kept of long lists.
view("fx_options", f"""
SELECT d.vec_id, 'v/' || d.vec_id AS id, v.variant, d.primitive, h.key AS raw, CASE WHEN d.primitive = 'noul' THEN CASE h.key WHEN '1' THEN 'yes' ELSE 'no' END ELSE h.key END AS key,
  d.label, CASE WHEN d.vec_id % 5 = 0 THEN h.h END AS h
FROM fx_decisions d JOIN fx_human h ON h.vec_id = d.vec_id, unnest([0, 1]) AS v(variant)""")
view("fx_prompts", f"""
SELECT id || '/p' || variant AS id, string_agg(key, ',' ORDER BY place) AS option_keys, max(place) FILTER (raw = label) - 1 AS hard_target,
  string_agg(round(coalesce(h, (raw = label)::INT), 4)::DECIMAL(8,4)::VARCHAR, ',' ORDER BY place) AS target
FROM (SELECT *, row_number() OVER (PARTITION BY id, variant ORDER BY sha256('{SEED}|' || id || '|' || variant || '|' || key)) AS place FROM fx_options) GROUP BY id, variant""")


@query("t01_build_prompts", "SELECT * FROM fx_prompts")
def _t01(spark, d):
    small = _prompt_rows(spark, d).filter(F.size("question.options") <= 52)
    built = prompts.build_prompts(small, SEED, 2)
    return built.select("id", F.array_join("option_keys", ",").alias("option_keys"), F.col("hard_target").cast("bigint").alias("hard_target"),
                        F.array_join(F.transform("target", lambda x: F.round(x, 4).cast("decimal(8,4)").cast("string")), ",").alias("target"))


_WIDE = f"""
WITH o AS (SELECT 'w/' || vec_id AS id, variant, 'k' || lpad(i::VARCHAR, 2, '0') AS key, 'k' || lpad((vec_id % 60)::VARCHAR, 2, '0') AS gold
           FROM fx_decisions, unnest([0, 1]) AS v(variant), unnest(range(0, 60)) AS u(i)),
s AS (SELECT *, [4, 8, 16, 32][1 + {hex_mod_sql(f"sha256('{SEED}|size|' || id || '|' || variant)", 4)}] AS size,
      row_number() OVER (PARTITION BY id, variant, key = gold ORDER BY sha256('{SEED}|sample|' || id || '|' || variant || '|' || key)) AS rn FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY id, variant ORDER BY sha256('{SEED}|' || id || '|' || variant || '|' || key)) AS place FROM s WHERE key = gold OR rn <= size - 1)
SELECT id || '/p' || variant AS id, count(*) AS options, string_agg(key, ',' ORDER BY place) AS option_keys, max(place) FILTER (key = gold) - 1 AS hard_target FROM k GROUP BY id, variant"""


@query("t02_option_subsample", _WIDE)
def _t02(spark, d):
    built = prompts.build_prompts(_prompt_rows(spark, d).filter(F.size("question.options") > 52), SEED, 2)
    return built.select("id", F.size("option_keys").cast("bigint").alias("options"), F.array_join("option_keys", ",").alias("option_keys"), F.col("hard_target").cast("bigint").alias("hard_target"))


@query("t03_soft_target", """
SELECT id || '/p' || variant AS id, round(max(coalesce(h, (raw = label)::INT)), 6) AS top, round(sum(coalesce(h, (raw = label)::INT)), 6) AS mass FROM fx_options GROUP BY id, variant""")
def _t03(spark, d):
    built = prompts.build_prompts(_prompt_rows(spark, d).filter(F.size("question.options") <= 52), SEED, 2)
    return built.select("id", r6(F.array_max("target")).alias("top"), r6(F.aggregate("target", F.lit(0.0), lambda a, x: a + x)).alias("mass"))


@query("t04_order_variants", f"""
SELECT id, row_number() OVER (ORDER BY sha256('{SEED}|order|' || id), id) AS place FROM (SELECT DISTINCT id || '/p' || variant AS id FROM fx_options)""")
def _t04(spark, d):
    from weighbridge.functions.hashing import seeded_order
    from weighbridge.operators.ranking import ranked

    rows = prompts.order_variants(decisions(spark, d).select("id"), 2).select(F.concat("id", F.lit("/p"), F.col("variant").cast("string")).alias("id"))
    keys = rows.select("id", F.lit(0).alias("_one"), seeded_order(SEED, "order", "id").alias("h"))
    return ranked(keys, ["_one"], "h", "id").select("id", F.col("rank").alias("place"))


@query("t05_shuffled_pairs", f"""
WITH c AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY sha256('{SEED}|shuffle|' || id), id) AS rn FROM fx_decisions WHERE primitive = 'choice') WHERE rn <= 200),
p AS (SELECT c.id, string_agg('c' || i, ',' ORDER BY sha256('{SEED}|order|' || c.id || '|c' || i)) AS keys FROM c, unnest(range(0, 10)) AS u(i) GROUP BY c.id)
SELECT id, CASE WHEN keys = 'c0,c1,c2,c3,c4,c5,c6,c7,c8,c9' THEN 'c1,c2,c3,c4,c5,c6,c7,c8,c9,c0' ELSE keys END AS keys FROM p""")
def _t05(spark, d):
    pairs = prompts.shuffled_pairs(decisions(spark, d), 200, SEED)
    return pairs.select("id", F.array_join(F.transform("question.options", lambda o: o["key"]), ",").alias("keys"))


_KEYS = "string_agg(key, ',' ORDER BY {o}) AS keys FROM (SELECT d.id, d.primitive, h.key, try_cast(right(h.key, 1) AS INT) AS i FROM fx_decisions d JOIN fx_human h ON h.vec_id = d.vec_id WHERE d.primitive <> 'noul') GROUP BY id"


@query("t06_reverse_options", "SELECT id, " + _KEYS.format(o="CASE primitive WHEN 'choice' THEN -i ELSE i END"))
def _t06(spark, d):
    out = prompts.reverse_options(decisions(spark, d)).filter(F.col("primitive") != "noul")
    return out.select("id", F.array_join(F.transform("question.options", lambda o: o["key"]), ",").alias("keys"))


@query("t07_canonical_options", "SELECT id, " + _KEYS.format(o="i"))
def _t07(spark, d):
    out = prompts.canonical_options(prompts.reverse_options(decisions(spark, d))).filter(F.col("primitive") != "noul")
    return out.select("id", F.array_join(F.transform("question.options", lambda o: o["key"]), ",").alias("keys"))


@query("x07_prompt_text", """
SELECT id, md5('<|im_start|>user' || chr(10) || 'State:' || chr(10) || state || chr(10) || chr(10) || 'Question: Good?' || chr(10) || 'Options:' || chr(10) || '[A] yes: It is.' || chr(10) || '[B] no: '
  || chr(10) || chr(10) || 'Answer with the letter of the best option only.<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS prompt_md5
FROM fx_records""")
def _x07(spark, d):
    options = F.array(F.struct(F.lit("yes").alias("key"), F.lit("It is.").alias("description")), F.struct(F.lit("no").alias("key"), F.lit(None).cast("string").alias("description")))
    return records(spark, d).select("id", F.md5(prompt_text(F.col("state"), F.lit("Good?"), options)).alias("prompt_md5"))


@query("x04_words", "SELECT id, len(regexp_extract_all(lower(state), '[a-z0-9]+')) AS words FROM fx_records")
def _x04(spark, d):
    return records(spark, d).select("id", F.size(words(F.col("state"))).cast("bigint").alias("words"))
