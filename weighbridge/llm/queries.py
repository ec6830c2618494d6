"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.llm import (bpe, decontaminate, importance, jaccard_join, language_id, near_dup, private_data, quality_classifier, quality_rules, quotations, repair,
                             secret_scan, shards)
from weighbridge.llm.flat import picked
from weighbridge.llm.registry import ORACLES, QUERIES, query, table

TOKENIZER = "byte_bpe_50k.json"

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    coder = bpe.ByteBPE(spark, tokenizer_path())
    docs = picked(table(spark, sf_dir, "documents"), "doc_id", "text")
    encoded = docs.select("doc_id", coder.encode("text").alias("ids"))
    decoded = encoded.withColumn("decoded", coder.decode("ids"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.quality_filter(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("reasons", ",").alias("reasons"))


@query("op7_shards")
def op7_shards(spark, sf_dir):
    dealt = shards.balanced_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_secrets")
def op8_secrets(spark, sf_dir):
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in secret_scan.KINDS], F.sha2(secret_scan.span_text("base"), 256).alias("base_sha256"),
                        secret_scan.span_text("spans").alias("spans"), "unread")


def remainder(n: int):
    """crc32 of the id as text, modulo n; a null id has remainder 0 of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(*language_id.training_sample(docs.filter(remainder(4) != 2)))
    out = language_id.predict(docs, net)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = remainder(5) != 0
    model = quality_classifier.train(docs.filter(learned), labels.filter(learned))
    return quality_classifier.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op1_near_duplicates")
def op1_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", "matched", "coverage", "changed")


# The key of a deployment is its secret; this one makes the query's result repeatable.
SURROGATE_KEY = b"surrogates of the registered query"


@query("op3_surrogates")
def op3_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_data.with_surrogates(docs, SURROGATE_KEY)


QUOTED = 3  # earlier turns that a message of the derived mailbox quotes


def mailbox(spark, sf_dir):
    """The conversations as a mailbox without thread headers: every turn quotes the turns before it, nested, re-spaced and introduced."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("m")).select(
        "conv_id", "turn", F.col("m.role").alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    out = turns.select("conv_id", "turn", "role", "text")
    for k in range(1, QUOTED + 1):
        earlier = turns.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("role").alias(f"r{k}"), F.col("text").alias(f"q{k}"))
        out = out.join(earlier, ["conv_id", "turn"], "left")
    # The attribution of level k stands on level k - 1, the passage on level k.
    part = lambda k: F.concat(F.lit("\n" + "> " * (k - 1)), F.initcap(f"r{k}"), F.lit(" wrote:\n"), F.regexp_replace(F.regexp_replace(f"q{k}", " ", "  "), "(?m)^", ">" * k + " "))
    body = F.concat(F.col("text"), *[F.coalesce(part(k), F.lit("")) for k in range(1, QUOTED + 1)])
    return out.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("message_id"), "role", body.alias("body"))


@query("op9_quotations", """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, conv_id * 100000 + turn AS id, (min({'t': text, 'r': role})).r AS role, coalesce((min({'t': text, 'r': role})).t, '') AS text
  FROM conversations GROUP BY conv_id, turn),
chain AS (
  SELECT a.id, a.role, a.text, b.id AS before, lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) AS n0,
    lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AS n1, lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) AS n2
  FROM turns a LEFT JOIN turns b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN turns c ON a.conv_id = c.conv_id AND a.turn = c.turn + 2),
f1 AS (SELECT n0, min(id) AS id FROM chain GROUP BY n0),
f2 AS (SELECT n0, n1, min(id) AS id FROM chain WHERE n1 IS NOT NULL GROUP BY n0, n1),
f3 AS (SELECT n0, n1, n2, min(id) AS id FROM chain WHERE n2 IS NOT NULL GROUP BY n0, n1, n2),
links AS (
  SELECT m.id, CASE WHEN p.n1 IS NULL THEN f1.id WHEN p.n2 IS NULL THEN f2.id ELSE f3.id END AS parent
  FROM chain m LEFT JOIN chain p ON p.id = m.before LEFT JOIN f1 ON f1.n0 = p.n0
  LEFT JOIN f2 ON f2.n0 = p.n0 AND f2.n1 = p.n1 LEFT JOIN f3 ON f3.n0 = p.n0 AND f3.n1 = p.n1 AND f3.n2 = p.n2),
walk AS (
  SELECT id, id AS root, 0 AS depth FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, w.root, w.depth + 1 FROM links l JOIN walk w ON l.parent = w.id)
SELECT w.id AS message_id, w.root AS conversation_id, l.parent AS parent_id, row_number() OVER (PARTITION BY w.root ORDER BY w.depth, w.id) - 1 AS position,
  w.depth, c.role, trim(c.text, E' \\n\\t') AS text
FROM walk w JOIN links l USING (id) JOIN chain c USING (id)
""")
def op9_quotations(spark, sf_dir):
    return quotations.link_quotations(mailbox(spark, sf_dir))


@query("op11_jaccard_join", r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT n, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: md5(array_to_string(w[k:k + 4], ' ')))) END AS s
  FROM docs),
rows AS (SELECT DISTINCT doc_id, s FROM sets WHERE doc_id IS NOT NULL AND len(s) > 0),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM rows),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS seen FROM rows
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce((SELECT min(seen) FROM reach r WHERE r.doc_id = sets.doc_id), doc_id) AS component_id FROM sets
""")
def op11_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op12_importance", r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
run AS (SELECT n, unnest(words) AS word FROM docs),
steps AS (
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, i::UBIGINT) AS c
    FROM range(256) t(i))),
buckets AS (
  SELECT word, xor(list_reduce(list_transform(range(0, length(hex(encode(word))) // 2), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::UBIGINT),
    lambda c, b: xor(c // 256, step[(xor(c, b) % 256)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT word FROM run UNION SELECT word FROM target), steps),
source AS (SELECT bucket, count(*) AS s FROM run JOIN buckets USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS ss, (SELECT coalesce(sum(t), 0) FROM wanted) AS tt),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g
  FROM source LEFT JOIN wanted USING (bucket), totals),
weights AS (SELECT n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM run JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY n),
scored AS (
  SELECT n, doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (n)),
placed AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (n)
""")
def op12_importance(spark, sf_dir):
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_repair")
def op13_repair(spark, sf_dir):
    return repair.repair_report(table(spark, sf_dir, "conversations"))
