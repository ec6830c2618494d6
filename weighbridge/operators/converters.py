"""Source rows to the common record schema. Rows that do not convert come back with a reason, never silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.hashing import seeded_bucket
from weighbridge.functions.probability import finite, total
from weighbridge.functions.text import canonical_json, digest, normalized_state

OPTION_TYPE = "array<struct<key:string,description:string>>"


def question(kind, instructions, options: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), lit(instructions).alias("instructions"), options.cast(OPTION_TYPE).alias("options"))


def finish(df: DataFrame, normalized: bool = False) -> DataFrame:
    """Add the identity hashes: of the state, and of the pair of state and question."""
    pair = F.concat(F.lit("["), canonical_json(F.col("state")), F.lit(","), F.to_json("question"), F.lit("]"))
    out = df.withColumns({"state_sha256": digest(F.col("state")), "input_sha256": F.sha2(pair, 256)})
    return out.withColumn("normalized_state_sha256", F.sha2(normalized_state(F.col("state")), 256)) if normalized else out


def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) by the `reason` column."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


def convert_rating(df: DataFrame, scales: dict[str, tuple[str, Sequence[str]]], source: str, attribute: str | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Rated responses to score records, one per attribute: wide columns become rows.

    df: row, split, prompt, response and one 0-4 column per attribute. With `attribute`, only the attribute that
    column names is used. A rating that is no integer in 0..4 is quarantined.
    """
    def one(name: str) -> Column:
        instructions, levels = scales[name]
        options = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.lit(text).alias("description")) for i, text in enumerate(levels)])
        return F.struct(F.lit(name).alias("attribute"), F.col(name).cast("double").alias("value"), question("score", instructions, options).alias("question"))

    long = df.select("row", "split", "prompt", "response", *([attribute] if attribute else []), F.explode(F.array(*[one(n) for n in scales])).alias("a"))
    if attribute:
        long = long.filter(F.col("a.attribute") == F.col(attribute))
    value = F.col("a.value")
    good = value.isNotNull() & (value == F.floor(value)) & value.between(0, 4)
    return parted(finish(long.select(
        F.concat_ws("/", F.lit(source), "split", F.col("row").cast("string"), F.col("a.attribute")).alias("id"), F.lit(source).alias("source"),
        F.lit("score").alias("primitive"), "split", F.to_json(F.struct("prompt", "response")).alias("state"), F.col("a.question").alias("question"),
        value.cast("int").cast("string").alias("label"), F.col("a.attribute").alias("attribute"),
        F.when(~F.coalesce(good, F.lit(False)), F.lit("invalid rating")).alias("reason"),
    )))


def one_attribute(df: DataFrame, attributes: Sequence[str], seed: str, source: str) -> DataFrame:
    """Add `attribute`: the one a hash of (seed, source, split, row) picks."""
    key = F.concat_ws("|", F.lit(seed), F.lit(source), F.col("split"), F.col("row").cast("string"))
    return df.withColumn("attribute", F.element_at(F.array(*[F.lit(a) for a in attributes]), seeded_bucket(key, len(attributes)) + 1))


def convert_multichoice(df: DataFrame, source: str, instructions: str) -> tuple[DataFrame, DataFrame]:
    """Lettered options to choice records whose keys are the option texts.

    df: row, split, upstream_id, question, answer_key, choices array<struct<label, text>>.
    """
    texts = F.transform("choices", lambda c: c["text"])
    at = F.array_position(F.transform("choices", lambda c: c["label"]), F.col("answer_key"))
    reason = F.when(F.coalesce(at, F.lit(0)) == 0, "missing answer").when(F.size(F.array_distinct(texts)) != F.size(texts), "duplicate option text")
    options = F.transform(texts, lambda t: F.struct(t.alias("key"), F.lit(None).cast("string").alias("description")))
    return parted(finish(df.select(
        F.concat_ws("/", F.lit(source), "split", "upstream_id").alias("id"), F.lit(source).alias("source"), F.lit("choice").alias("primitive"), "split",
        F.to_json(F.struct("question")).alias("state"), question("choice", instructions, options).alias("question"),
        F.try_element_at(texts, F.nullif(at, F.lit(0)).cast("int")).alias("label"), reason.alias("reason"),
    )))


def convert_blank(df: DataFrame, source: str, instructions: str) -> tuple[DataFrame, DataFrame]:
    """Fill-in-the-blank sentences: exactly one `_`, two different options, answer 1 or 2."""
    reason = (
        F.when(~F.coalesce(F.col("answer").isin("1", "2"), F.lit(False)), "no usable answer").when(F.col("option1") == F.col("option2"), "equal options")
        .when(F.regexp_count("sentence", F.lit("_")) != 1, "not exactly one blank")
    )
    options = F.array(*[F.struct(F.lit(o).alias("key"), F.col(o).alias("description")) for o in ("option1", "option2")])
    return parted(finish(df.select(
        F.concat_ws("/", F.lit(source), "split", F.col("row").cast("string")).alias("id"), F.lit(source).alias("source"), F.lit("choice").alias("primitive"),
        "split", F.to_json(F.struct("sentence")).alias("state"), question("choice", instructions, options).alias("question"),
        F.concat(F.lit("option"), F.col("answer")).alias("label"), reason.alias("reason"),
    )))


def convert_spatial(df: DataFrame, suite: str) -> tuple[DataFrame, DataFrame]:
    """Questions with a known answer distribution; options become index keys.

    df: upstream_id, family, state, instructions, options[], answer_index, answer, answer_distribution[],
    deterministic, seen_in_training.
    """
    o, q = F.col("options"), F.col("answer_distribution")
    bad = (
        (F.size(o) != F.size(q)) | (F.size(F.array_distinct(o)) != F.size(o)) | ~F.col("answer").eqNullSafe(F.try_element_at(o, F.col("answer_index") + 1))
        | ~F.forall(q, lambda x: finite(x) & (x >= 0) & (x <= 1)) | (F.abs(total(q) - 1) > 1e-8)
    )
    options = F.transform(o, lambda t, i: F.struct(i.cast("string").alias("key"), t.alias("description")))
    return parted(finish(df.select(
        F.concat_ws("/", F.lit(suite), "upstream_id").alias("id"), F.lit(suite).alias("suite"), F.lit("test").alias("subset"),
        F.lit(f"{suite}/test").alias("source"), "family", digest(F.col("state")).alias("group"), "state", F.lit("choice").alias("primitive"),
        question("choice", F.col("instructions"), options).alias("question"), F.col("answer_index").cast("string").alias("label"),
        q.alias("analytic"), "deterministic", "seen_in_training",
        F.when(F.coalesce(bad, F.lit(True)), F.lit("invalid options or distribution")).alias("reason"),
    )))


RAW_QUESTION = "struct<type:string,instructions:string,criteria:string>"


def parse_question(raw: Column) -> Column:
    """JSON question text to the question struct, options in their written order (never through a variant)."""
    def build(q: Column) -> Column:
        kind = q["type"]
        listed = F.transform(F.from_json(q["criteria"], "array<string>"), lambda t, i: F.struct(i.cast("string").alias("key"), t.alias("description")))
        named = F.transform(F.map_entries(F.from_json(q["criteria"], "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("description")))
        options = F.coalesce(F.when(kind == "score", listed).otherwise(named), F.array().cast(OPTION_TYPE))
        return question(kind, q["instructions"], options)

    return F.element_at(F.transform(F.array(F.from_json(raw, RAW_QUESTION)), build), 1)


def convert_scenarios(df: DataFrame, suite: str, subset: str) -> tuple[DataFrame, DataFrame]:
    """One scenario row with JSON state, questions and answers becomes one record per question.

    The question keys must be the answer keys and as many as declared; yes/no gold must be a JSON boolean. A
    scenario that fails is quarantined whole.
    """
    q = F.from_json("questions", "map<string,string>")
    a = F.from_json("answers", "map<string,variant>")
    rows = df.withColumns({"_q": q, "_a": a})
    keys = lambda c: F.array_sort(F.map_keys(c))
    uneven = (keys("_q") != keys("_a")) | (F.size(F.col("_q")) != F.col("n_questions"))
    is_noul = lambda raw: F.get_json_object(raw, "$.type") == "noul"
    wrong_type = F.exists(F.map_entries("_q"), lambda e: is_noul(e["value"]) & (F.schema_of_variant(F.try_element_at(F.col("_a"), e["key"])) != "BOOLEAN"))
    rows = rows.withColumn("reason", F.when(F.coalesce(uneven, F.lit(True)), "question/answer inventory mismatch").when(wrong_type, "yes/no label is not boolean"))
    base = rows.filter(F.col("reason").isNull()).select("upstream_id", "family", "state", "_a", F.explode("_q").alias("key", "raw"))
    gold = F.element_at("_a", F.col("key"))
    label = F.when(is_noul(F.col("raw")), F.try_variant_get(gold, "$", "boolean").cast("int").cast("string")).otherwise(F.try_variant_get(gold, "$", "string"))
    records = base.select(
        F.concat_ws("/", F.lit(suite), F.lit(subset), "upstream_id", "key").alias("id"), F.lit(suite).alias("suite"), F.lit(subset).alias("subset"),
        F.lit(f"{suite}/{subset}").alias("source"), "family", F.col("upstream_id").alias("group"), "state", parse_question(F.col("raw")).alias("question"), label.alias("label"),
    ).withColumn("primitive", F.col("question.type"))
    return finish(records), rows.filter(F.col("reason").isNotNull()).drop("_q", "_a")


def convert_tasks(df: DataFrame, suite: str, subset: str) -> tuple[DataFrame, DataFrame]:
    """Task rows with a typed question: yes/no gold becomes 1/0, a null group stands alone, labels must match.

    df: upstream_id, group, family, state, expected, labels[], question (struct), exclude_reason.
    """
    q = F.col("question")
    noul = q["type"] == "noul"
    keys = F.when(noul, F.array(F.lit("no"), F.lit("yes"))).when(q["type"] == "score", F.transform(q["options"], lambda _, i: i.cast("string"))).otherwise(
        F.transform(q["options"], lambda o: o["key"]))
    same = F.array_sort(F.array_distinct(keys)) == F.array_sort(F.array_distinct("labels"))
    label = F.when(noul, F.when(F.col("expected") == "yes", "1").when(F.col("expected") == "no", "0")).otherwise(F.col("expected"))
    reason = (
        F.when((F.coalesce("exclude_reason", F.lit("")) != "") | F.col("expected").isNull(), "excluded or unscored").when(~same, "candidate inventory mismatch")
        .when(~F.array_contains(keys, F.col("expected")), "gold label not in options")
    )
    return parted(finish(df.select(
        F.concat_ws("/", F.lit(suite), "upstream_id").alias("id"), F.lit(suite).alias("suite"), F.lit(subset).alias("subset"), F.lit(f"{suite}/{subset}").alias("source"),
        "family", F.coalesce(F.nullif("group", F.lit("")), "upstream_id").alias("group"), "state", "question", q["type"].alias("primitive"), label.alias("label"), reason.alias("reason"),
    )))


def convert_hosted(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Third-party prediction columns to predictions of the selected ids.

    df: id, primitive, p_yes, probabilities, answer, confidence, error, latency_ms.
    """
    kind = F.col("primitive")
    answer = F.struct(
        F.when(kind == "choice", F.col("answer")).alias("choice"), F.when(kind == "score", F.col("answer").cast("double")).alias("score"),
        F.when(kind == "noul", F.col("p_yes")).alias("noul"), F.when(kind != "noul", F.col("probabilities")).alias("probabilities"), "confidence",
    )
    return df.join(selected.select("id"), "id", "left_semi").select("id", "error", answer.alias("answer"), "latency_ms")


def held_out_share(df: DataFrame, used_states: DataFrame, k: int = 4) -> DataFrame:
    """Split a converted pool: official validation and 1/k of the train states go to evaluation, minus used states.

    Adds `pool`: validation, train, or used (a validation row whose state was used elsewhere).
    """
    from weighbridge.functions.hashing import hex_mod

    free = F.col("_used").isNull()
    picked = (F.col("split") == "validation") | (hex_mod(F.col("state_sha256"), k) == 0)
    used = used_states.select("state_sha256", F.lit(True).alias("_used")).distinct()
    out = df.join(used, "state_sha256", "left")
    return out.withColumn("pool", F.when(free & picked, "validation").when(F.col("split") == "train", "train").otherwise("used")).drop("_used")


# The probe's wording.
PROBE_COLORS = ("amber", "teal", "violet", "silver")
PROBE_MARKER = "Audit entry: the access color for room K17 is {color}."
PROBE_QUESTION = "According to the audit entry, what is the access color for room K17?"
PROBE_BUDGETS = (512, 4096, 8192, 15000)


def context_probes(documents: DataFrame, seed: str, depths: Sequence[float] = (0.0, 0.5, 1.0), budgets: Sequence[int] = PROBE_BUDGETS) -> DataFrame:
    """A marker sentence hidden at each relative depth of every whole document, with a question about it.

    `target` is the smallest word budget that holds the document, null beyond the largest. The color and the
    option order come from a hash.
    """
    from weighbridge.operators.prompts import shuffled

    rows = documents.select("id", "text", F.explode(F.array(*[F.lit(d) for d in depths])).alias("position")).withColumn("_w", F.split("text", " "))
    n = F.size("_w")
    target = F.lit(None).cast("int")
    for b in sorted(budgets, reverse=True):
        target = F.when(n <= b, F.lit(b)).otherwise(target)
    key = F.concat_ws("|", F.col("id"), F.col("position").cast("string"))
    colors = F.array(*[F.lit(c) for c in PROBE_COLORS])
    color = F.element_at(colors, seeded_bucket(F.concat(F.lit(seed + "|probe|"), key), len(PROBE_COLORS)) + 1)
    before = F.rint(n * F.col("position")).cast("int")
    head, marker = PROBE_MARKER.split("{color}")
    sentence = F.concat(F.lit(head), F.col("label"), F.lit(marker))
    options = F.transform(colors, lambda c: F.struct(c.alias("key"), F.lit(None).cast("string").alias("description")))
    state = F.array_join(F.concat(F.slice("_w", F.lit(1), before), F.array(sentence), F.slice("_w", before + 1, F.greatest(n - before, F.lit(0)))), " ")
    return rows.withColumn("label", color).withColumn("state", state).select(
        F.concat_ws("/", F.lit("probe"), "id", F.col("position").cast("string")).alias("id"), target.alias("target"), "position", "label", "state",
        question("choice", PROBE_QUESTION, shuffled(options, seed, key)).alias("question"),
    )
