"""Request validation and the move between one row per request and one row per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.operators.converters import parse_question

# The limits of a request.
CHOICE_KEYS = (1, 255)
SCORE_LEVELS = (2, 10)
QUESTIONS = (1, 256)
IMAGE_TEXT = 2000


def _type(json_text: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_text), path, "variant"))


def _described(kind: Column) -> Column:
    """A description is text, an object or an array."""
    return (kind == "STRING") | kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _question_problem(raw: Column) -> Column:
    """First rule a question breaks, or null."""
    kind = F.get_json_object(raw, "$.type")
    criteria = F.get_json_object(raw, "$.criteria")
    shape = F.coalesce(_type(raw, "$.criteria"), F.lit("VOID"))
    keys = F.coalesce(F.json_object_keys(criteria), F.array().cast("array<string>"))
    levels = F.coalesce(F.json_array_length(criteria), F.lit(0))
    types = lambda values: F.transform(values, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    named = types(F.map_values(F.from_json(criteria, "map<string,variant>")))
    listed = types(F.from_json(criteria, "array<variant>"))
    every = lambda kinds, null: F.coalesce(F.forall(kinds, lambda t: _described(t) | (F.lit(null) & (t == "VOID"))), F.lit(True))
    extra = F.size(F.array_except(F.json_object_keys(raw), F.array(F.lit("type"), F.lit("instructions"), F.lit("criteria")))) > 0
    return (
        F.when(~F.coalesce(kind.isin("choice", "score", "noul"), F.lit(False)), "unknown question type")
        .when(extra, "unknown question key")
        .when(~F.coalesce(_described(_type(raw, "$.instructions")), F.lit(False)), "instructions missing or of the wrong type")
        .when((kind == "choice") & (~shape.startswith("OBJECT") | ~F.size(keys).between(*CHOICE_KEYS)), "choice needs 1 to 255 options")
        .when((kind == "score") & (~shape.startswith("ARRAY") | ~levels.between(*SCORE_LEVELS)), "score needs 2 to 10 levels")
        .when((kind == "noul") & ~(shape.startswith("OBJECT") | (shape == "VOID")), "noul criteria must be an object")
        .when((kind == "noul") & (F.size(F.array_except(keys, F.array(F.lit("true"), F.lit("false")))) > 0), "noul criteria keys must be true or false")
        .when(((kind == "choice") & ~every(named, True)) | ((kind == "score") & ~every(listed, False)) | ((kind == "noul") & ~every(named, False)),
              "descriptions of the wrong type")
    )


def validate_requests(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Add `reasons` (sorted, empty when valid). df: request_id, body (JSON text)."""
    body = F.col("body")
    top = F.json_object_keys(body)
    questions = F.from_json(F.get_json_object(body, "$.questions"), "map<string,string>")
    picture = lambda k: F.get_json_object(body, f"$.state.{k}")
    image = lambda k: (_type(body, f"$.state.{k}") == "STRING") & (picture(k).startswith("data:image") | (F.char_length(picture(k)) > IMAGE_TEXT))
    known = F.coalesce(F.get_json_object(body, "$.model").isin(*models), F.lit(False))
    n = F.size(F.coalesce(questions, F.create_map().cast("map<string,string>")))
    per_question = F.transform(F.map_entries(questions), lambda e: _question_problem(e["value"]))
    rules = F.array(
        F.when(top.isNull(), F.lit("not a JSON object")),
        F.when(F.size(F.array_except(top, F.array(F.lit("model"), F.lit("state"), F.lit("questions")))) > 0, F.lit("unknown request key")),
        F.when(top.isNotNull() & ~known, F.lit("unknown model")),
        F.when(top.isNotNull() & ~F.coalesce(_described(_type(body, "$.state")), F.lit(False)), F.lit("state missing or of the wrong type")),
        F.when(F.coalesce(image("image"), F.lit(False)) | F.coalesce(image("screenshot"), F.lit(False)), F.lit("image input is not supported")),
        F.when(top.isNotNull() & ~n.between(*QUESTIONS), F.lit("needs 1 to 256 questions")),
    )
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.concat(rules, F.coalesce(per_question, F.array().cast("array<string>"))))))
    return df.withColumn("reasons", reasons)


def explode_requests(valid: DataFrame) -> DataFrame:
    """One row per named question of a valid request; request ids never reach the prompt."""
    questions = F.from_json(F.get_json_object("body", "$.questions"), "map<string,string>")
    return valid.select(
        "request_id", F.get_json_object("body", "$.state").alias("state"), F.explode(questions).alias("question_key", "_raw")
    ).withColumn("question", parse_question(F.col("_raw"))).drop("_raw")
