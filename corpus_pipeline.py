"""From raw documents to token ids: five stages, each over all that the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes each result to the
shared folder and reads it again, so a lost executor costs one stage's task and nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm import bpe, decontaminate, near_dup, private_data, quality_classifier
from weighbridge.llm.queries import SURROGATE_KEY, remainder, tokenizer_path
from weighbridge.llm.registry import prepared, table
from weighbridge.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepared(spark)
    learned = remainder(5) != 0
    model = quality_classifier.train(docs.filter(learned), table(spark, sf_dir, "labels").filter(learned))
    scored = quality_classifier.score(docs, model, keep=tuple(docs.columns), names=("_score", "_predicted"))
    return scored.filter(F.col("_predicted") == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepared(spark)
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or re-parameterised."""
    prepared(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    prepared(spark)
    out = private_data.with_surrogates(docs, SURROGATE_KEY, count="_mentions")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_mentions") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    prepared(spark)
    coder = bpe.ByteBPE(spark, tokenizer_path())
    coded = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_text"), coder.round_trip("text").alias("_coded"))
    return coded.select("doc_id", "lang", "source", F.size("_coded.ids").cast("bigint").alias("n_tokens"), F.col("_coded.ids").alias("ids"),
                        (F.col("_coded.text") == F.col("_text")).alias("round_trip"))


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("surrogates", surrogates), ("bpe", tokens)]

# Classifier, consistent sampling and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
