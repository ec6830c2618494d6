"""Training prompts: option order, subsampling, soft targets and order variants, all decided by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.hashing import seeded_bucket, seeded_order
from weighbridge.functions.probability import expected_labels, human_distribution, total
from weighbridge.functions.text import LETTERS, prompt_text
from weighbridge.operators.ranking import ranked
from weighbridge.operators.readout import read_options

# How training words score questions, and the sizes a long option list is cut to.
SCORE_TRAINING_SUFFIX = " Select the level whose description best fits. Level numbers preserve their original order."
SUBSAMPLE_SIZES = (4, 8, 16, 32)


def shuffled(options: Column, seed: str, key: Column) -> Column:
    """Options in the order of sha256(seed|key|option): a fixed permutation per key."""
    marked = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), key, o["key"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(marked, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)), lambda m: m["o"])


def order_variants(df: DataFrame, n: int) -> DataFrame:
    """N copies of every record, numbered from 0."""
    return df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def option_subsample(df: DataFrame, seed: str, limit: int = len(LETTERS), options: str = "options", gold: str = "gold") -> DataFrame:
    """Cut lists above the limit to 4, 8, 16 or 32 options: the gold one and hash-picked others."""
    key = F.concat_ws("|", F.col("id"), F.col("variant").cast("string"))
    pick = seeded_bucket(F.concat(F.lit(seed + "|size|"), key), len(SUBSAMPLE_SIZES))
    size = F.element_at(F.array(*[F.lit(s) for s in SUBSAMPLE_SIZES]), pick + 1)
    kept = F.filter(options, lambda o: o["key"] == F.col(gold))
    others = shuffled(F.filter(options, lambda o: o["key"] != F.col(gold)), seed + "|sample", key)
    return df.withColumn(options, F.when(F.size(options) > limit, F.concat(kept, F.slice(others, 1, size - 1))).otherwise(F.col(options)))


def soft_target(df: DataFrame, options: str = "options", human: str = "human", gold: str = "gold") -> DataFrame:
    """Target over the kept options: renormalised votes, or one-hot; null where the votes miss every kept option."""
    keys = F.transform(options, lambda o: o["key"])
    votes = F.transform(keys, lambda k: F.coalesce(F.try_element_at(human, k), F.lit(0.0)))
    s = total(votes)
    hard = F.transform(keys, lambda k: F.when(k == F.col(gold), 1.0).otherwise(0.0))
    return df.withColumn("target", F.when(F.col(human).isNull(), hard).when(s > 0, F.transform(votes, lambda v: v / s)))


def build_prompts(df: DataFrame, seed: str, variants: int = 1) -> DataFrame:
    """Training prompt rows, `rejected` telling why a row has none.

    df: id, source, primitive, state, state_sha256, question, label and optionally soft (map label -> votes).
    """
    q, kind = F.col("question"), F.col("primitive")
    labels = expected_labels(q)
    noul = kind == "noul"
    if "soft" in df.columns:
        human = human_distribution(F.col("soft"), labels)
    else:
        human = F.struct(F.lit(None).cast("array<double>").alias("h"), F.lit(None).cast("string").alias("reason"))
    rows = order_variants(df, variants).withColumns({
        "options": read_options(q), "gold": F.when(noul, F.when(F.col("label") == "1", "yes").otherwise("no")).otherwise(F.col("label")),
        "_h": human, "_n": labels,
    })
    names = F.when(noul, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.col("_n"))
    rows = rows.withColumn("human", F.when(F.col("_h.h").isNotNull(), F.map_from_arrays(names, F.col("_h.h"))))
    rows = option_subsample(rows, seed)
    key = F.concat_ws("|", F.col("id"), F.col("variant").cast("string"))
    rows = soft_target(rows.withColumn("options", shuffled(F.col("options"), seed, key)))
    keys = F.transform("options", lambda o: o["key"])
    at = F.array_position(keys, F.col("gold"))
    base = F.coalesce(q["instructions"], F.lit(""))
    text = F.when(kind == "score", F.concat(base, F.lit(SCORE_TRAINING_SUFFIX))).otherwise(base)
    rejected = F.coalesce(F.col("_h.reason"), F.when(at == 0, F.lit("missing gold choice")), F.when(F.col("target").isNull(), F.lit("empty target probability")))
    return rows.select(
        F.concat(F.col("id"), F.lit("/p"), F.col("variant").cast("string")).alias("id"), F.col("id").alias("record_id"), "source", "primitive",
        "state_sha256", keys.alias("option_keys"), prompt_text(F.col("state"), text, F.col("options")).alias("prompt"),
        F.transform("options", lambda _, i: F.substr(F.lit(LETTERS), i + 1, F.lit(1))).alias("labels"), "target",
        (at - 1).cast("int").alias("hard_target"), rejected.alias("rejected"),
    )


def ordered_prompts(prompts: DataFrame, seed: str) -> DataFrame:
    """Prompts in file order: a total sort by sha256(seed|order|id)."""
    return prompts.orderBy(seeded_order(seed, "order", "id"), "id")


def set_options(df: DataFrame, options: Column) -> DataFrame:
    return df.withColumn("question", F.col("question").withField("options", options))


def shuffled_pairs(df: DataFrame, k: int, seed: str) -> DataFrame:
    """The first k choice rows in seeded order with their options permuted, never left as they were."""
    choice = df.filter((F.col("primitive") == "choice") & (F.size("question.options") > 1))
    keys = ranked(choice.select("id", F.lit(0).alias("_one"), seeded_order(seed, "shuffle", "id").alias("h")), ["_one"], "h", "id", k)
    given = F.col("question.options")
    turned = shuffled(given, seed + "|order", F.col("id"))
    names = lambda o: F.transform(o, lambda x: x["key"])
    rotated = F.concat(F.slice(given, 2, F.size(given) - 1), F.slice(given, 1, 1))
    return set_options(choice.join(keys.select("id", "rank"), "id"), F.when(names(turned) == names(given), rotated).otherwise(turned))


def reverse_options(df: DataFrame) -> DataFrame:
    """Choice options in reverse order; other questions as they are."""
    given = F.col("question.options")
    return set_options(df, F.when(F.col("primitive") == "choice", F.reverse(given)).otherwise(given))


def canonical_options(df: DataFrame) -> DataFrame:
    """Choice options sorted by key; levels and yes/no keep their meaningful order."""
    given = F.col("question.options")
    return set_options(df, F.when(F.col("primitive") == "choice", F.array_sort(
        given, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).otherwise(given))
