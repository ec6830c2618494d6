"""Deterministic hash-ordered selection with exclusions, quotas, balance and staged splits.

Records need `id` (unique), `state_sha256` and `source`. Selection works on narrow key tables
(source, id, state, hash); payload columns come back with one join on id (`fetch`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weighbridge.functions.hashing import seeded_order
from weighbridge.operators.ranking import ranked
from weighbridge.session import cut

KEYS = ["id", "state_sha256"]
WINDOW_ROWS = 1_000_000  # narrow rows of a group that one task may sort


def key_union(*tables: DataFrame) -> DataFrame:
    """Distinct (id, state_sha256) keys of several tables."""
    out = tables[0].select(*KEYS)
    for table in tables[1:]:
        out = out.unionByName(table.select(*KEYS))
    return out.distinct()


def without(keys: DataFrame, exclude: DataFrame | None) -> DataFrame:
    """Drop rows whose id or state is in the exclusion keys."""
    if exclude is None:
        return keys
    ids = exclude.select("id").filter(F.col("id").isNotNull()).distinct()
    states = exclude.select("state_sha256").filter(F.col("state_sha256").isNotNull()).distinct()
    return keys.join(ids, "id", "left_anti").join(states, "state_sha256", "left_anti")


def firsts(df: DataFrame, seed: str, tag: str, by: Sequence[str] = ("source",), exclude: DataFrame | None = None,
           keep: Column | None = None) -> DataFrame:
    """Eligible keys: one row per (group, state), its first id in hash order.

    The per-state minimum is a partial aggregate, so a state with very many copies shrinks before any shuffle
    and before the state anti-join.
    """
    if keep is not None:
        df = df.filter(keep)
    keys = df.select(*by, *KEYS)
    if exclude is not None:
        ids = exclude.select("id").filter(F.col("id").isNotNull()).distinct()
        keys = keys.join(ids, "id", "left_anti")
    name = F.concat_ws("/", *[F.col(c) for c in by], F.lit(tag))
    keys = keys.withColumn("h", seeded_order(seed, name, "id"))
    best = keys.groupBy(*by, "state_sha256").agg(F.min(F.struct("h", "id")).alias("_b")).select(
        *by, "state_sha256", "_b.h", "_b.id"
    )
    if exclude is not None:
        states = exclude.select("state_sha256").filter(F.col("state_sha256").isNotNull()).distinct()
        best = best.join(states, "state_sha256", "left_anti")
    return best.select(*by, "id", "state_sha256", "h")


def take_k(df: DataFrame, k: int, seed: str, tag: str, by: Sequence[str] = ("source",),
           exclude: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """Up to k keys per group in hash order, one per state, none excluded, with their rank."""
    return ranked(firsts(df, seed, tag, by, exclude, keep), list(by), "h", "id", k)


def fetch(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Full rows of selected keys."""
    extra = [c for c in keys.columns if c == "id" or c not in df.columns]
    return df.join(keys.select(*extra), "id")


def shortage(chosen: DataFrame, quotas: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Groups that found fewer rows than their quota k; empty when every quota is met."""
    found = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("found"))
    return quotas.join(found, list(by), "left").select(
        *by, F.col("k").alias("need"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found")
    ).filter(F.col("found") < F.col("need"))


def select_exact(df: DataFrame, k: int, seed: str, tag: str, by: Sequence[str] = ("source",),
                 exclude: DataFrame | None = None, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """take_k plus the groups that fall short of k."""
    chosen = take_k(df, k, seed, tag, by, exclude, keep)
    quotas = df.select(*by).distinct().withColumn("k", F.lit(k).cast("bigint"))
    return chosen, shortage(chosen, quotas, by)


def select_unique_report(df: DataFrame, k: int, seed: str, tag: str, by: Sequence[str] = ("source",),
                         exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """take_k plus the keys passed over before the k-th pick."""
    chosen = take_k(df, k, seed, tag, by, exclude)
    last = chosen.groupBy(*by).agg(F.max("h").alias("_last"))
    name = F.concat_ws("/", *[F.col(c) for c in by], F.lit(tag))
    seen = df.select(*by, *KEYS).withColumn("h", seeded_order(seed, name, "id")).join(last, list(by))
    rejected = seen.filter(F.col("h") < F.col("_last")).drop("_last").join(chosen.select("id"), "id", "left_anti")
    return chosen, rejected


def _cut_marked(df: DataFrame, keys: list[str]) -> tuple[DataFrame, tuple[int, int]]:
    """cut(df), its number of rows and a fingerprint of their keys, both taken while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("mark")))
    return out, (seen.get["n"], seen.get["mark"])


def bounded(pool: DataFrame, by: list[str], place: Column) -> tuple[DataFrame, int]:
    """The rows of a pool (by, state_sha256, h, id, k) that a greedy walk may reach, written, and their number.

    A row whose state stands at one place only can never be blocked, so a group is full at its k-th such row at the latest; what lies
    behind is dropped. A group with fewer of them stays whole. pool holds one row a group and state.
    """
    single = pool.groupBy("state_sha256").agg(
        F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.min(F.struct(*by, "h", "id", "k")).alias("_r")).filter("_lo = _hi").select("_r.*")
    last = ranked(single, by, "h", "id", F.col("k")).filter(F.col("rank") == F.col("k")).select(*by, F.col("h").alias("_last"))
    # One row a group of the quota table.
    reach = pool.join(F.broadcast(last), by, "left").filter(F.col("_last").isNull() | (F.col("h") <= F.col("_last")))
    out, (n, _) = _cut_marked(reach.drop("_last"), ["id"])
    return out, n


def ranker(pool: DataFrame, n: int, by: list[str]):
    """How rounds over a bounded pool of n rows rank its groups: in one window each while the largest is small, else in pieces. Same ranks."""
    largest = n if n <= WINDOW_ROWS else pool.groupBy(*by).count().agg(F.max("count")).first()[0]

    def windowed(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
        return rows.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= F.col("k"))

    return windowed if largest <= WINDOW_ROWS else lambda rows: ranked(rows, by, "h", "id", F.col("k"))


def multi_quota(candidates: DataFrame, quotas: DataFrame, by: Sequence[str], rounds: int | None = None) -> DataFrame:
    """Greedy selection over ordered groups that share states, as a fixed point.

    candidates: `firsts` output. quotas: (by..., seq, k), one place in one order per group. A group may not take
    a state taken by an earlier group. Every round picks for all groups at once and blocks what earlier groups
    picked the round before; after round r the first r+1 groups are final, so the result equals the greedy walk.
    Rounds see the bounded pool only, whose size follows the quotas and not the table.
    """
    by, quotas = list(by), cut(quotas)
    pool, n = bounded(cut(candidates.join(F.broadcast(quotas), by)), by, F.col("seq"))  # quotas have one row a group
    cap = rounds or quotas.count() + 1
    rank = ranker(pool, n, by)
    picks, mark = _cut_marked(rank(pool), [*by, "id"])
    for _ in range(cap):
        owner = picks.groupBy("state_sha256").agg(F.min("seq").alias("_owner"))
        free = pool.join(owner, "state_sha256", "left").filter(
            F.col("_owner").isNull() | (F.col("_owner") >= F.col("seq"))
        ).drop("_owner")
        picks, now = _cut_marked(rank(free), [*by, "id"])
        if now == mark:
            return picks
        mark = now
    raise RuntimeError("selection did not settle within its proven number of rounds")


@dataclass(frozen=True)
class Stage:
    """One step of a staged build: which rows it may use and how many each group gives to which split.

    quotas: (source, split, seq, k); several splits of one stage draw from the same pool in seq order.
    """

    name: str
    pool: Column
    quotas: DataFrame
    keep: Column | None = None
    exclude: DataFrame | None = field(default=None)


def staged_splits(records: DataFrame, stages: Sequence[Stage], seed: str, exclude: DataFrame | None = None
                  ) -> DataFrame:
    """Keys with their split. Stages run in order; each excludes every earlier pick and its own exclusions."""
    chosen: DataFrame | None = None
    for stage in stages:
        blocked = [t.select(*KEYS) for t in (exclude, stage.exclude, chosen) if t is not None]
        barred = key_union(*blocked) if blocked else None
        rows = records.filter(stage.pool)
        if stage.keep is not None:
            rows = rows.filter(stage.keep)
        splits = [r["split"] for r in stage.quotas.select("split").distinct().collect()]  # a handful of names
        parts = [firsts(rows, seed, name, ("source",), barred).withColumn("split", F.lit(name)) for name in splits]
        pool = parts[0]
        for part in parts[1:]:
            pool = pool.unionByName(part)
        picked = multi_quota(pool, stage.quotas, ("source", "split")).withColumn("stage", F.lit(stage.name))
        picked = picked.select("stage", "split", "source", "id", "state_sha256", "h", "rank")
        chosen = picked if chosen is None else cut(chosen.unionByName(picked))
    return chosen


def balanced_binary(df: DataFrame, cap: int, order: DataFrame, seed: str, tag: str,
                    exclude: DataFrame | None = None, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Yes/no rows with equal gold labels in every source, and the per-source composition.

    df: id, state_sha256, source, label ('1'/'0'). order: (source, seq). A source gives
    min(cap, available yes, available no) rows per label, yes first; states taken by earlier sources, or under
    the other label, are not free. Solved as a fixed point like multi_quota, with quotas recomputed per round.
    """
    by = ["source", "label"]
    free0 = firsts(df, seed, tag, by, exclude, keep)
    whole = cut(free0.join(order, "source").withColumn("place", F.col("seq") * 2 + F.when(F.col("label") == "1", 0).otherwise(1)).withColumn("k", F.lit(cap).cast("bigint")))
    pool, n = bounded(whole, by, F.col("place"))
    pool, rank = pool.drop("k"), ranker(pool, n, by)
    # Availability counts the whole table once; a round takes off the rows that picks of earlier sources block. Only states of
    # several sources can be blocked, and those are written once.
    base = cut(whole.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")))
    several = whole.groupBy("state_sha256").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi")).filter("_lo <> _hi").select("state_sha256")
    shared = cut(whole.join(several, "state_sha256", "left_semi").select("source", "label", "seq", "state_sha256"))

    def step(picks: DataFrame | None):
        rows, left = pool.withColumn("_place", F.lit(None).cast("int")), base
        if picks is not None:
            owner = picks.groupBy("state_sha256").agg(F.min("seq").alias("_source"), F.min("place").alias("_place"))
            rows = pool.join(owner, "state_sha256", "left").filter(F.col("_source").isNull() | (F.col("_source") >= F.col("seq")))
            gone = shared.join(owner, "state_sha256").filter(F.col("_source") < F.col("seq")).groupBy("source", "label").agg(F.count(F.lit(1)).alias("_gone"))
            left = base.join(gone, by, "left").withColumn("n", F.col("n") - F.coalesce("_gone", F.lit(0)))
        count = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
        avail = left.groupBy("source").agg(count("1").alias("available_yes"), count("0").alias("available_no"))
        k = avail.withColumn("k", F.least(F.lit(cap).cast("bigint"), "available_yes", "available_no"))
        open_rows = rows.filter(F.col("_place").isNull() | (F.col("_place") >= F.col("place"))).drop("_source", "_place")
        return *_cut_marked(rank(open_rows.join(k.select("source", "k"), "source")), [*by, "id"]), k

    picks, mark, avail = step(None)
    for _ in range(2 * order.count() + 1):
        picks, now, avail = step(picks)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("selection did not settle within its proven number of rounds")
    per = picks.groupBy("source").agg(
        F.count_if(F.col("label") == "1").alias("_yes"), F.count_if(F.col("label") == "0").alias("_no")
    )
    both = avail.filter(F.col("available_yes") + F.col("available_no") > 0).join(per, "source", "left").withColumn(
        "gold_yes", F.least(F.coalesce("_yes", F.lit(0)), F.coalesce("_no", F.lit(0))).cast("bigint")
    )
    composition = both.select(
        "source", (F.col("gold_yes") * 2).alias("records"), "gold_yes", "available_yes", "available_no"
    )
    chosen = picks.join(both.select("source", "gold_yes"), "source").filter(F.col("rank") <= F.col("gold_yes"))
    return chosen.select("source", "label", "id", "state_sha256", "h", "rank"), composition


def balance_gate(composition: DataFrame, minimum: int = 150, share: tuple[float, float] = (0.4, 0.6),
                 sources: int = 3) -> DataFrame:
    """One row: size, yes share and used sources of a balanced pool against its limits."""
    total = composition.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("gold_yes"), F.lit(0)).alias("gold_yes"),
        F.count_if(F.col("records") > 0).alias("sources"),
    )
    rate = F.coalesce(F.col("gold_yes") / F.nullif(F.col("records"), F.lit(0)), F.lit(0.0))
    return total.withColumn("gold_yes_share", rate).withColumn(
        "passed",
        (F.col("records") >= minimum) & F.col("gold_yes_share").between(*share) & (F.col("sources") >= sources),
    )


def synthetic_exclusions(prior: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keys generator-owned evaluation rows must avoid: earlier training plus this build's own picks."""
    return key_union(prior.filter(F.col("kind") == "train"), chosen)


def forbidden_keys(prior: DataFrame, chosen: DataFrame, pools: DataFrame) -> DataFrame:
    """Keys training must avoid: earlier evaluation, this build's picks and every non-train pool row."""
    return key_union(prior.filter(F.col("kind") == "eval"), chosen, pools.filter(F.col("pool") != "train"))


def drop_prompt_groups(df: DataFrame, evaluation: DataFrame, prompt: Column | None = None) -> DataFrame:
    """Drop rows whose prompt occurs in any evaluation row; rows without a prompt stay.

    A prompt shared by very many rows keeps its rows: the evaluation side is distinct, so the anti-join never
    multiplies, and adaptive skew handling splits the big side.
    """
    prompt = F.col("prompt_sha256") if prompt is None else prompt
    barred = evaluation.select(prompt.alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    return df.withColumn("_p", prompt).join(barred, "_p", "left_anti").drop("_p")


def overlap_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Shared-state count of every pair of splits, zero included.

    Pairs come from the set of splits of each state, which is at most the number of splits.
    """
    per_state = df.groupBy("state_sha256").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = per_state.select(F.explode(F.flatten(F.transform(
        "s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))
    ))).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("shared"))
    ordered = sorted(names)
    grid = df.sparkSession.createDataFrame(
        [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]], "split_a string, split_b string"
    )
    return grid.join(pairs, ["split_a", "split_b"], "left").select(
        "split_a", "split_b", F.coalesce("shared", F.lit(0)).alias("shared")
    )


def prior_hits(train: DataFrame, prior: DataFrame) -> DataFrame:
    """One row: training rows whose id or state is in earlier evaluation (must be 0), and reused training ids."""
    seen = prior.filter(F.col("kind") == "eval")
    ids = seen.select("id", F.lit(1).alias("_id")).distinct()
    states = seen.select("state_sha256", F.lit(1).alias("_state")).distinct()
    old = prior.filter(F.col("kind") == "train").select("id", F.lit(1).alias("_old")).distinct()
    flagged = train.select(*KEYS).join(ids, "id", "left").join(old, "id", "left")
    # Collapse copies of a state before its join.
    per_state = flagged.groupBy("state_sha256").agg(
        F.count(F.lit(1)).alias("n"), F.count("_id").alias("by_id"), F.count("_old").alias("reused")
    )
    return per_state.join(states, "state_sha256", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_state").isNotNull(), F.col("n")).otherwise(F.col("by_id"))), F.lit(0)).alias("prior_eval_hits"),
        F.coalesce(F.sum("reused"), F.lit(0)).alias("reused"),
    )


def state_overlap(df: DataFrame, prior: DataFrame) -> DataFrame:
    """Per prior file: ids of df that match one of its states exactly, and after normalisation."""
    def matches(column: str, name: str) -> DataFrame:
        left = df.select("id", column)
        right = prior.select("file", column).distinct()
        return left.join(right, column).select("file", "id", F.lit(name).alias("match"))

    return matches("state_sha256", "exact").unionByName(matches("normalized_state_sha256", "normalized"))


def prefix_sample(ranked_keys: DataFrame, fraction: float, by: Sequence[str] = ("source",)) -> DataFrame:
    """The first round(n * fraction), half to even, of every group's selection order."""
    sizes = ranked_keys.groupBy(*by).agg(F.rint(F.count(F.lit(1)) * F.lit(fraction)).alias("_k"))
    return ranked_keys.join(sizes, list(by)).filter(F.col("rank") <= F.col("_k")).drop("_k")


def sample_per_group(df: DataFrame, by: Sequence[str], k: int, seed: str, tag: str | None = None) -> DataFrame:
    """First k rows of every group in seeded order, without state de-duplication."""
    keys = df.select(*by, "id").withColumn("h", seeded_order(seed, tag, "id"))
    return ranked(keys, list(by), "h", "id", k)


def first_per_group(df: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """The row that came first in file order, per group."""
    return df.groupBy(*by).agg(F.min(F.struct(position, "id")).alias("_f")).select(*by, f"_f.{position}", "_f.id")


def length_filter(df: DataFrame, text: Column, limit: int) -> DataFrame:
    return df.filter(F.char_length(text) <= limit)


def token_budget(df: DataFrame, counter, limit: int, share: tuple[float, float] = (0.32, 0.38)
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, rows over the limit (dropped whole, never truncated) and the synthetic token share.

    counter: a function from the prompt column to a token-count column; `is_synthetic` marks generated rows.
    """
    counted = df.withColumn("tokens", counter(F.col("prompt")).cast("bigint"))
    kept = counted.filter(F.col("tokens") <= limit)
    excluded = counted.filter(F.col("tokens") > limit).select("id", "source", "tokens")
    totals = kept.agg(
        F.count(F.lit(1)).alias("prepared"),
        F.coalesce(F.sum(F.when(F.col("is_synthetic"), F.col("tokens"))), F.lit(0)).alias("synthetic"),
        F.coalesce(F.sum(F.when(~F.col("is_synthetic"), F.col("tokens"))), F.lit(0)).alias("natural"),
    )
    rate = F.col("synthetic") / F.greatest(F.lit(1), F.col("synthetic") + F.col("natural"))
    gate = totals.withColumn("synthetic_share", rate).withColumn("passed", F.col("synthetic_share").between(*share))
    return kept, excluded, gate


def exposure_summary(prompts: DataFrame, first_n: int, order: str, tie: str = "id") -> DataFrame:
    """What the first N prompts in training order show: rows, distinct records and states, token range.

    prompts: id, record_id, source, state_sha256, tokens and a hex order column. Totals and per-source rows.
    """
    shown = ranked(prompts.withColumn("_one", F.lit(0)), ["_one"], order, tie, first_n)
    return shown.groupingSets([["source"], []], "source").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_distinct("record_id").alias("unique_records"),
        F.count_distinct("state_sha256").alias("unique_states"), F.sum("tokens").alias("tokens"),
        F.min("tokens").alias("minimum_tokens"), F.max("tokens").alias("maximum_tokens"),
        F.grouping("source").cast("boolean").alias("overall"),
    )


def missing_ids(selected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Selected ids without a prediction, and prediction ids that occur more than once."""
    missing = selected.select("id").join(predictions.select("id").distinct(), "id", "left_anti")
    repeated = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("id")
    return missing.withColumn("problem", F.lit("missing")).unionByName(repeated.withColumn("problem", F.lit("duplicate")))


def split_manifest(df: DataFrame) -> DataFrame:
    """Rows, share of the split and an order-free content checksum, per split and per (split, source)."""
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", "id", "state_sha256")), 1, 8), 16, 10).cast("decimal(20,0)")
    counted = df.withColumn("_m", mark).groupingSets([["split", "source"], ["split"]], "split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("_m").alias("checksum"), F.grouping("source").alias("_total")
    )
    totals = counted.filter(F.col("_total") == 1).select("split", F.col("records").alias("_all"))
    return counted.join(totals, "split").select(
        "split", F.coalesce("source", F.lit("*")).alias("source"), "records",
        (F.col("records") / F.col("_all")).alias("share"), "checksum",
    )
