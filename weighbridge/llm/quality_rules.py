"""Quality rules whose cut-offs follow the corpus: quantile sketches per language and source.

`word_stats` counts words, symbols, repeated lines and repeated 3-word windows of whole texts. `thresholds` merges quantile
sketches of the ratios made from them: every task sketches its rows, sketches of a group merge in the shuffle, and small groups use
the merged sketch of their language, or of everything. `judge` joins each row to its group's limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import Flat, byte_table, per_text, picked, repeats, span_hashes, text_slices, window_hashes
from weighbridge.session import cut

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WIDTH = 4.0  # spreads beyond the middle half that still count as usual
SKETCH_K = 400
MIN_GROUP = 100  # rows from which a (language, source) has limits of its own

# Ratio -> least distance of a limit from the median: a group of equal values has no spread to go by.
RATIOS = {"symbols": 0.05, "dup_lines": 0.5, "repeats": 0.35, "word_length": 3.0}
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def count_slice(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of every text of a slice."""
    word = ~byte_table(*[(c, c) for c in SPACE])
    flat = Flat(raw, offsets, word)
    inside = word[raw]
    words, owner = flat.hashes(), flat.text_of_word()
    first, bounds = flat.windows(3)
    twice, _ = repeats(window_hashes(words, first, 3), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)))
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[first[twice] + k] = True
    # Lines that hold a word: break at \n and at the texts' borders.
    breaks = np.unique(np.concatenate([np.flatnonzero(raw == 10), offsets[1:]]))
    line_of_word = np.searchsorted(breaks, flat.start, "left")
    lines, at = np.unique(line_of_word, return_index=True)
    begin = np.where(lines > 0, breaks[np.maximum(lines - 1, 0)], 0)
    begin = begin + ((lines > 0) & (raw[np.minimum(begin, max(len(raw) - 1, 0))] == 10)) if len(raw) else begin
    begin = np.maximum(begin, offsets[owner[at]]) if len(lines) else begin
    _, later = repeats(span_hashes(raw, begin, breaks[lines]), owner[at])
    line_bounds = np.searchsorted(owner[at], np.arange(len(offsets)))
    point = (raw & 0xC0) != 0x80
    symbol = byte_table(*[(ord(c), ord(c)) for c in SYMBOLS])
    return {
        "n_words": flat.counts, "word_chars": per_text(inside & point, offsets), "n_symbols": per_text(symbol[raw], offsets),
        "n_lines": np.diff(line_bounds), "n_dup_lines": per_text(later, line_bounds),
        "n_repeat_words": per_text(covered[: len(words)], flat.first),
    }


def word_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep plus the STATS (bigint) of every whole text; a null text counts like an empty one, other columns are left out."""
    rows = picked(docs, *keep, text)
    names = list(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{s} bigint" for s in STATS])

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                stats = count_slice(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(stats[s], pa.int64()) for s in STATS], names=[*names, *STATS])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    """The fixed rule: too short, or mostly made of repeated 3-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios(stats: DataFrame) -> DataFrame:
    """Add the RATIOS; a text without words has zeros."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return stats.withColumns({
        "symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words"),
    })


def _limits(sketch: str, slack: float) -> list[Column]:
    """Low and high limit from a sketch: the middle half, widened by WIDTH times its own width and at least by slack."""
    at = lambda q: F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))
    spread = F.greatest(WIDTH * (at(0.75) - at(0.25)), F.lit(slack))
    return [at(0.25) - spread, at(0.75) + spread]


def thresholds(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per group of by: `low_<ratio>`, `high_<ratio>` from its own sketch, or from a wider one if it has few rows.

    Levels are by, then by without its last column, and so on to the whole table; a level's sketches are merged from the level
    below. Null keys form groups of their own. An empty table gives no rows.
    """
    sketches = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n0"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(f"{r}0") for r in RATIOS])
    level = sketches = cut(sketches)
    for depth in range(1, len(by) + 1):
        keys, d = by[: len(by) - depth], depth - 1
        level = level.groupBy(*keys).agg(F.sum(f"n{d}").alias(f"n{depth}"), *[F.kll_merge_agg_double(f"{r}{d}").alias(f"{r}{depth}") for r in RATIOS])
        wide = level.select(*[F.col(k).alias(f"_{k}") for k in keys], f"n{depth}", *[f"{r}{depth}" for r in RATIOS])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        # The last level is a single row.
        sketches = sketches.join(wide if keys else F.broadcast(wide), same, "left" if keys else "inner").drop(*[f"_{k}" for k in keys])
    limits = {}
    for r, slack in RATIOS.items():
        for side, name in enumerate(("low", "high")):
            value = _limits(f"{r}{len(by)}", slack)[side]
            for d in reversed(range(len(by))):
                value = F.when(F.col(f"n{d}") >= MIN_GROUP, _limits(f"{r}{d}", slack)[side]).otherwise(value)
            limits[f"{name}_{r}"] = value
    return sketches.select(*by, *[v.alias(k) for k, v in limits.items()])


def judge(stats: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Add base_failed, the reasons of the method (ratios outside the group's limits) and kept.

    The limits come from the rows that pass the fixed rule, so junk does not set them.
    """
    rows = cut(ratios(stats).withColumn("base_failed", base_failed()))
    limits = thresholds(rows.filter(~F.col("base_failed")), by)
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(limits.withColumnsRenamed({k: f"_{k}" for k in by}), same, "left").drop(*[f"_{k}" for k in by])
    outside = [F.when((F.col(r) > F.col(f"high_{r}")) | (F.col(r) < F.col(f"low_{r}")), F.lit(r)) for r in RATIOS]
    return joined.withColumn("reasons", F.array_compact(F.array(*outside))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def quality_filter(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), keep: str = "doc_id") -> DataFrame:
    """doc_id, by, the counts, base_failed, reasons and kept of every row; repeated rows are judged one by one."""
    return judge(word_stats(docs, text, (keep, *by)), by)
