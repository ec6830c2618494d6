"""Texts of an Arrow batch as flat NumPy arrays: words, hashes and windows of many texts at once.

Everything works on the UTF-8 bytes, so a batch costs a few vector passes and no Python loop over words.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weighbridge.session import spread

SLICE_BYTES = 1 << 20  # texts handled at once; one longer text is a slice of its own
MULTIPLIER = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(MULTIPLIER))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of the 256 byte values in inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low: high + 1] = True
    return table


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) pieces of a batch; text i of a piece is bytes[offsets[i]:offsets[i + 1]]."""
    if not batch.num_rows:
        return
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[array.offset: array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(array):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, len(array))
        yield batch.slice(start, stop - start), raw[offsets[start]: offsets[stop]], offsets[start: stop + 1] - offsets[start]
        start = stop


class Flat:
    """Words of several texts: word w is bytes[start[w]:end[w]], words of text i are first[i]..first[i + 1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, fold: bool = False):
        """word tells the bytes words are made of; fold hashes ASCII capitals like small letters."""
        self.raw, self.offsets, self.fold = raw, offsets, fold
        inside = word[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        borders = offsets[(offsets > 0) & (offsets < len(raw))]
        before[borders] = False
        after[borders - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return span_hashes(self.raw, self.start, self.end, self.fold)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of size words, and the windows' bounds per text."""
        full = np.maximum(self.counts - size + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(full)])
        first = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], full)
        return first, bounds


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over per-byte random numbers, read off one running sum."""
    values = constants(256, 11)
    if fold:
        values[65:91] = values[97:123]
    with np.errstate(over="ignore"):
        powers = np.full(len(raw) + 1, MULTIPLIER, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(len(raw) + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * powers[:-1], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the windows of size word hashes that begin at first."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(first), np.uint64)
        for k, c in enumerate(constants(size, 101) | np.uint64(1)):
            total += words[first + k] * c
        return mix(total)


def repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: is it met twice or more inside its group, and is it an equal of an earlier one there.

    Keys are in text order, so the stable sort puts the first of equal keys first.
    """
    order = np.lexsort((keys, groups))
    k, g = keys[order], groups[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges of bounds, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def picked(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, whatever else the table holds, over enough partitions to use the cores."""
    return spread(docs.select(*columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column so called, for helper columns beside the caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
