"""Word windows of whole Arrow columns, hashed in vector passes, and a mergeable bitmap of hashes without false negatives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text handled at once; a longer text is one slice
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = True  # words are [a-z0-9]+ of lower-cased text

PROBES = 4
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29  # 8 kB to 64 MB; a fuller bitmap lets more pass, it loses nothing


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Windows:
    """Windows of size words of several texts: window k is of text owner[k] and spells data[start[k]:stop[k]]."""

    data: np.ndarray
    owner: np.ndarray
    first: np.ndarray  # index of the window's first word
    starts: np.ndarray  # of words
    stops: np.ndarray
    hashes: np.ndarray
    size: int

    def text(self, k: int) -> str:
        """The window's words with one space between them."""
        words = range(self.first[k], self.first[k] + self.size)
        return " ".join(self.data[self.starts[w]: self.stops[w]].tobytes().decode() for w in words)


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


def rolled(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of spans of values, each the difference of two running sums brought to one power."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), len(values) + 1)
        return scramble((sums[stop] - sums[start]) * back[start])


def slices(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of pieces of a string column; a null is an empty text."""
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, where, data = array.buffers()
    if not len(array):
        return
    at = np.frombuffer(where, width)[array.offset: array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(array):
        high = min(len(array), max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1))
        yield low, high, raw[at[low]: at[high]], at[low: high + 1] - at[low]
        low = high


def word_windows(data: np.ndarray, offsets: np.ndarray, size: int, seed: int = 0) -> Windows:
    """All windows of size words; a word does not reach over a text's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTERS[data]
    turns = np.diff(inside.astype(np.int8))
    starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    # Where one text ends in a word and the next one begins with a word, the run is cut.
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    if len(cut):
        starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
    words = rolled(scramble(data.astype(np.uint64) + np.uint64(1 + 1000 * seed)), starts, stops, 0x9E3779B97F4A7C15)
    begin = np.searchsorted(starts, offsets)
    full = np.maximum(np.diff(begin) - size + 1, 0)
    before = np.cumsum(full) - full
    first = np.arange(int(full.sum())) + np.repeat(begin[:-1] - before, full)
    return Windows(data, np.repeat(np.arange(len(full)), full), first, starts, stops, rolled(words, first, first + size, 0xD1342543DE82EF95), size)


def first_of_each(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of one window for every distinct (text, hash)."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return order[new]


class Bitmap:
    """A Bloom filter over 64-bit hashes; bitmaps of one size merge by or."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    @staticmethod
    def size_for(keys: int) -> int:
        """Bits for so many keys at most: a power of two within fixed bounds."""
        return min(MOST_BITS, max(LEAST_BITS, 1 << max(1, keys * BITS_A_KEY - 1).bit_length()))

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = scramble(hashes + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
            for k in range(PROBES):
                yield (hashes + np.uint64(k) * step) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.intp), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """True for every hash that was added, and for few others."""
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.data[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out
