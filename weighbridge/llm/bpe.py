"""Byte-pair encoding by a token automaton.

The automaton reads arcs labelled with tokens and accepts exactly the token sequences that the merges produce. It starts as one state
with an arc for every byte. A merge (a, b) adds its gadget: wherever an a-arc is followed by a b-arc, an ab-arc goes straight to where b
went, and all a-arcs are sent to a copy of their state that has no b-arc. All arcs of one label end in one state, so a gadget is three
table entries: the new arc's state descends from b's state as it stood, and a's state loses one arc from now on.

A pre-split word has one path. It is found by a byte trie over the arc labels and the transition table, longest label first, a step back
where a state lacks the arc. Decoding emits the labels.
"""

from __future__ import annotations

import json
import sys
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.llm.flat import SLICE_BYTES

# Fixed value: the published splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
WORDS_KEPT = 1 << 18  # words met last that a worker remembers, and as many met before them
ARCS_KEPT = 1 << 19  # pairs of a state and an arc that a worker remembers; the memory starts anew when it is full
LONGEST_KEPT = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabulary files use for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Labels by token id, merges as (left id, right id, new id) in order of rank, and tokens that are cut out before splitting."""

    labels: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level vocabulary file (JSON with vocab, merges and added tokens)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, ids = byte_letters(), data["model"]["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    labels = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in ids.items():
        labels[i] = text.encode() if text in special else bytes(letters[c] for c in text)
    for text, i in special.items():
        labels[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return Vocabulary(labels, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special)


class Automaton:
    """States are named by the label of the arcs that end in them; they exist as what their gadgets took away."""

    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        n = len(self.labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.lost: dict[tuple[int, int], int] = {}  # (state, arc) -> the gadget that removed the arc from the state
        self.byte = [-1] * 256
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        made = {c for _, _, c in vocabulary.merges}
        for i, label in enumerate(self.labels):
            if len(label) == 1 and i not in made:
                self.byte[label[0]] = i
                self._add_label(i)
        for rank, (a, b, c) in enumerate(vocabulary.merges):
            self._gadget(rank, a, b, c)
        self.allowed: dict[int, bool] = {}  # by state * labels + arc

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if self.left[c] < 0:
            self.left[c], self.right[c], self.born[c] = a, b, rank  # c-arcs end in b's state of this moment
            self._add_label(c)
        self.lost.setdefault((a, b), rank)  # from here on a-arcs end in a copy without b

    def _add_label(self, token: int) -> None:
        node = 0
        for x in self.labels[token]:
            if x not in self.trie[node]:
                self.trie[node][x] = len(self.trie)
                self.trie.append({})
                self.token_at.append(-1)
            node = self.trie[node][x]
        self.token_at[node] = token

    def has_arc(self, state: int, arc: int) -> bool:
        """Does the state after one token have an arc for another; worked out once for every pair met.

        The state descends from the states of its last part, of that part's last part and so on, each as it stood when the next was
        made. The arc was built from its first part, and so on: it is missing if one of these was lost before it was built upon.
        """
        pair = state * len(self.labels) + arc
        known = self.allowed.get(pair)
        if known is None:
            known, s, until = True, state, NEVER
            while s >= 0 and known:
                a, built = arc, NEVER
                while a >= 0:
                    at = self.lost.get((s, a))
                    if at is not None and at < until and at <= built:
                        known = False
                        break
                    a, built = self.left[a], self.born[a]
                s, until = self.right[s], self.born[s]
            if len(self.allowed) >= ARCS_KEPT:
                self.allowed.clear()
            self.allowed[pair] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The arcs of the one accepted path that spells word."""
        path: list[int] = []
        ends: list[int] = []
        choices: list[list[tuple[int, int]]] = []
        dead: set[tuple[int, int]] = set()
        at, last = 0, -1
        trie, token_at = self.trie, self.token_at
        while at < len(word):
            options, node = [], 0
            for i in range(at, len(word)):
                node = trie[node].get(word[i], -1)
                if node < 0:
                    break
                if token_at[node] >= 0:
                    options.append((token_at[node], i + 1))  # longest last
            while True:
                while options:
                    token, end = options.pop()
                    if (last < 0 or self.has_arc(last, token)) and (end, token) not in dead:
                        break
                else:
                    if not path:
                        raise ValueError(f"no tokens spell {word!r}")
                    dead.add((ends.pop(), path.pop()))
                    options = choices.pop()
                    at, last = (ends[-1], path[-1]) if path else (0, -1)
                    continue
                break
            path.append(token)
            ends.append(end)
            choices.append(options)
            at, last = end, token
        return path


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.automaton = Automaton(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.special = vocabulary.special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        sizes = np.array([len(x) for x in vocabulary.labels], np.int64)
        self.size, self.begin = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.ink = np.frombuffer(b"".join(vocabulary.labels), np.uint8)

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.automaton.encode(word.encode())).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        words = self.split(text)
        known = self.words.get
        out = [known(w) for w in words]
        if None in out:
            out = [self.words.get(w) or self._word(w) if x is None else x for w, x in zip(words, out, strict=True)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Token ids as 32-bit numbers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.int32(self.special[x]).tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text) if x)

    def emit(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The labels of every list of ids, joined; a list is ids[bounds[i]:bounds[i + 1]]."""
        size = self.size[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        out = self.ink[np.repeat(self.begin[ids] - place[:-1], size) + np.arange(place[-1])].tobytes()
        edge = place[bounds]
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def encoded(self, texts: pa.Array) -> pa.ListArray:
        """The ids of every text."""
        parts = [b"" if t is None else self.encode(t) for t in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """The text of every list of ids."""
        out: list[str | None] = []
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lists):  # some MB of output at a time
            stop = min(len(lists), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1))
            some = self.emit(flat[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at])
            out += [x.decode("utf-8", "replace") for x in some]
            at = stop
        if lists.null_count:
            valid = lists.is_valid().to_pylist()
            out = [x if v else None for x, v in zip(out, valid, strict=True)]
        return pa.array(out, pa.string())


def codec(shared, name: str) -> Codec:
    """One codec a worker process and vocabulary; kept with the interpreter, as task functions are made anew for every task."""
    kept = sys.__dict__.setdefault("_token_codecs", {})
    if name not in kept:
        kept[name] = Codec(Vocabulary(*shared.value))
    return kept[name]


class ByteBPE:
    """Column functions for one vocabulary file, which only the driver reads."""

    def __init__(self, spark, path: str):
        # 50,000 labels and merges, some 2 MB, whatever the data; plain types, as executors need no copy of this package.
        v = load_vocabulary(path)
        self.shared = spark.sparkContext.broadcast((v.labels, v.merges, v.special))
        self.name = path

    def encode(self, text: str | Column) -> Column:
        """array<int> of the whole text's token ids; a null text counts as an empty one and has none."""
        shared, name = self.shared, self.name

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            return codec(shared, name).encoded(texts)

        # Called non-deterministic so that the optimizer does not copy it into every expression over the ids.
        return run.asNondeterministic()(text)

    def decode(self, ids: str | Column) -> Column:
        """The text that token ids spell, special tokens included; bytes that are not UTF-8 become U+FFFD; null stays null."""
        shared, name = self.shared, self.name

        @F.arrow_udf("string")
        def run(lists: pa.Array) -> pa.Array:
            return codec(shared, name).decoded(lists)

        return run(ids)

    def round_trip(self, text: str | Column) -> Column:
        """struct<ids: array<int>, text: string>: the ids of the text as encode() has them, and what decode() makes of these ids.

        Both come from one Python worker a task; encode() and decode() in one query take two, each with its own vocabulary and words.
        """
        shared, name = self.shared, self.name

        @F.arrow_udf("struct<ids: array<int>, text: string>")
        def run(texts: pa.Array) -> pa.Array:
            c = codec(shared, name)
            ids = c.encoded(texts)
            return pa.StructArray.from_arrays([ids, c.decoded(ids)], names=["ids", "text"])

        return run.asNondeterministic()(text)
