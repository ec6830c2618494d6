"""Benchmark decontamination on templates.

Texts are canonicalised word by word: numbers, names and units after numbers become typed placeholders, everything else stays as a folded
word. Windows of WINDOW canonical words are hashed and joined between documents and benchmark items. A joined window says that the frame is the
same; the slots say whether the filling is: along one alignment every value of the item must stand for one value of the document, wherever it
recurs. Such an alignment is the item itself or the item with other numbers and names.

Names are told by their capitals, so windows come in two views: typed, with names as placeholders, and plain, with names as folded words. A copy
of an item in other case (shouted, small, every word capitalised) is met in the plain view. Other names in such a copy are not told from words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import Flat, byte_table, constants, picked, span_hashes, text_slices, window_hashes
from weighbridge.session import broadcast_if_small, cut

WINDOW = 8
LITERALS = 4  # words of a window that are no placeholders, at least; half of a shorter window
COVERAGE = 0.5  # of an item's windows, for the item to count as met
SHORTEST = 5  # an item of fewer words cannot be told from common speech and is never met
FILTER_ROWS = 4_000_000  # benchmark windows whose hashes travel to the tasks (8 bytes each); beyond, every window goes to the join
JOIN_ROWS = 200_000  # benchmark windows that are broadcast to the join

# Number words and units that stand behind numbers, by kind.
NUMBER_WORDS = """one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand million
deux trois quatre cinq sept huit neuf dix onze douze vingt cent mille zwei drei vier sechs sieben acht neun zehn elf hundert tausend
dos tres cuatro cinco seis siete ocho nueve diez once doce veinte ciento mil""".split()
UNITS = {
    "length": "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres",
    "mass": "mg g kg ton tons gram grams kilogram kilograms pound pounds ounce ounces lb oz",
    "time": "s ms min h second seconds minute minutes hour hours day days week weeks month months year years heures jours stunden tage horas",
    "money": "dollar dollars euro euros cent cents usd eur pesos yen",
    "volume": "ml l liter liters litre litres gallon gallons cup cups",
    "share": "percent prozent pourcent",
    "speed": "mph kmh kph",
    "energy": "watt watts kw kwh volt volts joule joules",
}

TYPED, PLAIN = 0, 1  # views of a window

DIGIT = byte_table((48, 57))
CAPITAL = byte_table((65, 90))
SMALL = np.array([not chr(c).isupper() and chr(c).isalpha() for c in range(0x110000)])  # letters, by code point, that are no capitals
WORD = byte_table((1, 1), (48, 57), (65, 90), (97, 122), (128, 255))  # 1 stands for a point or comma inside a number
STOP = byte_table(*[(ord(c), ord(c)) for c in ".!?:\n"])


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return span_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends, True)


class Lexicon:
    """Sorted hashes of number words and units, and the placeholders' hashes."""

    def __init__(self) -> None:
        self.numbers = np.sort(_hashes_of(NUMBER_WORDS))
        pairs = [(w, k) for k, words in enumerate(UNITS.values()) for w in words.split()]
        hashes = _hashes_of([w for w, _ in pairs])
        order = np.argsort(hashes)
        self.units, self.kind = hashes[order], np.array([k for _, k in pairs])[order]
        marks = constants(2 + len(UNITS), 4000)
        self.number, self.name, self.unit = marks[0], marks[1], marks[2:]


def folded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without case, and their offsets. No mapping makes or ends a word, so word i stays word i; upper() first joins what only
    capitals join (the dotless i)."""
    if not (raw > 127).any():
        low = raw.copy()
        low[CAPITAL[raw]] += 32
        return low, offsets
    whole = raw.tobytes()
    # Bytes that are no UTF-8 pass as they are.
    texts = [whole[a:b].decode("utf-8", "surrogateescape").upper().casefold().encode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def joined_numbers(raw: np.ndarray) -> np.ndarray:
    """raw with the points and commas inside numbers made word bytes."""
    data, digit = raw.copy(), DIGIT[raw]
    if len(raw) > 2:
        joint = ((raw[1:-1] == 44) | (raw[1:-1] == 46)) & digit[:-2] & digit[2:]
        data[1:-1][joint] = 1
    return data


def small_after(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Is the character behind the one at start a letter that is no capital."""
    point = (raw & 0xC0) != 0x80
    small = np.append(SMALL[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)], False)
    return small[np.minimum(np.cumsum(point)[start], len(small) - 1)]


class Canonical:
    """Canonical words of several texts: code (hash of word or placeholder) and slot (is it a placeholder) by view, value (hash without case)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon):
        data = joined_numbers(raw)
        self.flat = flat = Flat(data, offsets, WORD)
        low, low_offsets = folded(raw, offsets)
        words = Flat(joined_numbers(low), low_offsets, WORD).hashes()
        self.value = words
        head = data[flat.start]
        second = data[np.minimum(flat.start + 1, max(len(data) - 1, 0))] if len(data) else head
        accented = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        # Capital letters of ASCII and of the Latin-1 block (two bytes, 0xC3 0x80 to 0x9E).
        # A word in capitals throughout is no name: text is also shouted.
        long_ = flat.end - flat.start > np.where(accented, 2, 1)
        capital = long_ & (CAPITAL[head] | accented) & small_after(raw, flat.start)
        stops = np.concatenate([[0], np.cumsum(STOP[data])])
        before = np.concatenate([[0], flat.end[:-1]]) if len(words) else np.zeros(0, np.int64)
        opening = stops[flat.start] > stops[np.minimum(before, flat.start)]
        opening[flat.first[:-1][flat.counts > 0]] = True
        number = DIGIT[head] | np.isin(words, lexicon.numbers)
        name = capital & ~opening & ~number
        after = np.zeros(len(words), bool)
        after[1:] = number[:-1]
        after[flat.first[:-1][flat.counts > 0]] = False
        at = np.minimum(np.searchsorted(lexicon.units, words), len(lexicon.units) - 1)
        unit = after & (lexicon.units[at] == words) & ~number
        plain = np.where(number, lexicon.number, words)
        plain[unit] = lexicon.unit[lexicon.kind[at[unit]]]
        self.name = name & ~unit
        self.code = {TYPED: np.where(self.name, lexicon.name, plain), PLAIN: plain}
        self.slot = {TYPED: number | name | unit, PLAIN: number | unit}

    def windows(self, size: int, view: int, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of the windows of size words with enough literals; named: only of those that hold a name."""
        first, bounds = self.flat.windows(size)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        within = lambda marks: (total := np.concatenate([[0], np.cumsum(marks)]))[first + size] - total[first]
        keep = size - within(self.slot[view]) >= min(LITERALS, -(-size // 2))
        if named:
            keep &= within(self.name) > 0
        first, text = first[keep], text[keep]
        return first, text, window_hashes(self.code[view], first, size)


def _rows(canonical: Canonical, first: np.ndarray, text: np.ndarray, hashes: np.ndarray, size: int, view: int, part: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """One row a window: keep, its hash, its place in words and the values of its slots in order."""
    inside = first[:, None] + np.arange(size)
    slot = canonical.slot[view][inside]
    counts = slot.sum(axis=1)
    values = canonical.value[inside[slot]].view(np.int64)
    take = pa.array(text)
    return pa.RecordBatch.from_arrays(
        [part.column(k).take(take) for k in keep]
        + [pa.array(hashes.view(np.int64)), pa.array((first - canonical.flat.first[text]).astype(np.int32)),
           pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))],
        names=[*keep, "hash", "place", "slots"])


ROW = "hash bigint, place int, slots array<bigint>"


def item_windows(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item, size, hash, place, slots, view) of every item's windows; an item shorter than WINDOW is one window a view."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                c = Canonical(raw, offsets, lexicon)
                for size in range(SHORTEST, WINDOW + 1):
                    for view in (TYPED, PLAIN):
                        first, owner, hashes = c.windows(size, view)
                        fits = np.minimum(c.flat.counts[owner], WINDOW) == size
                        rows = _rows(c, first[fits], owner[fits], hashes[fits], size, view, part, ["item"])
                        more = [pa.array(np.full(rows.num_rows, x, np.int32)) for x in (size, view)]
                        yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "size", "view"])

    return items.select(F.col(item_id).alias("item"), text).mapInArrow(run, f"item {kind}, {ROW}, size int, view int")


def document_windows(docs: DataFrame, text: str, doc_id: str, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(doc, version, hash, place, slots) of the documents' windows of the given sizes whose hash is wanted (None: of all), in both views;
    windows without names are the same in both and come once.

    version is the text's hash: it keeps rows apart that share an id but not a text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                c = Canonical(raw, offsets, lexicon)
                for size, view in [(s, v) for s in sizes for v in (TYPED, PLAIN)]:
                    first, owner, hashes = c.windows(size, view, named=view == PLAIN)
                    if wanted is not None:
                        hit = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                        first, owner, hashes = first[hit], owner[hit], hashes[hit]
                    if len(first):
                        yield _rows(c, first, owner, hashes, size, view, part, ["doc", "version"])

    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), text)
    return picked(rows, "doc", "version", text).mapInArrow(run, f"doc {kind}, version bigint, {ROW}")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document text and item it contains: doc, version, item, windows (of the item), matched, coverage, changed.

    changed counts slots filled with another value: 0 is the item word for word in any case, more is the item re-parameterised. Windows are
    counted in the view that covers more of the item. Null and empty texts
    on either side and items under SHORTEST words match nothing; repeated rows give one row; an empty table gives none.
    """
    windows = cut(item_windows(items.filter(F.col(item_id).isNotNull()), item_text, item_id))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW - SHORTEST + 1
    n = windows.count()
    wanted = None
    if 0 < n <= FILTER_ROWS:
        wanted = np.unique(windows.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))
    found = document_windows(docs, text, doc_id, sizes, wanted)
    item = windows.select("item", "view", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = found.join(broadcast_if_small(item, n, JOIN_ROWS), "hash")
    # One alignment of a document and an item has at most the item's windows.
    aligned = met.withColumn("shift", F.col("place") - F.col("item_place")).groupBy("doc", "version", "item", "view", "shift").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "slots")))).alias("filled"))
    values = F.array_distinct(F.transform("filled", lambda x: x["item_slots"]))
    consistent = aligned.filter(F.size(values) == F.size("filled"))
    changed = F.size(F.filter("filled", lambda x: x["item_slots"] != x["slots"]))
    best = consistent.select("doc", "version", "item", "view", changed.alias("changed"), F.explode("places").alias("at"))
    seen = best.groupBy("doc", "version", "item", "view").agg(F.count_distinct("at").alias("matched"), F.max("changed").alias("changed"))
    total = windows.groupBy("item", "view").agg(F.count_distinct("place").alias("windows"))
    out = seen.join(broadcast_if_small(total, n, JOIN_ROWS), ["item", "view"]).withColumn("coverage", F.col("matched") / F.col("windows"))
    more = F.max_by(F.struct("windows", "matched", "coverage", "changed"), F.struct("coverage", -F.col("changed"), "matched"))
    return out.filter(F.col("coverage") >= COVERAGE).groupBy("doc", "version", "item").agg(more.alias("m")).select("doc", "version", "item", "m.*")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs that hold no item; all columns stay."""
    bad = cut(leaks(docs, items, text, doc_id, item_text, item_id).select(F.col("doc").alias("_doc"), F.col("version").alias("_version")).distinct())
    same = F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_version"))
    return docs.join(broadcast_if_small(bad, bad.count()), same, "left_anti")
