"""Secrets in texts and in what is encoded inside them.

A worklist holds layers of a text. Every layer is scanned; then what it wraps is unwrapped: percent escapes, Unicode escapes, base64 runs,
and compressed data inside base64, in either alphabet and over single line breaks. New layers go on the list until none is new: a layer met before is not scanned again, so data that
unpacks into itself ends. Each layer knows, for every character, which characters of the whole text it came from, so a secret found
five layers deep is reported where it stands in the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import byte_table, picked, text_slices

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are greedy, so these are the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_BASE64 = 8, 16, 32, 16
LAYER_BYTES = 64 << 20  # an unpacked layer beyond this is a bomb: it is counted as unread, never cut

PERCENT = r"(?:%[0-9A-Fa-f]{2})+"
ESCAPES = r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+"
ONE_ESCAPE = r"\\[uU]\{?([0-9A-Fa-f]+)\}?|\\x([0-9A-Fa-f]{2})"
ALPHABETS = ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]")
# One run or several over single line breaks, one of them long enough; the first may stand behind other text and be short.
BASE64 = [rf"(?:{a}++\r?\n[ \t]*+)?{a}{{16,}}+(?:\r?\n[ \t]*+{a}++)*+={{0,2}}+" for a in ALPHABETS]


class Unread(Exception):
    """A layer too large to unpack."""


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one layer: leftmost non-overlapping matches per kind, failing ones dropped afterwards."""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in re.finditer(ACCESS, text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in re.finditer(HEX, text)]


def inflate(data: bytes) -> bytes | None:
    """The content of gzip, zlib, bzip2 or xz data, None if it is none of these or broken."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
        make = lambda: zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\x00":
        make = lzma.LZMADecompressor
    else:
        return None
    unpack = make()
    try:
        out = unpack.decompress(data, LAYER_BYTES + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None
    if len(out) > LAYER_BYTES:
        raise Unread
    return out if unpack.eof else None


def readable(data: bytes) -> str | None:
    """data as text if it is UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search("[\x00-\x08\x0e-\x1f\x7f]", text) else None


def unwrap_base64(run: str) -> str | None:
    """The text inside one base64 run, through any compression around it."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) < MIN_BASE64 or len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    while (inner := inflate(data)) is not None and inner != data:
        data = inner
    return readable(data)


def _lines(text: str) -> list[list[tuple[int, int]]]:
    """Lists of (start, end) of the lines that may be one base64 run, for either alphabet; a run of one line is a list of one."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for pattern, letter in zip(BASE64, ALPHABETS, strict=True):
        for m in re.finditer(pattern, text):
            runs = [(r.start() + m.start(), r.end() + m.start()) for r in re.finditer(letter + "+", m[0])]
            runs[-1] = (runs[-1][0], m.end())
            n = [b - a for a, b in runs]
            for i in range(len(runs)):
                if n[i] >= MIN_BASE64:
                    out[runs[i]] = runs[i: i + 1]
                # Wrapped lines have one width, the first and the last may be shorter: a run starts where widths change and ends where they do.
                if i + 1 < len(runs) and (i < 2 or n[i] != n[i - 1] or n[i + 1] != n[i]):
                    j = i + 2
                    out[runs[i][0], runs[j - 1][1]] = runs[i:j]
                    while j < len(runs) and n[j] == n[i + 1]:
                        j += 1
                    for k in {j, min(j + 1, len(runs))}:
                        out[runs[i][0], runs[k - 1][1]] = runs[i:k]
    return list(out.values())


def base64_layers(text: str, unread: list | None = None) -> list[tuple[int, int, str]]:
    """(start, end, content) of the base64 runs of a text, the longest first; a part whose content a longer run holds is left out."""
    found: list[tuple[int, int, str]] = []
    inside: set[tuple[int, int]] = set()  # lines of decoded runs that begin with a whole group of four letters
    whole: list[int] = []  # starts and ends of decoded runs of one line, in text order
    ends: list[int] = []
    for lines in sorted(_lines(text), key=lambda x: (x[0][0] - x[-1][1], x[0][0])):
        start, end = lines[0][0], lines[-1][1]
        if (start, end) in inside or len(lines) == 1 and (at := bisect_right(whole, start) - 1) >= 0 and end <= ends[at] and (start - whole[at]) % 4 == 0:
            continue
        try:
            content = unwrap_base64("".join(text[a:b] for a, b in lines))
        except Unread:
            if unread is not None:
                unread.append(start)
                continue
            raise
        if content is None:
            continue
        # Compressed data ends by itself: lines behind its end are not of the run.
        while len(lines) > 1 and unwrap_base64("".join(text[a:b] for a, b in lines[:-1])) == content:
            lines = lines[:-1]
            end = lines[-1][1]
        found.append((start, end, content))
        before = 0
        for a, b in lines:
            if before % 4 == 0:
                inside.add((a, b))
            before += b - a
        if len(lines) == 1:
            at = bisect_right(whole, start)
            whole.insert(at, start)
            ends.insert(at, end)
    return found


def _percent(run: str) -> list[tuple[str, int]] | None:
    """Decoded characters of a run of percent escapes with the length each had there."""
    text = readable(bytes.fromhex(run.replace("%", "")))
    return None if text is None else [(c, 3 * len(c.encode())) for c in text]


def _escaped(run: str) -> list[tuple[str, int]] | None:
    """Decoded characters of a run of Unicode escapes, surrogate pairs joined."""
    out: list[tuple[str, int]] = []
    for m in re.finditer(ONE_ESCAPE, run):
        code = int(m[1] or m[2], 16)
        if code > 0x10FFFF:
            return None
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, size = out.pop()
            code = 0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00
            out.append((chr(code), size + len(m[0])))
        else:
            out.append((chr(code), len(m[0])))
    return out


class Layer:
    """A text whose character i came from characters start[i] to end[i] of the whole text."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, depth: int):
        self.text, self.start, self.end, self.depth = text, start, end, depth

    def rewritten(self, pattern: str, decode) -> Layer | None:
        """This layer with every decodable match of pattern replaced; None if there is none."""
        pieces, starts, ends, at = [], [], [], 0
        for m in re.finditer(pattern, self.text):
            chars = decode(m[0])
            if chars is None:
                continue
            sizes = np.array([n for _, n in chars])
            last = m.start() + np.cumsum(sizes)
            pieces += [self.text[at: m.start()], "".join(c for c, _ in chars)]
            starts += [self.start[at: m.start()], self.start[last - sizes]]
            ends += [self.end[at: m.start()], self.end[last - 1]]
            at = m.end()
        if not pieces:
            return None
        text = "".join(pieces) + self.text[at:]
        return Layer(text, np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]), self.depth + 1)

    def unwrapped(self, unread: list) -> list[Layer]:
        """The layers directly inside this one."""
        found = [x for x in (self.rewritten(PERCENT, _percent), self.rewritten(ESCAPES, _escaped)) if x]
        for start, end, text in base64_layers(self.text, unread):
            whole = np.ones(len(text), np.int64)
            found.append(Layer(text, whole * self.start[start], whole * self.end[end - 1], self.depth + 1))
        return found


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]], int]:
    """(base spans, all spans with the depth they were found at, layers too large to read) of one text, in code points."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(plain_spans(text), key=order)
    every = {s: 0 for s in base}
    unread: list[int] = []
    at = np.arange(len(text))
    todo, seen = [Layer(text, at, at + 1, 0)], {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    while todo:
        layer = todo.pop()
        if layer.depth:
            for start, end, kind in plain_spans(layer.text):
                every.setdefault((int(layer.start[start]), int(layer.end[end - 1]), kind), layer.depth)
        for inner in layer.unwrapped(unread):
            # A layer is its text and where it stands: the same token twice is two finds, a loop is none.
            mark = hashlib.sha256(inner.text.encode("utf-8", "surrogatepass") + b"%d:%d" % (inner.start[0], inner.end[-1])).digest()
            if inner.text and mark not in seen:
                seen.add(mark)
                todo.append(inner)
    return base, [(*s, every[s]) for s in sorted(every, key=order)], len(unread)


def long_runs(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of least or more bytes of table."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = table[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A run may reach over borders of texts; a gate may only err towards more.
    keep = end - start >= least
    start, end = start[keep], end[keep]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts of a slice that may hold a secret or a layer; a quick look that misses none."""
    flag = np.zeros(len(offsets) - 1, bool)
    for t, _, b in zip(*long_runs(raw, offsets, byte_table((48, 57), (97, 102)), MIN_HEX), strict=True):
        flag[t: np.searchsorted(offsets, b - 1, "right")] = True
    for mark in (b"%", b"\\"):
        at = np.flatnonzero(raw == mark[0])
        at = at[at + 1 < len(raw)]
        ok = byte_table((48, 57), (65, 70), (97, 102)) if mark == b"%" else byte_table(*[(ord(c), ord(c)) for c in "uUx"])
        flag[np.searchsorted(offsets, at[ok[raw[at + 1]]], "right") - 1] = True
    token = byte_table((48, 57), (65, 90), (97, 122), (43, 43), (47, 47), (45, 45), (95, 95))
    for t, a, b in zip(*long_runs(raw, offsets, token, MIN_BASE64), strict=True):
        last = np.searchsorted(offsets, b - 1, "right") - 1
        if last != t:  # also if t is flagged: the others may not be
            flag[t: last + 1] = True
        elif not flag[t]:
            # A run at a line break may go on in the next line or begin in the one before.
            if b < len(raw) and raw[b] in b"\r\n" or raw[:a][-64:].tobytes().rstrip(b" \t")[-1:] in (b"\n", b""):
                flag[t] = True
                continue
            try:
                flag[t] |= bool(base64_layers(raw[a:b].tobytes().decode("ascii")))
            except Unread:
                flag[t] = True
    return flag


def secret_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep plus base and spans (arrays of kind, start, end and the depth of the layer) and unread, a row for every row.

    Offsets are code points, ends exclusive. A null text counts as an empty one and has no spans; repeated rows are scanned one by
    one; other columns are left out. unread counts layers that unpack to more than LAYER_BYTES.
    """
    rows = picked(docs, *keep, text)
    span = "array<struct<kind:string,start:int,`end`:int,depth:int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"base {span}", f"spans {span}", "unread int"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                base, spans, unread = [], [], []
                flags = suspects(raw, offsets)
                whole = raw.tobytes()
                for i, suspect in enumerate(flags):
                    data = whole[offsets[i]: offsets[i + 1]]
                    if not suspect:
                        low = data.lower()
                        suspect = b"AKIA" in data or any(w.encode() in low for w in WORDS)
                    found, every, lost = scan_text(data.decode("utf-8")) if suspect else ([], [], 0)
                    base.append([{"kind": k, "start": s, "end": e, "depth": 0} for s, e, k in found])
                    spans.append([{"kind": k, "start": s, "end": e, "depth": d} for s, e, k, d in every])
                    unread.append(lost)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(base, kind), pa.array(spans, kind), pa.array(unread, pa.int32())],
                                                 names=[*keep, "base", "spans", "unread"])

    return rows.mapInArrow(run, schema)


def span_text(column: str):
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
