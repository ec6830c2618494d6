"""Surrogates for personal data.

Every detected entity is replaced by a keyed surrogate of its own kind and shape: the same entity gets the same surrogate everywhere, other
entities get other ones. Numbers, addresses and mail names are permuted by a keyed Feistel network over their own alphabet, so digits stay digits,
letters of a script stay letters of that script, separators and case stay, card and account checks stay right or wrong. Names are made
from syllables of their script with an ending for their gender; given and family names are replaced apart, so a later "Ms Miller" still
refers to the "Jane Miller" before.

Surrogates are checked over the whole corpus: one that equals a real entity, or that two entities share, is drawn again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import Flat, byte_table, per_text, picked, span_hashes, text_slices, unused
from weighbridge.session import broadcast_if_small, cut

ROUNDS = 8  # of the Feistel network
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "account", "given_f", "given_m", "given_n", "family")

# Titles by gender, and common given names by gender.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Signora г-жа Госпожа",
    "m": "Mr Sir Herr Monsieur Señor Sr Don Signor г-н Господин",
    "n": "Dr Prof Professor",
}
GIVEN = {
    "f": """Alice Amelia Ana Anna Barbara Camille Carmen Caroline Catherine Charlotte Chloe Clara Claire Elena Elizabeth Emily Emma Eva Grace
        Greta Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lucia Margaret Maria Marie Martha Mary
        Nancy Olivia Patricia Rosa Ruth Sabine Sandra Sara Sarah Sofia Sophie Susan Ursula Анна Елена Мария Ольга Татьяна""",
    "m": """Adam Albert Alexander Andrew Antoine Anthony Antonio Benjamin Bob Carlos Charles Christopher Daniel David Diego Edward Francisco
        François Frank Friedrich George Günther Hans Harry Heinrich Henry Jack Jacques James Javier Jean John Jorge Joseph José Juan Jürgen Karl
        Kevin Klaus Luis Manuel Mark Martin Matthew Michael Miguel Paul Pedro Peter Philippe Pierre Richard Robert Stefan Steven Thomas
        Tom William Wolfgang Алексей Дмитрий Иван Михаил Сергей""",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo li ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се со та те ти то ва ве во".split(),
    "greek": "βα βε βο δα δε δο γα γο κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"given_f": "lina", "given_m": "ron", "given_n": "ry", "family": "sen"},
    "cyrillic": {"given_f": "лина", "given_m": "рон", "given_n": "ри", "family": "ски"},
    "greek": {"given_f": "λινα", "given_m": "ρος", "given_n": "ρι", "family": "ιδης"},
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõö", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρσςτυφχψω"]
PLACE = {c: (k, i) for k, letters in enumerate(ALPHABETS) for i, c in enumerate(letters)}

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]"
_NAME = rf"{_CAP}[^\W\d_]+(?:[-']{_CAP}[^\W\d_]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ANY = lambda table: "|".join(sorted((w for words in table.values() for w in words.split()), key=len, reverse=True))
FINDER = "|".join([
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-]))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<card>(?<!\w)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))",
    # Pairs ('06 12 34 56 78', '+33 6 12 34 56 78'), area and a long number ('030 1234567', '+49 (0)30 1234567'), groups of three or four.
    r"(?P<phone>(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?[1-9]\d{0,3}|0\d{1,4})[ ./-](?:\d{2}[ .-]){2,3}\d{2}"
    r"|(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?[1-9]\d{1,4}[ /-]|\(0\d{1,4}\)[ /-]?|0\d{1,4}[ /-])\d{5,9}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15})(?!\w))",
    r"(?P<account>(?<!\w)\d{9,}(?!\w))",
    rf"(?P<titled>(?<!\w)(?P<title>{_ANY(TITLES)})\.? (?P<t_names>{_NAME}(?: {_NAME}){{0,2}}))",
    rf"(?P<named>(?<!\w)(?P<given>{_ANY(GIVEN)})(?: (?P<n_family>{_NAME}))?(?!\w))",
])
GENDER = {w: g for g, words in TITLES.items() for w in words.split()}
GIVEN_GENDER = {w: g for g, words in GIVEN.items() for w in words.split()}

WORD = byte_table((48, 57), (65, 90), (97, 122), (128, 255))
# By code point, what FINDER takes for a letter or digit (\w without the underscore) and for a digit (\d).
ALNUM = np.array([chr(c).isalnum() for c in range(0x110000)])
DECIMAL = np.array([chr(c).isdecimal() for c in range(0x110000)])


def _luhn(digits: str) -> int:
    """Check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Mentions:
    """Finds entities and knows which parts of a mention are the entity."""

    def __init__(self) -> None:
        self.find = re.compile(FINDER).finditer

    def of(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, value) in text order; value is what equal entities share, whatever their spelling."""
        out, families = [], {}
        for m in self.find(text):
            kind = m.lastgroup if m.lastgroup in KINDS else "titled" if m["titled"] else "named" if m["named"] else next(k for k in KINDS[:7] if m[k])
            if kind == "titled":
                names = [(n.start() + m.start("t_names"), n[0]) for n in re.finditer(_NAME, m["t_names"])]
                gender = GENDER[m["title"]]
                for i, (at, name) in enumerate(names):
                    part = "family" if i == len(names) - 1 else f"given_{GIVEN_GENDER.get(name, gender)}"
                    out.append((at, at + len(name), part, name.casefold()))
                    families[name] = part
            elif kind == "named":
                out.append((m.start("given"), m.end("given"), f"given_{GIVEN_GENDER[m['given']]}", m["given"].casefold()))
                if m["n_family"]:
                    out.append((m.start("n_family"), m.end("n_family"), "family", m["n_family"].casefold()))
                    families[m["n_family"]] = "family"
            else:
                plain = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in m[0])  # digits of other scripts
                value = m[0].lower() if kind == "email" else re.sub(r"[^0-9A-Z.+]" if kind in ("iban", "ip") else r"[^0-9+]", "", plain)
                out.append((m.start(), m.end(), kind, value))
        if families:  # bare mentions of a name met with a title, or of a family name met with a given name
            taken = {p for s, e, _, _ in out for p in range(s, e)}
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})(?!\w)", text):
                if taken.isdisjoint(range(m.start(), m.end())):
                    out.append((m.start(), m.end(), families[m[0]], m[0].casefold()))
            out.sort()
        return out


class Surrogates:
    """Keyed surrogates of entity values."""

    def __init__(self, key: bytes):
        self.key = key

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256), "big")

    def permute(self, symbols: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A keyed bijection of the tuples with 0 <= symbols[i] < sizes[i]."""
        half = len(sizes) // 2
        parts, spans = [], [sizes[:half], sizes[half:]]
        for values, span in zip((symbols[:half], symbols[half:]), spans, strict=True):
            n = 0
            for v, s in zip(values, span, strict=True):
                n = n * s + v
            parts.append(n)
        whole = [int(np.prod(s, dtype=object)) if s else 1 for s in spans]
        for r in range(ROUNDS):
            i = r % 2
            parts[i] = (parts[i] + self._number(tweak, r, parts[1 - i])) % whole[i]
        out = []
        for n, span in zip(parts, spans, strict=True):
            back = []
            for s in reversed(span):
                n, v = divmod(n, s)
                back.append(v)
            out += reversed(back)
        return out

    def shaped(self, text: str, tweak: str) -> str:
        """Permute letters and digits of text inside their alphabets; other characters stay."""
        at = [i for i, c in enumerate(text) if c in PLACE]
        if not at:
            return text
        places = [PLACE[text[i]] for i in at]
        new = self.permute([p for _, p in places], [len(ALPHABETS[k]) for k, _ in places], f"{tweak}|{''.join(str(k) for k, _ in places)}")
        out = list(text)
        for i, (k, _), p in zip(at, places, new, strict=True):
            out[i] = ALPHABETS[k][p]
        return "".join(out)

    def of(self, kind: str, value: str, attempt: int) -> str:
        """The surrogate of a value, in the form of values."""
        tweak = f"{kind}|{attempt}"
        if kind == "email":
            local, _, domain = value.partition("@")
            labels, _, top = domain.rpartition(".")
            return f"{self.shaped(local, tweak + domain)}@{self.shaped(labels, 'domain|' + str(attempt))}.{top}"
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            inside = lambda o: 1 if o[0] in (0, 10, 127) else 2 if o[:2] == [192, 168] else 3 if o[0] >= 224 else 0
            fixed = {0: 0, 1: 1, 2: 2, 3: 1}[inside(octets)]
            new = octets
            while True:  # walks the cycle until the class of address is right again
                new = new[:fixed] + self.permute(new[fixed:], [256] * (4 - fixed), tweak)
                if inside(new) == inside(octets):
                    return ".".join(map(str, new))
        if kind == "card":
            body, valid = value[1:-1], _luhn(value[:-1]) == int(value[-1])
            if valid:
                body = self.shaped(body, tweak + value[0])
                return f"{value[0]}{body}{_luhn(value[0] + body)}"
            rest = value[1:]
            while True:
                rest = self.shaped(rest, tweak + value[0])
                if _luhn(value[0] + rest[:-1]) != int(rest[-1]):
                    return value[0] + rest
        if kind == "iban":
            body = self.shaped(value[4:].lower(), tweak + value[:2]).upper()
            right = _mod97(value[4:] + value[:4]) == 1
            return f"{value[:2]}{98 - _mod97(body + value[:2] + '00'):02d}{body}" if right else f"{value[:4]}{body}"
        if kind in ("ssn", "account", "phone"):
            # The first digit after a plus is of the country code and stays.
            keep = 2 if value[0] == "+" else 0
            return value[:keep] + self.shaped(value[keep:], tweak + value[:keep])
        script = "cyrillic" if re.search("[Ѐ-ӿ]", value) else "greek" if re.search("[Ͱ-Ͽ]", value) else "latin"
        n, stock = self._number(tweak, script, value), SYLLABLES[script]
        out = ""
        for _ in range(2 + attempt + (len(value) > 7)):
            n, i = divmod(n, len(stock))
            out += stock[i]
        return out + ENDINGS[script][kind]

    @staticmethod
    def dress(surrogate: str, kind: str, mention: str) -> str:
        """The surrogate with the separators and the case of one mention."""
        if kind in ("ssn", "card", "phone", "account", "iban"):
            digits = iter(surrogate)
            return "".join(next(digits) if c.isalnum() or c == "+" else c for c in mention)
        if mention.isupper() and len(mention) > 1:
            return surrogate.upper()
        if kind == "email":
            return "".join(s.upper() if m.isupper() else s for s, m in zip(surrogate, mention, strict=True))
        return surrogate[:1].upper() + surrogate[1:] if mention[:1].isupper() else surrogate


def _name_hashes() -> np.ndarray:
    # Of a hyphenated entry its longest part stands for it: texts are broken at hyphens.
    words = [max(w.split("-"), key=len) for table in (TITLES, GIVEN) for words in table.values() for w in words.split()]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return np.sort(span_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends))


def suspects(raw: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Texts of a slice that may hold an entity: an at sign, four digits or more, or a word of the title and name lists.

    Words end where FINDER's do, at every character that is no letter or digit, so no text that it would match is missed.
    """
    flag = per_text(raw == 64, offsets) > 0
    digit = byte_table((48, 57))[raw]
    if (raw > 127).any():
        head = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        digit[head] = DECIMAL[points]
        raw = np.where(ALNUM[points][np.cumsum(head) - 1], raw, np.uint8(32))
    flag |= per_text(digit, offsets) >= 4
    flat = Flat(raw, offsets, WORD)
    words = flat.hashes()
    if len(words):
        known = names[np.minimum(np.searchsorted(names, words), len(names) - 1)] == words
        flag |= per_text(known, flat.first) > 0
    return flag


def entities(docs: DataFrame, text: str) -> DataFrame:
    """(kind, value) of every distinct entity of the texts."""

    def run(batches):
        finder, names = Mentions(), _name_hashes()
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                whole = raw.tobytes()
                found = {(k, v) for i in np.flatnonzero(suspects(raw, offsets, names)) for _, _, k, v in finder.of(whole[offsets[i]: offsets[i + 1]].decode())}
                if found:
                    kinds, values = zip(*sorted(found), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=["kind", "value"])

    return docs.select(text).mapInArrow(run, "kind string, value string").distinct()


def attempts(real: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate would clash; all others use attempt 0.

    A surrogate clashes if it is a real value of its kind, or if another entity has it: of several the least value keeps it.
    """

    def draw(rows: DataFrame, attempt: int) -> DataFrame:
        @F.arrow_udf("string")
        def run(kind: pa.Array, value: pa.Array) -> pa.Array:
            s = Surrogates(key)
            return pa.array([s.of(k, v, attempt) for k, v in zip(kind.to_pylist(), value.to_pylist(), strict=True)], pa.string())

        return rows.withColumn("surrogate", run("kind", "value")).withColumn("attempt", F.lit(attempt))

    values = real.select("kind", F.col("value").alias("surrogate"))
    trial = cut(draw(real, 0))
    settled: DataFrame | None = None
    attempt = 0
    while True:
        free = trial.join(values, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(attempt))
        settled = cut(good if settled is None else settled.unionByName(good))
        left = cut(trial.join(settled, ["kind", "value"], "left_anti").select("kind", "value"))
        if left.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt")
        attempt += 1
        trial = cut(draw(left, attempt))


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with text replaced and count added (mentions replaced); all other columns are carried, one of that name is replaced.

    A null text stays null. Equal texts get equal results; an empty table stays empty.
    """
    rows = picked(docs, *[c for c in docs.columns if c != count])
    redrawn = cut(attempts(cut(entities(rows, text)), key))
    n = redrawn.count()
    hashed, tried = unused(rows, "_key", "_again")
    if n:
        # Texts that hold a redrawn entity: a narrow join, keyed by the text's hash.
        again = cut(_redrawn_by_text(rows, text, redrawn, n)).withColumnsRenamed({"_key": hashed, "_again": tried})
        keyed = rows.withColumn(hashed, F.xxhash64(text)).join(broadcast_if_small(again, again.count(), 100_000), hashed, "left").drop(hashed)
    else:
        keyed = rows.withColumn(tried, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{count} int"])

    def run(batches):
        finder, known, maker = Mentions(), _name_hashes(), Surrogates(key)
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                whole, out, counts = raw.tobytes(), part.column(text).to_pylist(), [0] * part.num_rows
                for i in np.flatnonzero(suspects(raw, offsets, known)):
                    t = whole[offsets[i]: offsets[i + 1]].decode()
                    found = finder.of(t)
                    if not found:
                        continue
                    tries = {(a["kind"], a["value"]): a["attempt"] for a in part.column(tried)[int(i)].as_py() or []}
                    pieces, at = [], 0
                    for start, end, kind, value in found:
                        made = maker.of(kind, value, tries.get((kind, value), 0))
                        pieces += [t[at:start], maker.dress(made, kind, t[start:end])]
                        at = end
                    out[i], counts[i] = "".join(pieces) + t[at:], len(found)
                columns = [pa.array(out, pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*names, count])

    return keyed.select(*names, tried).mapInArrow(run, schema)


def _redrawn_by_text(rows: DataFrame, text: str, redrawn: DataFrame, n: int) -> DataFrame:
    """(_key, _again): the redrawn entities of every text that has one."""

    def run(batches):
        finder, names = Mentions(), _name_hashes()
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                whole, keys, kinds, values = raw.tobytes(), [], [], []
                of = part.column("_key").to_pylist()
                for i in np.flatnonzero(suspects(raw, offsets, names)):
                    for k, v in {(k, v) for _, _, k, v in finder.of(whole[offsets[i]: offsets[i + 1]].decode())}:
                        keys.append(of[i])
                        kinds.append(k)
                        values.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["_key", "kind", "value"])

    held = rows.select(F.xxhash64(text).alias("_key"), text).mapInArrow(run, "_key bigint, kind string, value string")
    met = held.join(broadcast_if_small(redrawn, n), ["kind", "value"])
    # A text's own entities only.
    return met.groupBy("_key").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("_again"))
