"""Structure of conversations: faults of their rows, and the cheapest edits that make the roles alternate.

A conversation is right when its role initials read (s?(ua)+)? and no row is blank or repeated. Rows may be kept, given another role, deleted, or
preceded by new ones with empty text. The cheapest edits are found by iterative-deepening A*: a depth-first search takes edits in ASCII order of
their initials and gives up where the cost so far and the least that must follow exceed the bound; then the bound grows to the least cost
that it cut off. A table remembers how much every failed state needs at least, so a state fails twice only for a larger budget. The first
accepting path is the cheapest one, and the first of those in ASCII order.

Two passes share one order of rows. The first carries roles, faults and hashes, no texts, and streams each conversation into a few bytes a row
for the search. The second streams the texts with the edits in front of them into one hash. Neither holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.session import cut

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3  # a truncated row that stays
NOTHING = " "  # stands for a null
PATTERNS = 1 << 14  # row patterns whose edits a task remembers

# What a row is to the search: its role's initial (s, u, a or another) and its fault.
SOUND, CUT_OFF, GONE = 0, 1, 2
# What has been written so far: nothing, a system row, a user row (an assistant must follow), a whole pair.
START, SYSTEM, USER, PAIR = range(4)
NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (PAIR, "a"), PAIR: (USER, "u")}


def least_costs(rows: list[tuple[str, int]]) -> list[int]:
    """A lower bound of the cost from every row on.

    A row costs what its fault costs at least. Neighbours that stay but cannot stand beside each other cost one more edit: an insertion, another
    role, or what deleting one of them adds. Disjoint pairs need different edits, so their costs add up.
    """
    out = [0] * (len(rows) + 1)
    below = -1  # the next staying row that is not in a pair yet
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        out[i] = out[i + 1] + (DELETE if fault == GONE else TRUNCATED if fault == CUT_OFF else 0)
        if fault == GONE:
            continue
        if below >= 0 and initial + rows[below][0] not in ("su", "ua", "au"):
            extra = DELETE - TRUNCATED if CUT_OFF in (fault, rows[below][1]) else REROLE
            out[i] += extra
            below = -1
        else:
            below = i
    return out


def cheapest_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, initials of the edits in order) for rows of (role initial, fault)."""
    n, least = len(rows), least_costs(rows)
    needs: dict[int, int] = {}  # failed states: what they need at least

    def need(state: int) -> int:
        return needs.get(state, least[state >> 2])

    def edits(state: int) -> Iterator[tuple[str, int, int]]:
        i, wrote = state >> 2, state & 3
        after, expected = NEXT[wrote]
        initial, fault = rows[i] if i < n else ("", GONE)
        if i < n:
            yield "D", DELETE, (i + 1) << 2 | wrote
        yield "I", INSERT, i << 2 | after
        if i < n and fault != GONE:
            stay = TRUNCATED if fault == CUT_OFF else 0
            if initial == expected:
                yield "K", KEEP + stay, (i + 1) << 2 | after
            elif initial == "s" and wrote == START:
                yield "K", KEEP + stay, (i + 1) << 2 | SYSTEM
            yield "R", REROLE + stay, (i + 1) << 2 | after

    if not n:
        return 0, ""
    bound = need(START)
    while True:
        # Frames of the search: state, its edits not yet tried, budget, the least that a failed edit needs.
        path: list[str] = []
        frames = [[START, edits(START), bound, 1 << 60]]
        while frames:
            state, rest, budget, best = top = frames[-1]
            for letter, cost, to in rest:
                wanted = cost + need(to)
                if wanted > budget:
                    top[3] = min(top[3], wanted)
                    continue
                path.append(letter)
                if to >> 2 == n and to & 3 in (START, PAIR):
                    return bound - budget + cost, "".join(path)
                frames.append([to, edits(to), budget - cost, 1 << 60])
                break
            else:
                frames.pop()
                needs[state] = max(top[3], need(state))
                if frames:
                    letter = path.pop()
                    above = frames[-1]
                    spent = above[2] - budget
                    above[3] = min(above[3], spent + needs[state])
        bound = needs[START]


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NOTHING))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of every row after its damage; nulls of role and text are one space.

    The damage hangs on crc32("conv_id:turn") modulo 20: 0 drops the row, 1 empties its text, 2 removes its full stops, question and exclamation
    marks, 3 repeats it, 4 makes it a user's. A dropped row stays as a trace with a null copy.
    """
    kind = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_or_space("role"))
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order: by turn, nulls first, then role, text and copy."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SPACES = " \t\n\x0b\x0c\r"


class Marks:
    """What the search keeps of a conversation while its rows pass: a shared pair a row, a hash a row, the counts."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.seen: set[bytes] = set()
        self.count = dict.fromkeys(COUNTS, 0)
        self.before = self.first = self.turn = None
        self.turns = 0

    def add(self, turn, role: str, digest: str, last: str, pairs: dict) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        mark = hashlib.md5(f"{digest}{role}".encode()).digest()
        fault = "blank" if not last else "duplicate" if mark in self.seen else "truncated" if last not in ".!?" else None
        self.seen.add(mark)
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.before = initial
        pair = initial, SOUND if fault is None else CUT_OFF if fault == "truncated" else GONE
        self.rows.append(pairs.setdefault(pair, pair))

    def close(self, solved: dict) -> tuple:
        key = tuple(self.rows)
        if key not in solved:
            if len(solved) >= PATTERNS:
                solved.clear()
            solved[key] = cheapest_edits(self.rows)
        self.count["gaps"] = self.turn - self.first + 1 - self.turns if self.turns else 0
        self.count["cost"], audit = solved[key]
        return (*self.count.values(), audit)


def conversation_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, counts of faults, cost, audit) of every conversation of damaged rows."""
    marks = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "copy", F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).alias("last"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        solved, pairs, out, current, mine, of_id = {}, {}, [], None, None, None
        for batch in batches:
            of_id = batch.column("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "copy", "last"))
            for conv, turn, role, digest, copy, last in zip(*columns, strict=True):
                if mine is None or conv != current:
                    if mine is not None:
                        out.append((current, *mine.close(solved)))
                    current, mine = conv, Marks()
                if copy is not None:
                    mine.add(turn, role, digest, last, pairs)
            if len(out) >= 1000:
                yield _batch(out, of_id)
                out = []
        if mine is not None:
            out.append((current, *mine.close(solved)))
        if out:
            yield _batch(out, of_id)

    return _ordered(marks).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string")


def _batch(rows: list[tuple], kind: pa.DataType, *more: str) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "audit", *more]
    types = [kind, *[pa.int64()] * len(COUNTS), *[pa.string()] * (1 + len(more))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class Writer:
    """Applies the edits to rows as they come; every row written is (role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.wrote = audit, 0, START

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.wrote, role = NEXT[self.wrote]
            yield NAMES[role], ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "D":
            return
        if letter == "K" and self.wrote == START and role[:1] == "s":
            self.wrote = SYSTEM
        else:
            self.wrote, expected = NEXT[self.wrote]
            role = NAMES[expected] if letter == "R" else role
        yield role, text


NAMES = {"u": "user", "a": "assistant"}


def _beside(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Every conversation's edits, then its rows in order, in one partition each."""
    kind = rows.schema["turn"].dataType
    head = edits.select("conv_id", F.lit(None).cast(kind).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(-1).alias("copy"),
                        F.lit(None).cast("string").alias("text"), F.struct(*COUNTS, "audit").alias("edits"))
    body = rows.filter(F.col("copy").isNotNull()).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "copy", "text",
                                                         F.lit(None).cast(head.schema["edits"].dataType).alias("edits"))
    both = head.withColumn("_head", F.lit(0)).unionByName(body.withColumn("_head", F.lit(1)))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_head", "turn", "role", "digest", "copy").select("conv_id", "role", "text", "edits")


def _replayed(batch: pa.RecordBatch, open_: dict):
    """Apply edits while rows stream by: yields (conversation, its edits) where one begins, else (role, text) of a repaired row.

    open_ carries the writer from batch to batch. A conversation's trailing insertions come before the next one begins, so the caller asks
    open_["writer"] for the last ones.
    """
    for conv, role, text, made in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edits")), strict=True):
        if made is not None:
            if open_:
                yield from ((None, pair) for pair in open_["writer"].inserted())
            open_["writer"] = Writer(made["audit"])
            yield (conv, made), None
        else:
            yield from ((None, pair) for pair in open_["writer"].row(role, text))


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after damage and repair.

    gaps are turn numbers missing between the least and the greatest one. Nulls of role and text are one space, a null turn comes first and
    counts in no gap, rows of a null conv_id are one conversation. Rows of one turn follow role and text; a repeated row is a duplicate. A
    conversation without rows has zeros, no edits and the hash of nothing. Other columns are not read; an empty table gives no rows.
    """
    rows = damaged(conversations)
    edits = cut(conversation_edits(rows))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        open_, done, current, of_id = {}, [], None, None
        close = lambda c: (c[0], *(c[1][n] for n in COUNTS), c[1]["audit"], c[2].hexdigest())

        def put(pair):
            current[2].update(f"\n{pair[0]}:{pair[1]}".encode() if current[3] else f"{pair[0]}:{pair[1]}".encode())
            current[3] = True

        for batch in batches:
            of_id = batch.column("conv_id").type
            for begun, pair in _replayed(batch, open_):
                if begun is None:
                    put(pair)
                    continue
                if current is not None:
                    done.append(close(current))
                current = [*begun, hashlib.sha256(), False]
            if len(done) >= 1000:
                yield _batch(done, of_id, "repaired_sha256")
                done = []
        if current is not None:
            for pair in open_["writer"].inserted():
                put(pair)
            done.append(close(current))
        if done:
            yield _batch(done, of_id, "repaired_sha256")

    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _beside(rows, edits).mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of every conversation after damage and repair; place counts from 0. Odd cases as in repair_report."""
    rows = damaged(conversations)
    edits = cut(conversation_edits(rows))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        open_, current, place, of_id = {}, None, 0, None
        names = ["conv_id", "place", "role", "text"]
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (of_id, pa.int64(), pa.string(), pa.string()), strict=True)], names=names)
        for batch in batches:
            of_id, out = batch.column("conv_id").type, []
            for begun, pair in _replayed(batch, open_):
                if begun is not None:
                    current, place = begun[0], 0
                    continue
                out.append((current, place, *pair))
                place += 1
            if out:
                yield packed(out)
        if open_ and (out := [(current, place + i, *pair) for i, pair in enumerate(open_["writer"].inserted())]):
            yield packed(out)

    return _beside(rows, edits).mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string")
