"""Conversations from quoting messages.

A message is parsed by quote level: its own lines, the lines it quotes, the lines quoted inside these, and so on. Every level's lines, stripped
of marks, attribution lines and spacing, make one passage; a message's passages from its own downwards make its chain. Messages publish the
hashes of their chain's beginnings, and of single paragraphs. A reply asks with the hashes of what it quotes, and its parent is the earliest
message that published the longest of these. Parents give conversations, ordered so that every message follows the one it answers, with all
quotes removed.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import picked
from weighbridge.operators.ranking import ranked
from weighbridge.session import cut

MARK = re.compile(r"\s*((?:>\s?)+)")
# How mail programs introduce a quotation.
ATTRIBUTION = re.compile(r"(?i)^\s*(?:.{0,200}\b(?:wrote|writes|schrieb|écrit|escribió)\b.{0,80}:|-{2,}\s*original message\s*-{2,})\s*$")
MIN_PARAGRAPH = 40  # characters of a paragraph that is told from common phrases
PIECE = 20  # hex digits of the 24 of an order key that name a piece of a conversation


def levels(body: str) -> list[list[str]]:
    """Lines by quote level, marks removed; attribution lines before a deeper level are left out."""
    parsed = []
    for line in body.split("\n"):
        m = MARK.match(line)
        parsed.append((m[1].count(">") if m else 0, line[m.end():] if m else line))
    out: list[list[str]] = [[]]
    for i, (level, line) in enumerate(parsed):
        if ATTRIBUTION.match(line):
            follow = next((p[0] for p in parsed[i + 1:] if p[1].strip()), 0)
            if follow > level:
                continue
        while len(out) <= level:
            out.append([])
        out[level].append(line)
    return out


def normal(lines: list[str]) -> str:
    """Spacing and case do not count, nor where lines were wrapped."""
    return " ".join(" ".join(lines).split()).casefold()


def paragraphs(lines: list[str]) -> list[str]:
    """Normal forms of the blocks between blank lines, and of lines, that are long enough."""
    blocks = re.split(r"\n\s*\n", "\n".join(lines)) + lines
    return sorted({n for b in blocks if len(n := normal([b])) >= MIN_PARAGRAPH})


def _hash(*passages: str) -> str:
    return hashlib.md5("\x1f".join(passages).encode("utf-8", "surrogatepass")).hexdigest()


def parse(body: str | None) -> tuple[str, list[tuple[int, str]], list[tuple[int, str]]]:
    """(own text, published, asked); both lists hold (length of the chain or 0 for a paragraph, hash)."""
    by_level = levels(body or "")
    chain = [normal(lines) for lines in by_level]
    while chain and not chain[-1]:
        chain.pop()
    own = "\n".join(by_level[0]).strip()
    published = [(n, _hash(*chain[:n])) for n in range(1, len(chain) + 1)] if chain and chain[0] else []
    published += [(0, _hash(p)) for p in paragraphs(by_level[0])]
    quoted = chain[1:]
    while quoted and not quoted[0]:
        quoted = quoted[1:]
    asked = [(n, _hash(*quoted[:n])) for n in range(1, len(quoted) + 1)]
    asked += [(0, _hash(p)) for p in paragraphs(by_level[1])] if len(by_level) > 1 else []
    return own, published, asked


def parents(parsed: DataFrame) -> DataFrame:
    """(id, parent) of the messages that quote an earlier one."""
    key = lambda column: parsed.filter(F.col("id").isNotNull()).select("id", F.explode(column).alias("k")).select("id", "k.length", "k.hash")
    # One row a hash, however many messages hold the passage: the earliest.
    earliest = key("published").groupBy("length", "hash").agg(F.min("id").alias("parent"))
    met = key("asked").join(earliest, ["length", "hash"]).filter(F.col("parent") < F.col("id"))
    return met.groupBy("id").agg(F.max_by("parent", F.struct(F.col("length"), -F.col("parent"))).alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root, depth) of every id with a parent, by doubling: rounds are the logarithm of the longest thread."""
    active = cut(links.select("id", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    found: DataFrame | None = None
    while True:
        whole = active if found is None else active.unionByName(found)
        above = whole.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        step = cut(active.join(above, "root", "left").select(
            "id", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved")))
        # Who stands under a root has arrived and is not joined again, but others may still climb over it.
        arrived, active = step.filter("not moved").drop("moved"), step.filter("moved").drop("moved")
        found = arrived if found is None else found.unionByName(arrived)
        if active.isEmpty():
            return found


def link_quotations(messages: DataFrame, body: str = "body", message_id: str = "message_id", keep: tuple[str, ...] = ("role",)) -> DataFrame:
    """message_id, conversation_id, parent_id, position, depth, keep and text, a row for every row; other columns are left out.

    Ids are whole numbers that grow with time. conversation_id is the first message's id; position counts from 0 by (depth, id). A passage that
    several messages hold is ascribed to the earliest. A message that quotes nothing known, or only later messages, starts a conversation;
    a null body is an empty one. A row with a null id can neither be found nor placed: its conversation and position are null.
    """
    rows = picked(messages, message_id, *keep, body)
    carried = [f for f in rows.schema if f.name in keep]
    pairs = "array<struct<length:int,hash:string>>"
    schema = ", ".join(["id bigint"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + [f"text string, published {pairs}, asked {pairs}"])
    kind = pa.list_(pa.struct([("length", pa.int32()), ("hash", pa.string())]))

    def run(batches):
        for batch in batches:
            parsed = [parse(b) for b in batch.column(body).to_pylist()]
            hashes = lambda i: pa.array([[{"length": n, "hash": h} for n, h in p[i]] for p in parsed], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[batch.column(f.name) for f in carried], pa.array([p[0] for p in parsed], pa.string()), hashes(1), hashes(2)],
                names=["id", *[f.name for f in carried], "text", "published", "asked"])

    parsed = cut(rows.withColumn("id", F.col(message_id).cast("bigint")).mapInArrow(run, schema))
    links = cut(parents(parsed))
    placed = parsed.drop("published", "asked").join(links, "id", "left").join(roots(links).withColumnRenamed("root", "_root"), "id", "left").withColumns(
        {"conversation_id": F.coalesce("_root", "id"), "depth": F.coalesce("depth", F.lit(0))})
    known = placed.filter(F.col("id").isNotNull()).withColumn(
        "_order", F.concat(F.lpad(F.hex("depth"), 8, "0"), F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    out = [F.col("id").alias(message_id), "conversation_id", F.col("parent").alias("parent_id")]
    numbered = ranked(known, ["conversation_id"], "_order", "id", prefix=PIECE).select(*out, (F.col("rank") - 1).cast("bigint").alias("position"), "depth", *keep, "text")
    lost = placed.filter(F.col("id").isNull()).select(*out, F.lit(None).cast("bigint").alias("position"), "depth", *keep, "text")
    return numbered.unionByName(lost)
