"""Contamination by the bitmap against plain loops, and the shape of its plan."""

import re

import numpy as np
import pyarrow as pa

from weighbridge.functions.windows import Bitmap, first_of_each, slices, word_windows
from weighbridge.operators import contamination as ops

SCHEMA = "id string, source string, text string, grams int, _maybe string, _row string, g string"


def grams(text, n):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {" ".join(words[i: i + n]) for i in range(len(words) - n + 1)}


def rows_of(rng, k):
    words = [f"w{i}" for i in range(40)] + ["É", "x-y", "Ab9", "ünter"]
    return [" ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 40)))) for _ in range(k)]


def test_windows_are_the_word_windows():
    rng = np.random.default_rng(1)
    texts = rows_of(rng, 60) + [None, "", "abc", "a b", "ab", "-", "é" * 5, "end", "start", "0" * 2000 + " 1 2"]
    low, high, data, offsets = next(slices(pa.array([None if t is None else t.lower() for t in texts])))
    for n in (1, 2, 5):
        w = word_windows(data, offsets, n)
        got = {(int(w.owner[k]), w.text(k)) for k in first_of_each(w.owner, w.hashes)}
        assert (low, high) == (0, len(texts)) and got == {(i, g) for i, t in enumerate(texts) for g in grams(t, n)}
        by_text = {}
        for k in range(len(w.hashes)):  # equal windows hash alike, different ones apart
            assert by_text.setdefault(w.text(k), w.hashes[k]) == w.hashes[k]
        assert len(set(by_text.values())) == len(by_text)


def test_bitmap_loses_nothing():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for bits in (1 << 16, Bitmap.size_for(20_000)):
        half, other = Bitmap(bits), Bitmap(bits)
        half.add(keys[:10_000])
        other.add(keys[10_000:])
        both = Bitmap(bits, half.data | other.data)
        assert both.may_hold(keys).all()
    assert both.may_hold(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.02
    assert Bitmap.size_for(0) == 1 << 16 and Bitmap.size_for(10**12) == 1 << 29


def test_contamination_against_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    evaluation = rows_of(rng, 30) + [None, ""]
    texts = rows_of(rng, 200) + [None, "", "w1 " * 50] + [t for t in evaluation[:5]] + ["w1 W2, w3. " + t.upper() for t in evaluation[5:10]]
    known = set().union(*(grams(t, 3) for t in evaluation))
    rows = [(str(i % 190), f"s{i % 3}", t, 1, "a", "b", "c") for i, t in enumerate(texts)]  # some ids stand twice
    want = sorted((r[0], r[1], len(grams(r[2], 3)), len(grams(r[2], 3) & known)) for r in rows)
    df, side = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in evaluation], "text string")
    for bits in (1 << 16, 1 << 10):  # a crowded bitmap gives the same result
        monkeypatch.setattr(ops.Bitmap, "size_for", staticmethod(lambda _, b=bits: b))
        out = ops.ngram_contamination(df.drop("grams", "_maybe", "_row"), side, n=3)
        assert sorted((r.id, r.source, r.grams, r.hits) for r in out.collect()) == want and "g" in out.columns
    counts = {r.source: (r.rows, r.grams) for r in ops.gram_counts(df.drop("grams"), "source", n=3).collect()}
    for s in ("s0", "s1", "s2"):
        mine = [grams(r[2], 3) for r in rows if r[1] == s]
        assert counts[s] == (sum(map(len, mine)), len(set().union(*mine)))


def test_nothing_shuffles_below_the_bitmap(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "source", "text")
    plan = ops.suspects(docs, Bitmap(1 << 16), "text", 13)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_no_evaluation_and_no_rows(spark):
    none = spark.createDataFrame([], "id string, text string")
    some = spark.createDataFrame([("1", "a b c " * 20)], "id string, text string")
    assert ops.ngram_contamination(none, some).count() == 0 and ops.ngram_contamination(some, none).first().hits == 0


def test_packed_gram_counts(spark):
    texts = [("s", "a b c d e f"), ("s", "a b c d e f"), ("t", "a b c x"), (None, "b c d e"), ("t", "a b"), ("u", None), ("s", "d e f d e f d e f")]
    rows, grams = {}, {}
    for s, t in texts:
        words = (t or "").split()
        mine = {tuple(words[i:i + 3]) for i in range(len(words) - 2)}
        if mine:
            rows[s] = rows.get(s, 0) + len(mine)
            grams[s] = grams.get(s, set()) | mine
    df = spark.createDataFrame(texts, "source string, text string").coalesce(1)
    for held in (1, 3, 1 << 20):  # packed often, now and then, once
        got = {r.source: (r.rows, r.grams) for r in ops.gram_counts(df, "source", n=3, held_grams=held).collect()}
        assert got == {s: (rows[s], len(grams[s])) for s in rows}
