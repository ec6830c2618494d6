"""Repetition of a corpus against plain loops."""

import re
from collections import Counter

import numpy as np

from weighbridge.operators import diversity


def grams(text, n):
    w = re.findall("[a-z0-9]+", text.lower())
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1))


def by_hand(rows, n, percent):
    out = {}
    for source in {s for s, _ in rows}:
        mine = [t for s, t in rows if s == source]
        states = sorted({t for t in mine if t is not None})
        sets = [grams(t, n) for t in states]
        near = set()
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    near |= {a, b}
        shapes = Counter(re.sub("[A-Z][A-Za-z]*", "@", re.sub("[0-9]+([.,][0-9]+)*", "#", t)) for t in mine if t is not None)
        there = sum(t is not None for t in mine)
        out[source] = (len(mine), there - len(states), max(shapes.values(), default=0) / len(mine), len(near) / len(mine))
    return out


def rows_of():
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    origin = [word() for _ in range(150)]
    rows = []
    for k in range(120):  # a family around one origin, some of it near only to each other
        t = list(origin)
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(0, 150))] = word()
        rows.append((f"s{k % 2}", " ".join(t)))
    for k in range(20):
        body = origin[:60] + [word() for _ in range(90)]
        rows += [("s0", " ".join(body)), ("s0", " ".join(body + [word()])), ("s1", " ".join(body[::-1]))]
    rows += [("s1", f"Item {k} costs {k}.5 says Bob") for k in range(30)] + [("s1", "Item 3 costs 3.5 says Bob")] * 3
    return rows + [("s0", None), ("s0", ""), ("s0", ""), (None, "a b c d e f"), (None, "A b c d e f!"), ("s2", None)]


def test_report(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "source string, state string, g int, key string, of int")
    for n, percent in ((5, 95), (3, 80)):
        got = {r.source: tuple(r)[1:] for r in diversity.diversity_report(df, n=n, percent=percent).collect()}
        want = by_hand(rows, n, percent)
        assert got.keys() == want.keys() and all(np.allclose(got[s], want[s]) for s in want), (got, want)
    assert want["s0"][3] > 0.3


def test_nothing(spark):
    assert diversity.diversity_report(spark.createDataFrame([], "source string, state string")).count() == 0


def test_sets_leave_slice_by_slice(spark):
    import pyarrow as pa

    from weighbridge.functions.windows import SLICE
    from weighbridge.operators import diversity

    text = "a b c d e f " * (SLICE // 20)
    lists = list(diversity._sets(pa.RecordBatch.from_arrays([pa.array([text] * 4)], names=["t"]), 5))
    assert len(lists) > 1 and [row for rows in lists for row, _ in rows] == [0, 1, 2, 3]
    assert {len(mine) for rows in lists for _, mine in rows} == {6}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
