"""Selection against plain greedy loops on small random frames, and independence from partitioning."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weighbridge.operators import selection as ops

SEED = "t"


def order(tag, i):
    return hashlib.sha256(f"{SEED}|{tag}|{i}".encode()).hexdigest()


def greedy(rows, k, ids, states, tag):
    """Walk rows in hash order; rows are (id, state); ids and states grow with every pick."""
    out = []
    for i, s in sorted(rows, key=lambda r: order(tag, r[0])):
        if len(out) == k:
            break
        if i not in ids and s not in states:
            out.append(i)
            ids.add(i)
            states.add(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, id string, state_sha256 string")


def some_rows(rng, sources=5, n=120, states=40, hot=0.35):
    """A third of all rows are copies of one state and a third belong to one source."""
    rows = []
    for i in range(n):
        source = "a" if rng.random() < hot else rng.choice("abcdefgh"[:sources])
        state = "hot" if rng.random() < hot else f"s{rng.randrange(states)}"
        rows.append((source, f"id{i}", state))
    return rows


def test_take_k_is_the_greedy_walk(spark):
    rng = random.Random(1)
    rows = some_rows(rng)
    barred = [("id3", "s1"), ("id50", "s2")]
    exclude = spark.createDataFrame(barred, "id string, state_sha256 string")
    got = ops.take_k(frame(spark, rows), 7, SEED, "test", exclude=exclude).collect()
    for source in {r[0] for r in rows}:
        want = greedy([r[1:] for r in rows if r[0] == source], 7, {b[0] for b in barred}, {b[1] for b in barred}, f"{source}/test")
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["source"] == source] == want


def test_rejected_are_the_rows_passed_over(spark):
    rng = random.Random(2)
    rows = some_rows(rng, sources=2)
    chosen, rejected = ops.select_unique_report(frame(spark, rows), 6, SEED, "test")
    picked = {r["id"] for r in chosen.collect()}
    dropped = {r["id"] for r in rejected.collect()}
    for source in {r[0] for r in rows}:
        seen, states, out = 0, set(), set()
        for i, s in sorted((r[1:] for r in rows if r[0] == source), key=lambda r: order(f"{source}/test", r[0])):
            if s in states:
                out.add(i)
                continue
            states.add(s)
            seen += 1
            if seen == 6:
                break
        assert out == {i for i in dropped if any(r[1] == i and r[0] == source for r in rows)}
    assert not picked & dropped


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_multi_quota_equals_greedy_over_sources(spark, seed):
    rng = random.Random(seed)
    rows = some_rows(rng, sources=6, n=90, states=25)
    names = sorted({r[0] for r in rows})
    quotas = [(s, i + 1, rng.randrange(1, 7)) for i, s in enumerate(names)]
    cand = ops.firsts(frame(spark, rows), SEED, "x")
    got = ops.multi_quota(cand, spark.createDataFrame(quotas, "source string, seq int, k int"), ["source"]).collect()
    ids, states, want = set(), set(), {}
    for s, _, k in quotas:
        want[s] = greedy([r[1:] for r in rows if r[0] == s], k, ids, states, f"{s}/x")
    for s in names:
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["source"] == s] == want[s]


def test_balanced_binary_equals_the_loop(spark):
    rng = random.Random(6)
    rows = [(s, i, st, rng.choice("01")) for s, i, st in some_rows(rng, sources=4, n=80, states=20)]
    names = sorted({r[0] for r in rows})
    df = spark.createDataFrame(rows, "source string, id string, state_sha256 string, label string")
    places = spark.createDataFrame([(s, i + 1) for i, s in enumerate(names)], "source string, seq int")
    chosen, composition = ops.balanced_binary(df, 4, places, SEED, "c")
    got = {(r["source"], r["id"]) for r in chosen.collect()}
    ids, states, want = set(), set(), set()
    for s in names:
        free = [r for r in rows if r[0] == s and r[2] not in states]
        have = {label: len({r[2] for r in free if r[3] == label}) for label in "10"}
        if not any(have.values()):
            continue
        k = min(4, *have.values())
        picks = {label: greedy([r[1:3] for r in free if r[3] == label], k, ids, states, f"{s}/{label}/c") for label in "10"}
        k = min(map(len, picks.values()))
        want |= {(s, i) for label in "10" for i in picks[label][:k]}
    assert got == want
    assert sum(r["records"] for r in composition.collect()) == len(want)


def test_result_does_not_depend_on_partitions(spark):
    rows = some_rows(random.Random(7))
    outs = []
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = frame(spark, rows).repartition(parts).orderBy(F.rand(parts))
        outs.append({(r["source"], r["id"], r["rank"]) for r in ops.take_k(df, 9, SEED, "test").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1]


def test_shortage_is_reported(spark):
    rows = [("a", "1", "x"), ("a", "2", "x"), ("b", "3", "y"), ("b", "4", "z")]
    _, short = ops.select_exact(frame(spark, rows), 2, SEED, "t")
    assert [tuple(r) for r in short.collect()] == [("a", 2, 1)]


def test_stages_never_share_a_state(spark):
    from weighbridge.plans.fixtures import records
    from weighbridge.plans.selection_queries import staged

    out = staged(records(spark, "/root/testdata/sf0.001"))
    names = ["test", "dev", "calibration", "train"]
    assert out.count() > 0
    assert all(r["shared"] == 0 for r in ops.overlap_matrix(out, names).collect())


def _greedy(rows, quotas):
    """Group after group in seq order: the first k rows whose state no earlier group took."""
    taken, out = set(), set()
    for source, seq, k in sorted(quotas, key=lambda q: q[1]):
        mine = sorted((h, i, s) for g, i, s, h in rows if g == source and s not in taken)[:k]
        out |= {(source, i) for _, i, _ in mine}
        taken |= {s for _, _, s in mine}
    return out


def test_bounded_pool_equals_the_greedy_walk(spark, monkeypatch):
    from weighbridge.operators import selection

    rng = random.Random(8)
    for window in (10**6, 0):
        monkeypatch.setattr(selection, "WINDOW_ROWS", window)
        for shared in (0.1, 0.6, 1.0):
            rows = []
            for g in range(4):
                states = {f"s{rng.randrange(60)}" if rng.random() < shared else f"own{g}-{i}" for i in range(80)}
                rows += [(f"g{g}", f"{g}/{s}", s, f"{rng.getrandbits(128):032x}") for s in sorted(states)]
            quotas = [(f"g{g}", g + 1, rng.randrange(1, 25)) for g in range(4)]
            cand = spark.createDataFrame(rows, "source string, id string, state_sha256 string, h string")
            q = spark.createDataFrame(quotas, "source string, seq int, k bigint")
            got = {(r.source, r.id) for r in selection.multi_quota(cand, q, ["source"]).collect()}
            assert got == _greedy(rows, quotas)
            pool, n = selection.bounded(cand.join(q, "source"), ["source"], F.col("seq"))
            assert pool.count() == n <= len(rows) and (shared > 0.1 or n < 0.6 * len(rows))
