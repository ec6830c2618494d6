"""The Jaccard join, importance resampling and conversation repair against plain loops, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import importance, jaccard_join, repair

SCHEMA = "doc_id bigint, text string, id string, set int, n string, e int, rank string, _row int, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    body = " ".join(f"w{i}" for i in range(60))
    return [(1, body), (2, body.upper() + "\n"), (2, body), (3, None), (4, ""), (5, " \n\t"), (6, "two words"), (7, "Two  Words"), (8, body + " more words here"), (None, body),
            (9, " ".join(f"v{i % 5000}" for i in range(30_000))), (9, "an other text of one and the same id"), (10, "é É ſ"), (11, "é É ſ"), (12, "É É ſ")]


# ---- Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i: i + 5]) for i in range(len(words) - 4)])


def classes(rows):
    """(id, n, component) of every row by comparing all sets."""
    sets = sorted({(i, shingles(t)) for i, t in rows if i is not None and shingles(t)}, key=lambda r: r[0])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a][1] & sets[b][1])
            if 100 * common >= 80 * (len(sets[a][1]) + len(sets[b][1]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    at = {s: k for k, s in enumerate(sets)}
    return sorted(((i, len(shingles(t)), None if i is None else sets[find(at[i, shingles(t)])][0] if shingles(t) else i) for i, t in rows), key=str)


def joined(spark, rows):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join_on_odd_rows(spark, odd_rows):
    got = joined(spark, odd_rows)
    assert got == classes(odd_rows) and (8, 59, 1) in got and (7, 1, 6) in got and (None, 56, None) in got
    assert joined(spark, []) == []


def test_join_of_a_family_around_an_origin(spark):
    """Copies at every distance from one origin, most of them too far from each other, and copies of copies."""
    rng = np.random.default_rng(7)
    word = lambda: f"x{rng.integers(0, 10**9)}"
    origin = [word() for _ in range(120)]
    texts = [origin]
    for k in range(150):
        t = list(texts[0] if k < 110 else texts[int(rng.integers(1, 110))])
        for _ in range(int(rng.integers(1, 7))):
            at, what = int(rng.integers(0, len(t))), int(rng.integers(0, 3))
            t[at: at + (what != 1)] = [word()] if what < 2 else []
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(origin[:40] + [word() for _ in range(60)])) for i in range(30)]
    rng.shuffle(rows)
    got = joined(spark, rows)
    assert got == classes([(int(i), t) for i, t in rows])
    assert len({c for _, _, c in got}) > 35  # not all are linked


def test_join_finds_pairs_inside_a_group_of_less(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    body, rows = words(400), []
    for k in range(60):
        own = words(60)
        rows += [(2 * k + j, " ".join(body + own + words(25))) for j in range(2)]
    assert joined(spark, rows) == classes(rows) == sorted(((i, 481, i - i % 2) for i in range(120)), key=str)


def test_filters_drop_no_link():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = rng.choice(2**40, n + 30, replace=False).astype(np.int64) + (1 << 50)
        a, b = np.sort(base[:n]), np.sort(np.concatenate([base[int(rng.integers(0, n // 5 + 1)): n], base[n: n + int(rng.integers(0, n // 5 + 1))]]))
        common = np.intersect1d(a, b)
        at_a, at_b = np.array([0, len(a)]), np.array([0, len(b)])
        assert jaccard_join.intersections(a, at_a, b, at_b).tolist() == [len(common)]
        if 100 * len(common) >= 80 * (len(a) + len(b) - len(common)):
            i, j = int(np.searchsorted(a, common[0])), int(np.searchsorted(b, common[0]))
            assert i < jaccard_join.prefix_length(len(a)) and j < jaccard_join.prefix_length(len(b))
            assert jaccard_join.suffix_passes(a, at_a, np.array([i]), b, at_b, np.array([j]), 80).all()
            assert 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 180 * min(len(a) - i, len(b) - j) >= 80 * (len(a) + len(b))


# ---- importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i: i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x, longest)) for texts in ([x for _, x in docs], target))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + 10_000) / ((s[b] + 1) * (every_t + 10_000))))
    rows = []
    for i, text in docs:
        f = features_of(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, odd_rows, longest):
    rng = np.random.default_rng(2)
    docs = odd_rows + [(100 + i, " ".join(f"t{w}" for w in rng.integers(0, 300, int(rng.integers(5, 60))))) for i in range(300)] + [(900, "x" * 500 + " é" * 30), (901, "a-b_c " * 9 + "Q" * 64 + " " + "q" * 65)]
    target = [" ".join(f"t{w}" for w in rng.integers(0, 40, 50)) for _ in range(20)] + [None, ""]
    out = importance.importance_sample(table(spark, docs), table(spark, list(enumerate(target))), longest=longest)
    assert sorted((tuple(r) for r in out.collect()), key=str) == resampled(docs, target, longest)


def test_resampling_of_nothing(spark, odd_rows):
    none = table(spark, [])
    assert importance.importance_sample(none, none).count() == 0
    got = importance.importance_sample(table(spark, odd_rows), none).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(odd_rows, [])


def test_equal_scores_and_a_hot_id(spark):
    """A third of the rows share id and text: the drawn number is exact and ranks have no gap."""
    rows = [(7 if i % 3 == 0 else i, " ".join(["same"] * 25) if i % 3 == 0 else " ".join(f"u{i}x{j}" for j in range(25))) for i in range(3000)]
    out = importance.importance_sample(table(spark, rows), table(spark, [(0, "same " * 50)])).collect()
    drawn = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 301)) and all((-a.score, a.doc_id) <= (-b.score, b.doc_id) for a, b in zip(drawn, drawn[1:], strict=False))
    assert (-drawn[-1].score, drawn[-1].doc_id) <= min((-r.score, r.doc_id) for r in out if not r["rank"])


@pytest.mark.parametrize("pivots", [2, 32])
def test_quickselect_finds_every_rank(spark, pivots):
    rng = np.random.default_rng(4)
    values = [(int(rng.integers(0, 5)), None if i % 7 == 0 else i % 20, i) for i in range(200)]
    keys = spark.createDataFrame(values, "s int, i int, r int").select(F.struct("s", "i", "r").alias("key")).cache()
    ordered = sorted(values, key=importance._sortable)
    for k in (1, 2, 57, 199, 200):
        assert tuple(importance.kth_key(keys, k, pivots=pivots)) == ordered[k - 1]
    assert importance.kth_key(keys, 201) is None


# ---- conversation repair


def cheapest(rows):
    """(cost, audit) by trying every edit, with no more than three insertions in a row."""

    @lru_cache(None)
    def best(i, wrote, inserted):
        after, expected = repair.NEXT[wrote]
        found = [(0, "")] if i == len(rows) and wrote in (0, 3) else []
        put = lambda cost, letter, then: found.append((cost + then[0], letter + then[1])) if then else None
        if inserted < 3:
            put(3, "I", best(i, after, inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            put(4, "D", best(i + 1, wrote, 0))
            if fault != repair.GONE:
                stay = 3 if fault == repair.CUT_OFF else 0
                if initial == expected:
                    put(stay, "K", best(i + 1, after, 0))
                if initial == "s" and wrote == 0:
                    put(stay, "K", best(i + 1, 1, 0))
                put(3 + stay, "R", best(i + 1, after, 0))
        return min(found) if found else None

    return best(0, 0, 0)


def repaired_by_hand(rows):
    """The report of every conversation, and its rows after repair, straight from the rules."""
    space = lambda v: " " if v is None else str(v)
    conversations, report, written = {}, {}, {}
    for row in rows:
        conversations.setdefault(row[0], []).append(row)
    for conv, mine in conversations.items():
        left = []
        for _, turn, role, text in mine:
            kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", space(text)) if kind == 2 else space(text)
                left += [(turn, "user" if kind == 4 else space(role), text)] * (1 + (kind == 3))
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, count, seen = [], [0, 0, 0], set()
        for _, role, text in left:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else 3
            seen.add((role, text))
            faults.append(repair.SOUND if fault == 3 else repair.CUT_OFF if fault == 2 else repair.GONE)
            if fault < 3:
                count[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        turns = {r[0] for r in left} - {None}
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(left, faults, strict=True)))
        out, rest, wrote = [], iter(left), 0
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "K" and wrote == 0 and row[1][:1] == "s":
                wrote = 1
                out.append(row[1:])
            elif letter != "D":
                wrote, expected = repair.NEXT[wrote]
                name = "user" if expected == "u" else "assistant"
                out.append((name, "") if row is None else row[1:] if letter == "K" else (name, row[2]))
        written[conv] = out
        report[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())
    return report, written


CHAT = "conv_id bigint, turn bigint, role string, text string, audit int, copy string, edits string, digest int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], CHAT)


def test_cheapest_edits():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        rows = [("suat "[rng.integers(0, 5)] if rng.random() < 0.5 else "ua"[i % 2], int(rng.choice([0, 1, 2], p=[0.7, 0.15, 0.15]))) for i in range(int(rng.integers(0, 9)))]
        assert repair.cheapest_edits(rows) == cheapest(tuple(rows)), rows
    assert repair.cheapest_edits([("", 0), ("tool"[:1], 1)]) == cheapest((("", 0), ("t", 1)))


def test_least_costs_never_exceed_the_cost():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        rows = [("suat"[rng.integers(0, 4)], int(rng.choice([0, 1, 2]))) for _ in range(int(rng.integers(1, 9)))]
        assert repair.least_costs(rows)[0] <= cheapest(tuple(rows))[0]


def test_repair(spark):
    rng = np.random.default_rng(9)
    texts = ["Fine.", "Cut off", "", " \t", "Why?", "é!", ". ", "no end\n", None]
    rows = [(c, t, ["user", "assistant", "system", "tool", "", None][int(rng.choice(6, p=[0.4, 0.4, 0.08, 0.04, 0.04, 0.04]))], texts[rng.integers(0, 9)]) for c in range(120) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(4)] + [(500, None, "user", "A null turn."), (500, 3, "assistant", "Last."), (500, None, "user", "A null turn.")]
    rows += [(501, 1, "user", "long " * 200_000 + "."), (501, 2, "assistant", "é" * 1000), (502, 10**12, "user", "Far."), (502, 1, "user", "Near.")]
    report, written = repaired_by_hand(rows)
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair_report(chat(spark, rows)).collect()} == report
    got = {}
    for r in sorted(repair.repaired(chat(spark, rows)).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: w for c, w in written.items() if w}
    assert repair.repair_report(chat(spark, [])).count() == 0 and repair.repaired(chat(spark, [])).count() == 0


def test_repair_of_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}{'.' * (t % 5 > 0)}") for t in range(3000)]
    out = repair.repair_report(chat(spark, rows)).collect()[0]
    edits = repair.DELETE * out.audit.count("D") + 3 * (out.audit.count("R") + out.audit.count("I"))
    assert len(out.audit) >= 2800 and out.cost == edits + 3 * (out.truncated - _deleted_truncated(rows, out.audit))


def _deleted_truncated(rows, audit):
    """Truncated rows among the deleted ones."""
    left = []
    for conv, turn, _, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            bad = kind in (1, 2) or text[-1] != "."
            left += [kind != 1 and bad] + [False] * (kind == 3)
    at = iter(left)
    return sum(next(at) and letter == "D" for letter in audit if letter != "I")
