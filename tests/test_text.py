"""Text helpers, contamination on a skewed corpus, licenses and files."""

import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from weighbridge.functions import text as T
from weighbridge.operators import contamination as con
from weighbridge.session import scratch
from weighbridge.sources import inventory as inv
from weighbridge.sources import records as src


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_canonical_json(spark):
    for value in ({"b": 1, "a": [True, None, "é"]}, ["x", 2.5], "plain", 7):
        text = value if isinstance(value, str) else json.dumps(value, indent=1, ensure_ascii=False)
        want = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert one(spark, text, T.canonical_json) == want
        assert one(spark, text, T.digest) == hashlib.sha256(want.encode()).hexdigest()


def test_describe(spark):
    assert [one(spark, v, T.describe) for v in (None, "word", '"quoted"', '{"a":1}')] == ["", "word", "quoted", '{"a":1}']


def test_text_behind_a_json_value_is_text(spark):
    texts = ["8294846167456848 Inly onhe", '{"a":1} tail', "[1] [2]", "1, 2", '1, "b"', '1, "b": 2', "1] x", "1} x", '"q" rest', "true love", "null and void", "", " ", "1,", '"open', "[1"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = rows.select("x", T.canonical_json(F.col("x")).alias("j"), T.describe(F.col("x")).alias("d"), T.digest(F.col("x")).alias("h")).collect()
    for r in got:
        want = json.dumps(r.x, ensure_ascii=False)
        assert (r.j, r.d, r.h) == (want, r.x, hashlib.sha256(want.encode()).hexdigest())
    assert [one(spark, v, T.canonical_json) for v in (" 12 ", '\n{"b":1,\n"a":"]}"}\n', '"x"')] == ["12", '{"a":"]}","b":1}', '"x"']


def test_normalized_state(spark):
    value = {"k": ["  Straße ＡＢＣ ", {"Z": "ﬁn"}], "n": 3}
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    want = {"k": [norm(value["k"][0]), {"Z": norm("ﬁn")}], "n": 3}
    assert json.loads(one(spark, json.dumps(value), T.normalized_state)) == want


def test_ngrams_are_a_set(spark):
    text = "A b, a B a b a"
    assert sorted(one(spark, text, lambda c: T.ngrams(c, 2))) == ["a b", "b a"]
    assert one(spark, "too short", lambda c: T.ngrams(c, 3)) == []


def test_card_license(spark):
    cases = {
        '---\nlicense: "MIT"\n---\nx': ["mit"], "---\nlicense:\n- cc-by-4.0\n- 'other'\n---\n": ["cc-by-4.0", "other"], "no front\nlicense: mit": [], "---\ntags: x\n---\nlicense: mit": [],
    }
    for card, want in cases.items():
        assert one(spark, card, T.card_license) == want


def brute(docs, evaluation, n):
    def grams(t):
        import re
        w = re.findall("[a-z0-9]+", t.lower())
        return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}

    known = set().union(*(grams(e) for e in evaluation))
    return {i: (len(grams(t)), len(grams(t) & known)) for i, t in docs}


def test_contamination_with_shared_boilerplate(spark, monkeypatch):
    boiler = "this page was printed by the same old machine every single day of the year"
    docs = [(str(i), (boiler + " " if i % 3 == 0 else "") + f"document number {i} tells of one two three four five six") for i in range(90)] + [("e", "")]
    evaluation = [(str(i), f"question {i} " + boiler) for i in range(5)]
    df = spark.createDataFrame(docs, "id string, text string")
    ev = spark.createDataFrame(evaluation, "id string, text string")
    want = brute(docs, [e[1] for e in evaluation], 5)
    for limit in (10**6, 0):  # broadcast and shuffled evaluation side
        monkeypatch.setattr(con, "broadcast_if_small", lambda d, rows, bound=0, limit=limit: F.broadcast(d) if rows <= limit else d)
        got = {r["id"]: (r["grams"], r["hits"]) for r in con.ngram_contamination(df, ev, n=5).collect()}
        assert got == want


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("two")
    (tmp_path / "sub" / "new.txt").write_text("three")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    manifest = spark.createDataFrame([("a.txt", 3, sha("one")), ("sub/b.txt", 3, sha("TWO")), ("lost.txt", 1, sha("x"))], "name string, bytes long, sha256 string")
    got = {r["name"]: r["status"] for r in inv.inventory_verify(spark, f"file:{tmp_path}", manifest).collect()}
    assert got == {"a.txt": "ok", "sub/b.txt": "checksum differs", "sub/new.txt": "extra", "lost.txt": "missing"}


def test_ranges_of_long_and_empty_files(spark, tmp_path, monkeypatch):
    content = bytes(i * 7 % 251 for i in range(10_000))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "long name.bin").write_bytes(content)
    (tmp_path / "even.bin").write_bytes(content[:8192])
    (tmp_path / "empty.bin").write_bytes(b"")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tree = lambda b: sha("".join(sha(b[i: i + 4096]) for i in range(0, max(1, len(b)), 4096)).encode())
    want = {"sub/long name.bin": content, "even.bin": content[:8192], "short.bin": b"s"}
    (tmp_path / "short.bin").write_bytes(b"s")
    got = {r["name"]: (r["bytes"], r["ranges"], r["range_sha256"]) for r in inv.range_inventory(spark, f"file:{tmp_path}", range_bytes=4096).collect()}
    assert got == {n: (len(b), max(1, -(-len(b) // 4096)), tree(b)) for n, b in want.items()}
    manifest = spark.createDataFrame([(n, len(b), sha(b)) for n, b in (want | {"empty.bin": b""}).items()], "name string, bytes long, sha256 string")
    status = {n: "ok" for n in want} | {"empty.bin": "not listed"}
    assert {r["name"]: r["status"] for r in inv.inventory_verify(spark, f"file:{tmp_path}", manifest).collect()} == status
    monkeypatch.setattr(inv, "RANGE", 100)  # all but the short file are streamed
    assert {r["name"]: r["sha256"] for r in inv.file_inventory(spark, f"file:{tmp_path}").collect()} == {n: sha(b) for n, b in want.items()}


def test_only_newlines_end_a_record(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": "1", "state": "a b"}\n\n{"id": "2", "state": "c\\r\\nd"}\n')
    rows = src.read_records(spark, str(path), "id string, state string").collect()
    assert {r["id"]: r["state"] for r in rows} == {"1": "a b", "2": "c\r\nd"}


def test_scratch_is_fresh(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
