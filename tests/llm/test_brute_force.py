"""Registered queries against plain Python on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from weighbridge.llm import near_dup, secret_scan
from weighbridge.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_near_duplicates_are_the_components_of_all_similar_pairs(spark, docs):
    known, idf = near_dup.word_frequencies(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    vectors = {i: near_dup._vector(r.text, known, idf) for i, r in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if near_dup.weighted_jaccard(*vectors[a], *vectors[b]) >= near_dup.SIMILAR:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_duplicates"](spark, SF).collect()}
    assert got == {i: find(i) for i in ids}


def test_near_duplicates_inside_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)  # all buckets are large
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    body, texts = words(1500), []
    for _ in range(80):  # pairs of similarity above 0.8 in a group of less
        own = words(30)
        texts += [" ".join(body + own + words(22)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known, idf = near_dup.word_frequencies(docs, "text")
    v = [near_dup._vector(t, known, idf) for t in texts]
    similar = {(a, b) for a in range(160) for b in range(a + 1, 160) if near_dup.weighted_jaccard(*v[a], *v[b]) >= near_dup.SIMILAR}
    assert similar == {(2 * k, 2 * k + 1) for k in range(80)} and near_dup.weighted_jaccard(*v[0], *v[2]) > 0.5
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == {i: i - i % 2 for i in range(160)}


def test_a_group_of_texts_too_far_apart_makes_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    body, texts = words(150), []
    for _ in range(60):  # all of one origin, which is not in the table; no two are similar enough
        text = list(body)
        for at in rng.choice(np.arange(10, 140, 10), 2, replace=False):
            text[at] = words(1)[0]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known, idf = near_dup.word_frequencies(docs, "text")
    v = [near_dup._vector(t, known, idf) for t in texts]
    assert all(0.4 < near_dup.weighted_jaccard(*v[a], *v[b]) < 0.8 for a in range(60) for b in range(a))
    compared, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == {i: i for i in range(60)}
    assert sum(compared) < 10 * 60  # there are 1,770 pairs


def test_sampling_agrees_with_weighted_similarity():
    rng = np.random.default_rng(5)
    sampler, hits, want = near_dup.Sampler(), 0, 0.0
    for _ in range(200):
        hashes = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        a, b = rng.uniform(1, 7, 60).astype(np.float32), rng.uniform(1, 7, 60).astype(np.float32)
        ka, kb = np.arange(0, 50), np.arange(10, 60)
        want += near_dup.weighted_jaccard(hashes[ka], a[ka], hashes[kb], b[kb]) ** near_dup.ROWS
        hits += (sampler.bands(hashes[ka], a[ka]) == sampler.bands(hashes[kb], b[kb])).mean()
    assert abs(hits - want) / 200 < 0.02


def test_tokens_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    for r in QUERIES["op4_bpe"](spark, SF).collect():
        ids = library.encode(docs[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    from weighbridge.llm import bpe

    library, codec = Tokenizer.from_file(tokenizer_path()), bpe.Codec(bpe.load_vocabulary(tokenizer_path()))
    rng = np.random.default_rng(2)
    texts = ["", "a" * 3000, "<|endoftext|>x<|endoftext|>", "=" * 500, "'s 're 　 \n\n x"]
    texts += ["".join(rng.choice(list("aeinorst h'\n.,1 Aéß"), rng.integers(1, 60))) for _ in range(3000)]
    texts += ["x" + chr(i) + "y " + chr(i) * 2 for i in range(1, 0x3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == want.ids, text


def test_quality_counts(spark, docs):
    for r in QUERIES["op6_quality_rules"](spark, SF).collect():
        text = docs[r.doc_id].text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
        often, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if often[g] > 1:
                covered |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_secret_spans(spark, docs):
    for r in QUERIES["op8_secrets"](spark, SF).collect():
        base, every, _ = secret_scan.scan_text(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k, _ in every)


def test_decontamination_finds_whole_items(spark, docs):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, r in docs.items() for i, t in items.items() if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert want and len(want - got) <= 0.02 * len(want) and got <= want


def test_decontamination_misses_no_whole_item(spark):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()}
    rows = [(r.doc_id, plain(r.text)) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null").select("doc_id", "text").collect()]
    want = {(d, i) for d, x in rows for i, t in items.items() if len(t.split()) >= 5 and t in x}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, "/root/testdata/sf0.1").collect()}
    assert want and want <= got


def test_classifiers_on_held_out_rows(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97


def test_pipeline_keeps_one_of_each_class(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= set(docs) and len(ids) > 0.5 * len(docs) and all(r.round_trip for r in rows)
    texts = defaultdict(list)
    for i in ids:
        texts[docs[i].text].append(i)
    assert all(len(v) == 1 for v in texts.values())


def test_ids_and_their_text_come_from_one_python_worker(spark, docs):
    from weighbridge.llm import bpe

    out = corpus_pipeline.tokens(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    coder = bpe.ByteBPE(spark, tokenizer_path())
    apart = {r.doc_id: r.ids for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", coder.encode("text").alias("ids")).collect()}
    rows = out.collect()
    assert {r.doc_id: r.ids for r in rows} == apart and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
