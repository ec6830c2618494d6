"""Near-duplicate documents by improved consistent weighted sampling.

A text is a weighted set: its five-word shingles, each weighing its count times the mean inverse document frequency of its words. (A
frequency of the shingle itself would count the copies: the more copies a passage has, the less it would weigh, and large groups would hide
themselves.) A sample draws one (shingle, level) of a text so that two texts draw the same one with the chance of their weighted Jaccard
similarity. SAMPLES samples make BANDS bands; texts that agree on a band share a bucket and are candidates.

Candidates are verified on the exact weighted Jaccard similarity of the whole texts. A bucket never lists its pairs. Its members meet one
leader, the most central member, and what is linked becomes a class; a bucket of one class is done, and one of two members has had its pair. All
members of the other buckets are compared over prefixes: in a fixed order of all shingles, rare ones first, two texts of similarity
SIMILAR share one of the shingles before the last SIMILAR of their weight, and what lies behind it is heavy enough for the common part. That is
certain, so no pair that shares a band is lost: two texts of similarity 0.8 share a band with a chance of 0.99997. Members of a large
group of copies that are too far from each other differ in rare shingles, which come first and weigh too much: they are no candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.components import components, cut_counted
from weighbridge.llm.flat import Flat, byte_table, constants, mix, picked, repeats, text_slices, window_hashes
from weighbridge.session import broadcast_if_small, cut

SHINGLE = 5
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
SIMILAR = 0.8
RARE = 1000  # words in fewer than one of so many texts weigh alike; at most RARE x (mean distinct words of a text) words are frequent
SLACK = 1e-4  # for sums in another order
COMMON = (SIMILAR - SLACK) / (1 + SIMILAR - SLACK)  # of the weight of two similar texts together, what they share weighs at least
SMALL = 2  # members of a bucket whose pairs are simply compared
COUNTERS = 1 << 20  # of shingles, for their order; shingles that share one are taken for as frequent as both
DRAWS = 1 << 14  # independent draws of (r, c, beta), picked by a hash of shingle and sample
BLOCK = 192  # shingles at once
PARTIAL = 1 << 20  # words a task counts before it passes them on
KEPT = 1 << 15  # signatures a task remembers for copies of a text

WORD = byte_table((48, 57), (65, 90), (97, 122), (128, 255))


def _distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(values[order], head) if len(k) else values


def word_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, idf) of the words met in at least one of RARE texts; other words weigh log(1 + RARE).

    Every text of the table is counted. Texts without words do not count.
    """

    def run(batches):
        keys, values, n, waiting = [], [], 0, 0
        for batch in batches:
            for _, raw, offsets in text_slices(batch, text):
                flat = Flat(raw, offsets, WORD, fold=True)
                words, owner = flat.hashes(), flat.text_of_word()
                _, later = repeats(words, owner)
                k, v = np.unique(words[~later], return_counts=True)
                n += int((flat.counts > 0).sum())
                keys.append(k)
                values.append(v)
                waiting += len(k)
                if waiting > PARTIAL:
                    k, v = _distinct(np.concatenate(keys), np.concatenate(values))
                    keys, values, waiting = [k], [v], len(k)
                    if waiting > PARTIAL // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v)], names=["word", "n"])
                        keys, values, waiting = [], [], 0
        if keys:
            k, v = _distinct(np.concatenate(keys), np.concatenate(values))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n])], names=["word", "n"])

    counts = cut(docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter(F.col("word").isNull()).first()
    texts = int(total["n"]) if total else 0
    got = counts.filter(F.col("word").isNotNull() & (F.col("n") * RARE >= texts)).toArrow()
    words, n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], np.log1p(texts / np.maximum(n[order], 1)).astype(np.float32)


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, bounds): every text's distinct shingles in hash order. Fewer than five words are one shingle."""
    flat = Flat(raw, offsets, WORD, fold=True)
    words = flat.hashes()
    weight = np.full(len(words), np.log1p(RARE), np.float32)
    if len(known) and len(words):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        weight[hit] = idf[at[hit]]
    first, bounds = flat.windows(SHINGLE)
    hashes = window_hashes(words, first, SHINGLE)
    total = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
    mean = (total[first + SHINGLE] - total[first]) / SHINGLE
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    short = np.flatnonzero((flat.counts > 0) & (flat.counts < SHINGLE))
    if len(short):
        more = [window_hashes(words, flat.first[i: i + 1], int(flat.counts[i])) for i in short]
        hashes, owner = np.concatenate([hashes, *more]), np.concatenate([owner, short])
        mean = np.concatenate([mean, (total[flat.first[short + 1]] - total[flat.first[short]]) / flat.counts[short]])
    order = np.lexsort((hashes, owner))
    hashes, owner, mean = hashes[order], owner[order], mean[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(hashes)))
    # The mean is rounded so that sums in another order give the same weight.
    return hashes[head], (count * np.round(mean[head], 3)).astype(np.float32), np.searchsorted(owner[head], np.arange(len(offsets)))


class Sampler:
    """The fixed random numbers of all samples: r and c from Gamma(2, 1), beta uniform."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        r, c = rng.gamma(2.0, 1.0, DRAWS), rng.gamma(2.0, 1.0, DRAWS)
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.r, self.inverse, self.log_c = r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32)
        self.odd = constants(SAMPLES, 500) | np.uint64(1)
        self.shift = np.uint64(64 - DRAWS.bit_length() + 1)

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The text's bucket in every band."""
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
        log_w, each = np.log(weights), np.arange(SAMPLES)
        for at in range(0, len(hashes), BLOCK):
            h = hashes[at: at + BLOCK]
            pick = ((h[:, None] * self.odd) >> self.shift).astype(np.intp)
            beta = self.beta.take(pick)
            t = np.floor(log_w[at: at + BLOCK, None] * self.inverse.take(pick) + beta)
            # log a = log c - r (t - beta + 1); the least a wins, the least hash among equals.
            a = self.log_c.take(pick) - self.r.take(pick) * (t - beta + 1)
            row = a.argmin(axis=0)
            value = a[row, each]
            better = value < best
            best[better], drawn[better], level[better] = value[better], h[row[better]], t[row, each][better]
        with np.errstate(over="ignore"):
            sample = mix(drawn + level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
            return mix((sample * (constants(ROWS, 700) | np.uint64(1))).sum(axis=1) + constants(BANDS, 900))


def signatures(docs: DataFrame, known: np.ndarray, idf: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """(id, digest, weight, bands) of every row; the digest of a null text is null, a text without words has no bands."""
    rows = docs.select(doc_id, text, F.md5(F.col(text).cast("binary")).alias("_digest"))
    schema = f"id {docs.schema[doc_id].dataType.simpleString()}, digest string, weight float, bands array<bigint>"

    def run(batches):
        sampler, kept = Sampler(), {}
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                hashes, weights, bounds = weighted_shingles(raw, offsets, known, idf)
                total, bands = [], []
                for i, digest in enumerate(part.column("_digest").to_pylist()):
                    if bounds[i] == bounds[i + 1]:
                        total.append(0.0)
                        bands.append([])
                        continue
                    if digest not in kept:
                        if len(kept) >= KEPT:
                            kept.clear()
                        mine = slice(bounds[i], bounds[i + 1])
                        kept[digest] = sampler.bands(hashes[mine], weights[mine]).view(np.int64)
                    total.append(float(weights[bounds[i]: bounds[i + 1]].sum(dtype=np.float64)))
                    bands.append(kept[digest])
                yield pa.RecordBatch.from_arrays([part.column(doc_id), part.column("_digest"), pa.array(total, pa.float32()), pa.array(bands, pa.list_(pa.int64()))],
                                                 names=["id", "digest", "weight", "bands"])

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, known: np.ndarray, idf: np.ndarray, text: str, doc_id: str) -> tuple[DataFrame, int]:
    """The rows (a, b) of pairs whose texts are SIMILAR or more, with similarity, and their number."""
    wanted, n = cut_counted(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    texts = cut(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(broadcast_if_small(wanted, n), "_id", "left_semi"))
    # Links to a hub share one side: the join splits them.
    with_b = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_t").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("_id").alias("a"), F.col("_t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, mine = None, ()
        for batch in batches:
            for part, raw, offsets in text_slices(batch, "tb"):
                hashes, weights, bounds = weighted_shingles(raw, offsets, known, idf)
                out = np.zeros(part.num_rows)
                for i, ta in enumerate(part.column("ta").to_pylist()):
                    if ta != last:  # the join brings the links of one text together
                        last, mine = ta, _vector(ta, known, idf)
                    out[i] = weighted_jaccard(*mine, hashes[bounds[i]: bounds[i + 1]], weights[bounds[i]: bounds[i + 1]])
                keep = pa.array(np.flatnonzero(out >= SIMILAR))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(out).take(keep)], names=["a", "b", "similarity"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return cut_counted(both.mapInArrow(run, f"a {kind}, b {kind}, similarity double"))


def _vector(text: str, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return weighted_shingles(raw, np.array([0, len(raw)]), known, idf)[:2]


def weighted_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser weights over sum of the greater ones."""
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    least = np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64)
    return float(least / max(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - least, 1e-12))


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(node, a, b, shared): members and the leaders of their buckets that may be similar: other class, weights near enough."""
    near = F.least("weight", "w2") >= F.lit(SIMILAR - SLACK) * F.greatest("weight", "w2")
    met = members.join(leaders, "bucket").filter((F.col("node") != F.col("leader")) & near)
    if "root" in members.columns:
        met = met.filter(F.col("root") != F.col("root2"))
    return met.groupBy("node", F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least id of the row's class, its own id if nothing is like it.

    Classes are connected by equal texts and by pairs of SIMILAR or more. Texts without words are alike only if equal. A row with a null
    text is alone; a row with a null id is not compared and has a null class. Rows of one id belong to one class.
    """
    rows = picked(docs, doc_id, text)
    known, idf = word_frequencies(rows, text)
    signed = cut(signatures(rows, known, idf, text, doc_id))
    texts = signed.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    nodes = cut(texts.groupBy("digest").agg(F.min("id").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    every = nodes.select("node", "weight", F.posexplode("bands").alias("last", "bucket"))
    shared, n = cut_counted(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(every.join(broadcast_if_small(shared.select("bucket"), n), "bucket", "left_semi"))
    # The first leader of a bucket is its most central member: the one whose buckets hold most texts. Copies of a text meet the text in more
    # buckets than they meet each other, so a family is tied to its origin by one comparison a member.
    sized = members.join(broadcast_if_small(shared.select("bucket", F.col("n").alias("size")), n), "bucket")
    members = cut(members.join(sized.groupBy("node").agg(F.sum("size").alias("central")), "node"))
    lead = F.max_by(F.struct(F.col("node").alias("leader"), F.col("weight").alias("w2")), F.struct(F.col("central"), -F.col("node")))
    first_leaders = cut(members.groupBy("bucket").agg(lead.alias("l")).select("bucket", "l.leader", "l.w2"))
    first, n = cut_counted(_pairs(members, first_leaders))
    best = first.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("shared"), -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    roots, classes = _joined(None, verified(best, rows, known, idf, text, doc_id)[0] if n else first)
    tested = best
    first = first.select("a", "b").distinct()
    rest = _across(first.join(best, ["a", "b"], "left_anti").select("a", "b"), roots, classes)
    members = members.join(first_leaders.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
    roots, classes, tested = _linked(rest, roots, classes, tested, rows, known, idf, text, doc_id)
    # Members of buckets that still hold more than one class.
    of = members.join(broadcast_if_small(roots, classes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = of.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("n"))
    members = cut(of.join(open_.filter("_lo <> _hi").select("bucket", "n"), "bucket"))
    small = members.filter(F.col("n") <= SMALL)
    rest = _pairs(small, _all_lead(small)).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    roots, classes, tested = _linked(rest, roots, classes, tested, rows, known, idf, text, doc_id)
    large, n = cut_counted(members.filter(F.col("n") > SMALL).select("node").distinct())
    if n:
        met = prefixes(large, n, rows, known, idf, text, doc_id)
        met = met.join(broadcast_if_small(roots, classes), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = _prefix_pairs(met).join(tested, ["a", "b"], "left_anti")
        roots, classes, tested = _linked(rest, roots, classes, tested, rows, known, idf, text, doc_id)
    found = signed.select("id", "digest").join(nodes.select("digest", "node"), "digest", "left").join(broadcast_if_small(roots, classes), "node", "left")
    return found.select(F.col("id").alias(doc_id), F.when(F.col("id").isNotNull(), F.coalesce("root", "node", "id")).alias("class_id"))


def _all_lead(members: DataFrame) -> DataFrame:
    return members.select("bucket", F.col("node").alias("leader"), F.col("weight").alias("w2"), F.col("root").alias("root2"))


def _linked(pairs: DataFrame, roots: DataFrame, classes: int, tested: DataFrame, rows: DataFrame, known: np.ndarray, idf: np.ndarray, text: str,
            doc_id: str) -> tuple[DataFrame, int, DataFrame]:
    """The classes, their number of nodes and all pairs tested after pairs are verified."""
    pairs, n = cut_counted(pairs)
    if n:
        tested = tested.union(pairs)
        links, new = verified(pairs, rows, known, idf, text, doc_id)
        if new:
            roots, classes = _joined(roots, links)
    return roots, classes, tested


def _prefix_pairs(prefixes: DataFrame) -> DataFrame:
    """(a, b): pairs of different classes that share a shingle of their prefixes and leave enough weight behind it on either side.

    What two similar texts share weighs COMMON of both together at least, and all of it lies at or behind their first common shingle. Of the
    lighter text COMMON of twice its own weight must lie there, so its prefix is the shorter one.
    """
    light = prefixes.filter(F.col("behind") >= 2 * COMMON * F.col("weight"))
    light = light.select(F.col("bucket").alias("bucket2"), F.col("node").alias("other"), F.col("weight").alias("w2"), F.col("behind").alias("behind2"), F.col("root").alias("root2"))
    lighter = (F.col("w2") < F.col("weight")) | ((F.col("w2") == F.col("weight")) & (F.col("other") < F.col("node")))
    enough = F.least("behind", "behind2") >= COMMON * (F.col("weight") + F.col("w2"))
    near = F.col("w2") >= (SIMILAR - SLACK) * F.col("weight")
    met = prefixes.join(light, (F.col("bucket") == F.col("bucket2")) & (F.col("root") != F.col("root2")) & lighter & near & enough)
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def prefix(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, weight at and behind each) of a text, in the order of their counters, up to the last that SIMILAR of the weight does not lie behind.

    The common part of two similar texts weighs SIMILAR of either one at least, so its first shingle is in both prefixes.
    """
    order = np.lexsort((hashes, counts[(hashes % np.uint64(COUNTERS)).astype(np.intp)]))
    behind = np.cumsum(weights[order][::-1], dtype=np.float64)[::-1]
    keep = behind >= (SIMILAR - SLACK) * behind[0]
    return hashes[order][keep], behind[keep]


def prefixes(nodes: DataFrame, n: int, docs: DataFrame, known: np.ndarray, idf: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """(node, weight, bucket, behind): the prefix of every node's text; shingles are ordered by how many of these texts hold them."""
    kind = docs.schema[doc_id].dataType.simpleString()
    met = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()).join(broadcast_if_small(nodes, n), "node")
    # Rows that repeat an id are all taken; their prefixes are of one class.
    texts = cut(met.select("node", "_t"))

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, raw, offsets in text_slices(batch, "_t"):
                hashes = weighted_shingles(raw, offsets, known, idf)[0]
                total += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.intp), minlength=COUNTERS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    met_counts = texts.select("_t").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[met_counts.column("at").to_numpy()] = met_counts.column("n").to_numpy()

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, "_t"):
                hashes, weights, bounds = weighted_shingles(raw, offsets, known, idf)
                mine = [(i, weights[a:b].sum(dtype=np.float64), *prefix(hashes[a:b], weights[a:b], counts)) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                if mine:
                    at, weight, bucket, behind = zip(*mine, strict=True)
                    each = [len(x) for x in bucket]
                    yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(np.repeat(at, each))), pa.array(np.repeat(weight, each)),
                                                      pa.array(np.concatenate(bucket).view(np.int64)), pa.array(np.concatenate(behind))], names=["node", "weight", "bucket", "behind"])

    return cut(texts.mapInArrow(run, f"node {kind}, weight double, bucket bigint, behind double"))


def _joined(roots: DataFrame | None, links: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) and their number after links are added to the stars known so far."""
    new = links.select("a", "b")
    return cut_counted(components(new if roots is None else new.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs with the least id of their class, one of rows that repeat an id; rows with a null id stay. All columns stay."""
    classes = cut(near_duplicates(docs, text, doc_id))
    gone = cut(classes.filter(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias("_gone")).distinct())
    kept = docs.join(broadcast_if_small(gone, gone.count()), F.col(doc_id) == F.col("_gone"), "left_anti")
    repeated = classes.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).union(kept.filter(F.col(doc_id).isNull()))


def _across(pairs: DataFrame, roots: DataFrame, classes: int) -> DataFrame:
    """Pairs whose ends are in different classes."""
    end = lambda name: broadcast_if_small(roots, classes).select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    joined = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return joined.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
