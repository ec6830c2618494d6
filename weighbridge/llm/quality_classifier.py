"""A quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text is the set of its one- and two-token n-grams, and of the pattern of one token three times, hashed to DIM places; a token is a run of letters and digits or a run of other marks.
Every present n-gram weighs its log-count ratio between the classes, the vector is scaled to length one, and a linear hinge-loss model is
fitted by dual coordinate descent. Margins become probabilities by a logistic curve fitted on margins of held-back parts of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.flat import Flat, byte_table, picked, text_slices, window_hashes

DIM = 1 << 18
TRAIN_DOCS = 8000  # the bound of the labelled sample
COST, ROUNDS, SMOOTH = 1.0, 12, 1.0
FOLDS = 3
STUTTER = 1
THRESHOLD = 0.3

LETTERS = byte_table((48, 57), (65, 90), (97, 122), (128, 255))
SPACE = byte_table((9, 13), (32, 32))


@dataclass
class Model:
    """weight already holds the ratios: a margin is bias plus the mean of weights over the vector's length."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds): the distinct hashed n-grams of every text of a slice."""
    # Marks and letters are tokenised apart and put in text order.
    parts = [Flat(raw, offsets, LETTERS, fold=True), Flat(raw, offsets, ~(LETTERS | SPACE))]
    start = np.concatenate([p.start for p in parts])
    order = np.argsort(start, kind="stable")
    words = np.concatenate([p.hashes() for p in parts])[order]
    text = np.concatenate([p.text_of_word() for p in parts])[order]
    pairs = np.flatnonzero(text[1:] == text[:-1])
    mask = np.uint64(DIM - 1)
    # Stuttering is one n-gram whatever the token: three equal ones in a row have a place of their own.
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    stutter = np.flatnonzero(same[1:] & same[:-1])
    keys = np.concatenate([text * DIM + (words & mask).astype(np.int64), text[pairs] * DIM + (window_hashes(words, pairs, 2) & mask).astype(np.int64),
                           text[stutter] * DIM + STUTTER])
    keys = np.unique(keys)
    return (keys % DIM).astype(np.int32), np.searchsorted(keys, np.arange(len(offsets)) * DIM)


def log_ratios(places: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-count ratio of every place: how much likelier it is in class 1 than in class 0."""
    row = np.repeat(y, np.diff(bounds))
    good = np.bincount(places[row == 1], minlength=DIM) + SMOOTH
    bad = np.bincount(places[row == 0], minlength=DIM) + SMOOTH
    return (np.log(good / good.sum()) - np.log(bad / bad.sum())).astype(np.float32)


def lengths(places: np.ndarray, bounds: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Length of every text's scaled vector, 1 for texts without n-grams."""
    total = np.concatenate([[0.0], np.cumsum(ratio[places].astype(np.float64) ** 2)])
    size = np.sqrt(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0))
    return np.where(size > 0, size, 1.0)


def descend(places: np.ndarray, bounds: np.ndarray, y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; a class weighs the more the rarer it is."""
    size = lengths(places, bounds, ratio)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.bincount(y, minlength=2) / len(y)
    most = COST * 0.5 / share[y]
    alpha, w, bias = np.zeros(len(y)), np.zeros(DIM, np.float64), 0.0
    values = ratio[places].astype(np.float64) / np.repeat(size, np.diff(bounds))
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = places[bounds[i]: bounds[i + 1]], values[bounds[i]: bounds[i + 1]]
            gradient = sign[i] * (x @ w[at] + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1.0), 0.0), most[i])  # the 1 is the bias feature
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def margins(places: np.ndarray, bounds: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """weight is w times ratio."""
    total = np.concatenate([[0.0], np.cumsum(weight[places], dtype=np.float64)])
    return bias + (total[bounds[1:]] - total[bounds[:-1]]) / lengths(places, bounds, ratio)


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by Newton steps on softened targets."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(shift)


def fit(places: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> Model:
    """A model of all rows; its curve comes from models of FOLDS - 1 parts. With one class or none every score is that class."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 0.0, 0.0 if not len(y) else 30.0 if y[0] == 1 else -30.0)
    fold, out = np.random.default_rng(3).integers(0, FOLDS, len(y)), np.zeros(len(y))
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))
    for k in range(FOLDS):
        inside = fold != k
        if len(set(y[inside].tolist())) < 2 or inside.all():
            continue
        some = places[inside[rows]]
        edge = np.concatenate([[0], np.cumsum(np.diff(bounds)[inside])])
        ratio = log_ratios(some, edge, y[inside])
        w, bias = descend(some, edge, y[inside], ratio, k)
        out[~inside] = margins(places, bounds, ratio, (w * ratio).astype(np.float32), bias)[~inside]
    ratio = log_ratios(places, bounds, y)
    w, bias = descend(places, bounds, y, ratio, FOLDS)
    return Model(ratio, (w * ratio).astype(np.float32), bias, *logistic(out, y))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on at most about TRAIN_DOCS labelled rows, picked by a hash of the id.

    Ids with labels of both kinds, or none, are left out. docs and labels decide what may be learned from: filter both before.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < min(1.0, TRAIN_DOCS / max(n, 1))).select(doc_id, F.col("_y").cast("int").alias("_y"))
    # TRAIN_DOCS ids on average: the bound of the sample is that of the broadcast.
    rows = docs.select(doc_id, text).join(F.broadcast(some), doc_id).select(text, "_y")

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                places, bounds = ngrams(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_y"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places))], names=["y", "places"])

    got = rows.mapInArrow(run, "y int, places array<int>").toArrow().combine_chunks()
    lists = sorted(zip(got.column("y").to_pylist(), [np.asarray(x.values) for x in got.column("places")], strict=True), key=lambda r: (r[0], r[1].tobytes()))
    y = np.array([r[0] for r in lists], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(r[1]) for r in lists])]).astype(np.int64)
    return fit(np.concatenate([r[1] for r in lists]) if lists else np.zeros(0, np.int32), bounds, y)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep plus score (probability of class 1) and predicted, under names, a row for every row, from the text alone.

    A text without tokens, null included, gets the score of the bias. keep may hold the text itself; other columns are left out.
    """
    rows = picked(docs, *dict.fromkeys([*keep, text]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{names[0]} double, {names[1]} int"])
    ratio, weight, bias, slope, shift = model.ratio, model.weight, model.bias, model.slope, model.shift

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                m = margins(*ngrams(raw, offsets), ratio, weight, bias)
                p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                                 names=[*keep, *names])

    return rows.mapInArrow(run, schema)
