"""Language identification by a byte convolutional network, trained in NumPy and applied to windows of whole texts.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter keeps its largest answer, and a softmax over
the learned languages reads these answers. A text is cut into windows without gaps; its languages' probabilities are the means over its
windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.components import cut_counted
from weighbridge.llm.flat import picked, text_slices
from weighbridge.session import broadcast_if_small

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBEDDING = 8
TRAIN_DOCS = 600  # of each language at the most: the bound of the training sample
TRAIN_WINDOWS = 8  # of each of these
EPOCHS, BATCH, RATE = 8, 128, 0.004
UNKNOWN = "und"
BLOCK = 1024  # windows at once


@dataclass
class Net:
    """Weights: embedding (256, d), filters per width (width * d, FILTERS), their biases, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, positions, widest * d): the embedded bytes under the widest filter at every position."""
        x = self.embedding[windows]
        n, length, d = x.shape
        padded = np.zeros((n, length + WIDTHS[-1] - 1, d), np.float32)
        padded[:, :length] = x
        step = padded.strides
        return np.lib.stride_tricks.as_strided(padded, (n, length, WIDTHS[-1] * d), (step[0], step[1], step[2]))

    def answers(self, patches: np.ndarray) -> np.ndarray:
        """(n, positions, filters) before pooling; all widths in one product, narrow filters padded with zeros."""
        size = WIDTHS[-1] * self.embedding.shape[1]
        full = np.zeros((size, FILTERS * len(WIDTHS)), np.float32)
        for k, f in enumerate(self.filters):
            full[: len(f), k * FILTERS: (k + 1) * FILTERS] = f
        n, length, _ = patches.shape
        flat = np.ascontiguousarray(patches).reshape(n * length, size)
        return (flat @ full).reshape(n, length, -1)

    def pooled(self, answers: np.ndarray) -> np.ndarray:
        return np.maximum(answers.max(axis=1) + np.concatenate(self.filter_bias), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) for windows of bytes, zero where a text has ended."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), BLOCK):
            z = self.pooled(self.answers(self.patches(windows[at: at + BLOCK]))) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at: at + BLOCK] = z / z.sum(axis=1, keepdims=True)
        return out


def cut_windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes used in each, first window of every text and the end); an empty text has none."""
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(number)])
    text = np.repeat(np.arange(len(sizes)), number)
    begin = offsets[text] + (np.arange(first[-1]) - first[text]) * WINDOW
    used = np.minimum(WINDOW, offsets[text + 1] - begin)
    place = begin[:, None] + np.arange(WINDOW)
    windows = raw[np.minimum(place, max(len(raw) - 1, 0))] if len(raw) else np.zeros((0, WINDOW), np.uint8)
    windows[np.arange(WINDOW) >= used[:, None]] = 0
    return windows, used, first


def train(x: np.ndarray, labels: list[str], seed: int = 7) -> Net | None:
    """Fit a network to windows of bytes; None without any. Classes weigh alike whatever their number of windows."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(label) for label in labels], np.int64)
    if not len(x):
        return None
    d, total = EMBEDDING, FILTERS * len(WIDTHS)
    net = Net(languages, rng.normal(0, 0.5, (256, d)).astype(np.float32),
              [rng.normal(0, (w * d) ** -0.5, (w * d, FILTERS)).astype(np.float32) for w in WIDTHS],
              [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
              rng.normal(0, total**-0.5, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    weight = len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))
    params = [net.embedding, *net.filters, *net.filter_bias, net.out, net.out_bias]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at: at + BATCH]
            # Short ends are common in use: some windows are blanked from a random place on.
            bx = x[rows]
            short = rng.random(len(rows)) < 0.2
            bx[short[:, None] & (np.arange(WINDOW) >= rng.integers(16, WINDOW, len(rows))[:, None])] = 0
            grads = _gradients(net, bx, y[rows], weight[y[rows]])
            steps += 1
            for p, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (0.5 ** (epoch / 3)) * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    return net


def _gradients(net: Net, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted cross-entropy, in the order of the parameters."""
    n, d = len(windows), net.embedding.shape[1]
    patches = net.patches(windows)
    answers = net.answers(patches)
    best = answers.argmax(axis=1)  # the only positions that pooling lets gradients through
    hidden = net.pooled(answers)
    z = hidden @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    dz = (p * weight[:, None] / n).astype(np.float32)
    dh = (dz @ net.out.T) * (hidden > 0)
    padded = np.pad(windows, ((0, 0), (0, WIDTHS[-1] - 1)))
    real = np.pad(np.ones(windows.shape, bool), ((0, 0), (0, WIDTHS[-1] - 1)))
    demb = np.zeros_like(net.embedding)
    dfilters, dbias = [], []
    for k, f in enumerate(net.filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        at, g = best[:, cols], dh[:, cols]
        width = WIDTHS[k]
        under = patches[np.arange(n)[:, None], at][..., : width * d]
        dfilters.append(np.einsum("nfs,nf->sf", under, g))
        dbias.append(g.sum(axis=0))
        back = (g[..., None] * f.T[None]).reshape(n, FILTERS, width, d)
        where = at[..., None] + np.arange(width)
        ids = padded[np.arange(n)[:, None, None], where]
        back = back * real[np.arange(n)[:, None, None], where][..., None]
        for c in range(d):
            demb[:, c] += np.bincount(ids.ravel(), back[..., c].ravel(), 256).astype(np.float32)
    return [demb, *dfilters, *dbias, hidden.T @ dz, dz.sum(axis=0)]


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[np.ndarray, list[str]]:
    """Windows and labels from about TRAIN_DOCS rows of every language, picked by a hash of the id.

    A row gives at most TRAIN_WINDOWS windows from random places of its whole text; short ends are left out.
    """
    rows = docs.filter(F.col(lang).isNotNull() & has_letter(text)).select(doc_id, text, lang)
    # A table of one row a language, met by hash: any number of languages.
    counts, n = cut_counted(rows.groupBy(F.col(lang).alias("_label")).agg(F.least(F.lit(1.0), TRAIN_DOCS / F.count(F.lit(1))).alias("_chance")))
    if not n:
        return np.zeros((0, WINDOW), np.uint8), []
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                windows, used, first = cut_windows(raw, offsets)
                for i, label in enumerate(part.column(lang).to_pylist()):
                    mine = np.arange(first[i], first[i + 1])
                    mine = mine[used[mine] >= min(WINDOW // 4, offsets[i + 1] - offsets[i])]
                    if len(mine) > TRAIN_WINDOWS:
                        mine = np.random.default_rng(len(mine)).choice(mine, TRAIN_WINDOWS, replace=False)
                    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in windows[mine]], pa.binary()), pa.array([label] * len(mine), pa.string())],
                                                     names=["w", "label"])

    drawn = rows.join(broadcast_if_small(counts, n), (F.col(lang) == F.col("_label")) & (draw < F.col("_chance")))
    got = drawn.select(text, F.col(lang).cast("string").alias(lang)).mapInArrow(run, "w binary, label string").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["w"])))
    return np.frombuffer(b"".join(bytes(r["w"]) for r in got), np.uint8).reshape(-1, WINDOW), [r["label"] for r in got]


def predict(docs: DataFrame, net: Net | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep plus lang_pred and score (the language's probability), a row for every row, from the text alone.

    A null text, one without a letter, and every text if nothing was learned, is `und` with score 0. Other columns are left out.
    """
    rows = picked(docs.select(*keep, text, has_letter(text).alias("_letter")), *keep, text, "_letter")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["lang_pred string, score double"])
    weights = None if net is None else (net.languages, net.embedding, net.filters, net.filter_bias, net.out, net.out_bias)

    def run(batches):
        model = None if weights is None else Net(*weights)
        for batch in batches:
            for part, raw, offsets in text_slices(batch, text):
                n = part.num_rows
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if model is not None:
                    windows, used, first = cut_windows(raw, offsets)
                    p = model.probabilities(windows) * used[:, None]
                    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
                    best = mean.argmax(axis=1)
                    ok = np.array(part.column("_letter").to_pylist())
                    score = np.where(ok, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                    lang = [model.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
