r"""Document quality from a linear-chain conditional random field over lines.

A document is the chain of its lines (split at ``\n``, those with a word). Each line is good or bad; its emission score sums
weights of binned measures of the line and of both neighbours, and a transition weight links the labels of consecutive lines. Training
maximises the conditional log-likelihood of labelled documents (a line takes its document's label) by gradient ascent with forward-backward
expectations. A document's raw quality is the mean of its lines' marginal probabilities of being good, weighted by the lines' characters; a
logistic curve fitted on the same training documents calibrates it.

The fit uses a bounded sample: ``SAMPLE`` labelled training documents of each label, those with the smallest hashes of their id. Scoring covers every
line of every text.

Cases: a null text or one without a word has no line and scores ``EMPTY_SCORE``; labels that are null or of unknown documents are left out; with no
labelled rows the weights are 0 and every document with a word scores 0.5; repeated rows each get a row; an empty table gives no rows; other columns
of the inputs are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc

#: Labels are ranked in so many parts first.
RANK_PARTS = 64
SAMPLE = 2000
EMPTY_SCORE = 0.0
THRESHOLD = 0.3
STEPS = 120
#: Upper edges of the bins of each measure of a line.
EDGES = {
    "words": (2, 5, 12, 30, 80),
    "mean_length": (2.5, 3.5, 5, 7, 10),
    "symbols": (0.001, 0.05, 0.2),
    "capitals": (0.02, 0.1, 0.3, 0.6),
    "bangs": (0.001, 0.05, 0.2),
    "repeats": (0.001, 0.1, 0.3, 0.6),
    "top_word": (0.1, 0.2, 0.4, 0.7),
    "few_letters": (0.02, 0.1, 0.25),
    "commas": (0.001, 0.05, 0.15, 0.3),
    "seen_before": (0.5,),
    "closed": (0.5,),
}
N_BINS = sum(len(e) + 1 for e in EDGES.values())
N_FEATURES = 3 * N_BINS + 3


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of a part (each with its line break) and the document of each."""
    first = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(data == 10) + 1]))
    first = first[first < len(data)].astype(np.int64)
    return np.concatenate([first, [len(data)]]).astype(np.int64), np.searchsorted(offs, first, side="right") - 1


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features of each line (rows of indices into N_FEATURES), each line's document and its characters."""
    edges, of = _lines(data, offs)
    starts, ends, line = tc.words(data, edges)
    n = len(edges) - 1
    n_words = tc.per_doc(line, n)
    has = np.flatnonzero(n_words > 0)
    if not len(has):
        return np.zeros((0, 3 * len(EDGES)), np.int64), np.zeros(0, np.int64), np.zeros(0)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[edges])
    chars = count(~tc.WHITE[data] & ((data & 0xC0) != 0x80))
    letters = count(((data | 32) >= 97) & ((data | 32) <= 122))
    hashes = tc.span_hashes(data, starts, ends)
    h3, whole = tc.grams(hashes, line, 3)
    at = np.flatnonzero(whole)
    again = tc.covered(at[tc.repeated_within(h3[at], line[at])], 3, len(starts))
    top = np.zeros(n, np.int64)
    key = np.sort(hashes ^ tc.mix64(line.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashes ^ tc.mix64(line.astype(np.uint64) + np.uint64(1)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    np.maximum.at(top, line[order[new]], np.diff(np.concatenate([new, [len(key)]])))
    last = np.full(n, -1)
    last[line] = ends - 1
    text = tc.span_hashes(data, edges[:-1][has], edges[1:][has] - (data[edges[1:][has] - 1] == 10))
    by = np.lexsort((np.arange(len(has)), text, of[has]))
    seen = np.zeros(len(has))
    seen[by[1:]] = (text[by][1:] == text[by][:-1]) & (of[has][by][1:] == of[has][by][:-1])
    w, c = np.maximum(n_words, 1)[has], np.maximum(chars, 1)[has]
    values = {
        "words": n_words[has],
        "mean_length": c / w,
        "symbols": count(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))[has] / c,
        "capitals": count((data >= 65) & (data <= 90))[has] / np.maximum(letters, 1)[has],
        "bangs": count((data == 33) | (data == 63))[has] / w,
        "repeats": tc.per_doc(line[again], n)[has] / w,
        "top_word": np.where(w >= 8, top[has] / w, 0.15),
        "few_letters": 1 - (letters + count(data >= 0xC0))[has] / c,
        "commas": count(np.isin(data, np.frombuffer(b",.;:", np.uint8)))[has] / w,
        "seen_before": seen,
        "closed": np.isin(data[last[has]], np.frombuffer(b".!?:;,\"')", np.uint8)),
    }
    own, base = [], 0
    for name, cuts in EDGES.items():
        own.append(np.searchsorted(cuts, values[name], side="right") + base)
        base += len(cuts) + 1
    own, doc = np.stack(own, 1), of[has]
    begin, end = np.concatenate([[True], doc[1:] != doc[:-1]]), np.concatenate([doc[1:] != doc[:-1], [True]])
    before, after = np.roll(own, 1, 0) + N_BINS, np.roll(own, -1, 0) + 2 * N_BINS
    before[begin], after[end] = 3 * N_BINS, 3 * N_BINS + 1
    return np.concatenate([own, before, after], 1), doc, chars[has].astype(float)


def marginals(emit: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of (bad, good) of each line, expected transitions and the log-likelihood's normaliser, for all chains side by side."""
    n = len(emit)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
    step = np.exp(move)
    a, b = np.empty((n, 2)), np.empty((n, 2))
    e = np.exp(emit - emit.max(1, keepdims=True))
    logz = float(emit.max(1).sum())
    for t, k in enumerate(live):
        i = first[:k] + t
        x = e[i] if not t else (a[i - 1] @ step) * e[i]
        s = x.sum(1, keepdims=True)
        logz += float(np.log(s).sum())
        a[i] = x / s
    pair = np.zeros((2, 2))
    b[first + size - 1] = 1.0
    for t in range(len(live) - 1, 0, -1):
        i = first[: live[t]] + t
        y = b[i] * e[i]
        x = y @ step.T
        joint = a[i - 1][:, :, None] * step[None] * y[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b[i - 1] = x / x.sum(1, keepdims=True)
    p = a * b
    return p / p.sum(1, keepdims=True), pair, logz


class Model:
    """Weights of the features for good against bad, transition weights and the calibration."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, curve: tuple[float, float]) -> None:
        self.weights, self.move, self.curve = weights, move, curve

    def raw(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document; nan for those without a line."""
        active, doc, chars = line_features(data, offs)
        n = len(offs) - 1
        if not len(doc):
            return np.full(n, np.nan)
        good = self.weights[active].sum(1) + self.weights[-1]
        p, _, _ = marginals(np.stack([np.zeros(len(good)), good], 1), self.move, doc)
        with np.errstate(invalid="ignore", divide="ignore"):
            return tc.per_doc(doc, n, p[:, 1] * chars) / tc.per_doc(doc, n, chars)

    def score(self, column: pa.Array) -> np.ndarray:
        raw = [self.raw(data, offs) for _, _, data, offs in tc.parts(column)]
        x = np.concatenate(raw) if raw else np.zeros(0)
        slope, shift = self.curve
        with np.errstate(over="ignore"):
            y = 1 / (1 + np.exp(-(slope * (x - 0.5) + shift)))
        return np.where(np.isnan(x), EMPTY_SCORE, y)


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS, l2: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the chains of the given documents."""
    weights, move = np.zeros(N_FEATURES), np.zeros((2, 2))
    data, offs = tc.buffers(pa.array(texts, pa.string()))
    active, doc, _ = line_features(data, offs)
    if not len(doc):
        return Model(weights, move, (1.0, 0.0))
    y = np.asarray(labels)[doc]
    within = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][within], y[1:][within]), 1)
    m = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    v = [np.zeros(N_FEATURES), np.zeros((2, 2))]
    n = len(doc)
    for t in range(1, steps + 1):
        good = weights[active].sum(1) + weights[-1]
        p, pair, _ = marginals(np.stack([np.zeros(n), good], 1), move, doc)
        miss = y - p[:, 1]
        g = np.bincount(active.ravel(), np.repeat(miss, active.shape[1]), minlength=N_FEATURES)
        g[-1] = miss.sum()
        for k, (grad, at) in enumerate(((g / n - l2 * weights, weights), ((seen - pair) / n - l2 * move, move))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            at += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    model = Model(weights, move, (1.0, 0.0))
    x = model.raw(data, offs)
    model.curve = _calibrate(x[~np.isnan(x)] - 0.5, np.asarray(labels)[~np.isnan(x)])
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic slope and shift, by Newton steps with a ridge."""
    a, b = 6.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 6), (y - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a + da, 0.5, 30)), float(np.clip(b + db, -10, 10))
    return a, b


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents of each label outside the held-out fold, ranked within parts of a label before the whole; a doc_id that comes with several texts counts with the smallest."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    near = known.withColumn("_part", F.pmod(F.hash("doc_id"), F.lit(RANK_PARTS)))
    near = near.withColumn("_nth", F.row_number().over(Window.partitionBy("label", "_part").orderBy(*order))).where(F.col("_nth") <= sample)
    chosen = near.withColumn("_nth", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("_nth") <= sample).drop("_nth", "_part")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id", "label").collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    @F.pandas_udf(T.DoubleType())
    def quality(texts):
        import pandas as pd

        return pd.Series(model.score(pa.array(texts, pa.string(), from_pandas=True)))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
