"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for each piece of a fixed public vocabulary (byte-level pieces, so every text can be segmented). The
probability of a word is the sum over all its segmentations into pieces, by the forward algorithm; a text's score in a language is
the sum of its words' log-probabilities plus the language's log share, and the posterior over languages gives prediction and score.

Piece probabilities are fitted by expectation-maximisation (forward-backward counts over whole words) on a bounded sample: at most ``SAMPLE`` training
documents of each language, those with the smallest hashes of their id, whose words are counted in the tasks. All languages are learned and all pieces are used. Scoring covers every word of every text.

Cases: a null text or one without a letter is ``und`` with score 0; a null language isn't learned; without training rows every text is ``und``; repeated
rows each get a row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE = 300
ROUNDS = 2
#: Words above this many bytes are summed in logarithms, where products of probabilities would vanish.
PLAIN_BYTES = 64
#: Words' scores that a task keeps at most.
KEPT_WORDS = 300_000
LETTER = re.compile(r"[^\W\d_]")
TINY, HUGE = 1e-150, 1e150


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks, read by Spark, so that it may be in any store."""
    at = path if "://" in path else f"file://{path}"
    return sorted(base64.b64decode(r[0].split()[0]) for r in spark.read.text(at).collect() if r[0].strip())


def units(text: str) -> list[bytes]:
    """Lower-cased words, each with a space before it, as the vocabulary has them."""
    return [b" " + w for w in text.lower().encode().split()]


class Trie:
    """The pieces as a table of moves: ``move[node, byte]`` (0: none), and each node's probabilities in the models (0 where no piece ends)."""

    def __init__(self, pieces: dict[bytes, tuple[float, ...]], n: int) -> None:
        nodes: dict[bytes, int] = {b"": 1}
        for p in sorted(pieces):
            for e in range(1, len(p) + 1):
                nodes.setdefault(p[:e], len(nodes) + 1)
        self.move = np.zeros((len(nodes) + 1, 256), np.int32)
        self.prob = np.zeros((len(nodes) + 1, n))
        self.longest = max(map(len, pieces), default=1)
        for p, k in nodes.items():
            if p:
                self.move[nodes[p[:-1]], p[-1]] = k
            if p in pieces:
                self.prob[k] = pieces[p]

    def forward(self, words: list[bytes], at_once: int = 4096) -> np.ndarray:
        """Log-probability of each word in each model, summed over its segmentations; words of like length go side by side."""
        out = np.zeros((len(words), self.prob.shape[1]))
        sizes = np.array([len(w) for w in words])
        by = np.argsort(sizes, kind="stable")
        for a in range(0, len(words), at_once):
            some = by[a : a + at_once]
            out[some] = self._forward([words[i] for i in some], sizes[some])
        return out

    def _forward(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        n, longest, ring = len(words), int(sizes[-1]), self.longest + 1
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n, longest)
        alpha = np.zeros((ring, n, self.prob.shape[1]))
        alpha[0] = 1.0
        scale, out = np.zeros((n, 1)), np.zeros((n, self.prob.shape[1]))
        for s in range(longest):
            from_here = alpha[s % ring]
            if s:
                if (low := from_here.max(1) < TINY).any():
                    alpha[:, low] *= HUGE
                    scale[low] -= np.log(HUGE)
                if (done := sizes == s).any():
                    out[done] = np.log(np.maximum(from_here[done], 5e-324)) + scale[done]
            node = np.ones(n, np.int32)
            for e in range(s + 1, min(s + self.longest, longest) + 1):
                node = self.move[node, text[:, e - 1]]
                if not node.any():
                    break
                alpha[e % ring] += from_here * self.prob[node]
            alpha[s % ring] = 0.0
        done = sizes == longest
        out[done] = np.log(np.maximum(alpha[longest % ring][done], 5e-324)) + scale[done]
        return out


def _arcs(word: bytes, prob: dict[bytes, float], longest: int) -> list[tuple[int, int, bytes]]:
    return [(s, e, word[s:e]) for e in range(1, len(word) + 1) for s in range(max(0, e - longest), e) if word[s:e] in prob]


def _log_add(x: float, y: float) -> float:
    high, low = (x, y) if x > y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _expected_in_logs(word: bytes, c: int, prob: dict[bytes, float], longest: int, out: dict[bytes, float]) -> None:
    n, arcs = len(word), _arcs(word, prob, longest)
    a, b = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    a[0] = b[n] = 0.0
    for s, e, p in arcs:
        a[e] = _log_add(a[e], a[s] + math.log(prob[p]))
    for s, e, p in sorted(arcs, key=lambda x: -x[0]):
        b[s] = _log_add(b[s], b[e] + math.log(prob[p]))
    if a[n] > -math.inf:
        for s, e, p in arcs:
            if (x := a[s] + math.log(prob[p]) + b[e] - a[n]) > -700:
                out[p] = out.get(p, 0.0) + c * math.exp(x)


def expected(words: dict[bytes, int], prob: dict[bytes, float]) -> dict[bytes, float]:
    """Expected occurrences of each piece over all segmentations of counted words, each of them whole."""
    out: dict[bytes, float] = {}
    longest = max(map(len, prob), default=1)
    for w, c in words.items():
        n = len(w)
        if n > PLAIN_BYTES:
            _expected_in_logs(w, c, prob, longest, out)
            continue
        arcs = _arcs(w, prob, longest)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0] = b[n] = 1.0
        for s, e, p in arcs:
            a[e] += a[s] * prob[p]
        for s, e, p in sorted(arcs, key=lambda x: -x[0]):
            b[s] += b[e] * prob[p]
        if a[n] > 1e-280:
            for s, e, p in arcs:
                if x := a[s] * b[e]:
                    out[p] = out.get(p, 0.0) + c * x * prob[p] / a[n]
        else:
            _expected_in_logs(w, c, prob, longest, out)
    return out


def fit(counts: dict[str, Counter], vocabulary: list[bytes], rounds: int = ROUNDS) -> dict[bytes, tuple[float, ...]]:
    """Probabilities of the pieces in each language, in sorted order of the languages. Pieces seen in none get one shared floor by staying out, except single bytes."""
    known, longest = set(vocabulary), max(map(len, vocabulary), default=1)
    per_lang = []
    for lang in sorted(counts):
        start: Counter = Counter()
        for word, c in counts[lang].items():
            for s in range(len(word)):
                for e in range(s + 1, min(s + longest, len(word)) + 1):
                    if word[s:e] in known:
                        start[word[s:e]] += c * (e - s)
        mass: dict[bytes, float] = dict(start)
        for _ in range(rounds):
            total = sum(mass.values())
            mass = expected(counts[lang], {p: m / total for p, m in mass.items() if m > 1e-6})
        per_lang.append(mass)
    used = {p for m in per_lang for p, x in m.items() if x > 1e-3} | {bytes([i]) for i in range(256)}
    totals = [sum(m.values()) + 0.01 * len(used) for m in per_lang]
    return {p: tuple((m.get(p, 0.0) + 0.01) / t for m, t in zip(per_lang, totals, strict=True)) for p in used}


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Model:
    def __init__(self, langs: list[str], shares: list[float], pieces: dict[bytes, tuple[float, ...]]) -> None:
        self.langs, self.prior = langs, np.log(np.asarray(shares)) if shares else np.zeros(0)
        self.trie = Trie(pieces, len(langs)) if shares else None
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        tags, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.trie is None:
            return tags, scores
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size < 1_000_000):
                size += len(texts[b] or "")
                b += 1
            self._some(texts, a, b, tags, scores)
            a = b
        return tags, scores

    def _some(self, texts: list, a: int, b: int, tags: list[str], scores: list[float]) -> None:
        own = [i for i in range(a, b) if texts[i] is not None and LETTER.search(texts[i])]
        words = [units(texts[i]) for i in own]
        if len(self.index) > KEPT_WORDS:
            self.index, self.rows = {}, self.rows[:0]
        index = self.index
        if new := list({w for ws in words for w in ws if w not in index}):
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.trie.forward(new)])
        for i, ws in zip(own, words, strict=True):
            total = self.rows[[index[w] for w in ws]].sum(0) + self.prior
            p = np.exp(total - total.max())
            best = int(p.argmax())
            tags[i], scores[i] = self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    shares = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not shares:
        return Model([], [], {})
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang").withColumn("_nth", rank).where(F.col("_nth") <= sample).select("doc_id", "lang").distinct()
    chosen = known.join(F.broadcast(ids), ["doc_id", "lang"])

    def count(batches):
        import pyarrow as pa

        for b in batches:
            own: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.update((lang, w) for w in units(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.binary()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, Counter] = {lang: Counter() for lang in shares}
    for r in chosen.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect():
        counts[r["lang"]][bytes(r["word"])] = r["n"]
    pieces = fit(counts, read_vocabulary(docs.sparkSession, vocabulary))
    langs = sorted(shares)
    return Model(langs, [shares[x] / sum(shares.values()) for x in langs], pieces)


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document. The model has at most the vocabulary's pieces times the languages in numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches):
        import pyarrow as pa

        for b in batches:
            tags, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(told, kind)
