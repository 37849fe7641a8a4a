"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. A label model is fitted to the votes without labels: expectation-maximisation
estimates each rule's accuracy, and a document is kept if its posterior probability of being good reaches the threshold. Votes form few distinct patterns (3 to the number of rules at most), so the fit works on
counts of patterns: one grouped aggregate over all documents gives them, and their number does not grow with the corpus.

Cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows each get a row; an empty table gives no
rows; other columns are carried by :func:`keep_rows`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .shared import cut

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 50
START, SIGN_START, PRIOR = 0.85, 0.6, 0.2
SYMBOLS = b"#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Each detector votes bad on a document at this share or above, and abstains below.
DETECTORS = {
    "repeated_windows": 0.40,
    "symbols_per_word": 0.15,
    "words_with_symbols": 0.15,
    "capitals": 0.50,
    "exclamations_per_word": 0.15,
    "duplicate_lines": 0.30,
    "top_word": 0.25,
    "few_letters": 0.30,
    "odd_word_length": 1.0,
}
#: Each of these votes good on a document whose own measure lies in this range, whatever the detectors say, and abstains elsewhere.
SIGNS = {
    "word_length": (3.0, 10.0),
    "sentence_ends": (1 / 60, 1 / 3),
    "line_words": (5.0, np.inf),
    "letter_share": (0.80, 1.0),
    "word_variety": (3.0, np.inf),
}
NEAR = 0.5
#: The last rule, ``ordinary``, votes good on documents on which no detector comes near its threshold, and abstains on the others.
RULES = [*DETECTORS, *SIGNS, "ordinary"]
#: Much of what is bad has ordinary words and sentences too, so a sign starts as weaker evidence than a detector.
STARTS = np.array([SIGN_START if r in SIGNS else START for r in RULES])
#: A class counts in the balance of :func:`fit` with this part of all documents more than it has.
FLOOR = 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and votes of each text of a column."""
    out: dict[str, list] = {c: [] for c in [*COUNTS, "votes"]}
    for a, b, data, offs in tc.parts(column):
        n = b - a
        starts, ends, doc = tc.words(data, offs)
        count = lambda mask, n=n, offs=offs: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])  # noqa: E731  marked bytes of each document
        n_words = tc.per_doc(doc, n)
        ink = ~tc.WHITE[data]
        word_chars = count(ink & ((data & 0xC0) != 0x80))
        n_symbols = count(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
        upper = count((data >= 65) & (data <= 90))
        letters = count(((data | 32) >= 97) & ((data | 32) <= 122))
        bangs = count((data == 33) | (data == 63))
        hashes = tc.span_hashes(data, starts, ends)
        h3, whole = tc.grams(hashes, doc, 3)
        at = np.flatnonzero(whole)
        again = at[tc.repeated_within(h3[at], doc[at])]
        in_repeat = tc.covered(again, 3, len(starts)) if len(starts) else np.zeros(0, bool)
        n_repeat = tc.per_doc(doc[in_repeat], n)
        dup, lines, _ = _lines(data, offs, starts, ends, doc, n)
        top, distinct = _word_counts(hashes, doc, n)
        w, ch = np.maximum(n_words, 1), np.maximum(word_chars, 1)
        mean = ch / w
        marked = np.add.reduceat(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)).astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
        share = {
            "repeated_windows": n_repeat / w,
            "symbols_per_word": n_symbols / w,
            "words_with_symbols": tc.per_doc(doc[marked], n) / w,
            "capitals": np.where(letters >= 20, upper / np.maximum(letters, 1), 0),
            "exclamations_per_word": bangs / w,
            "duplicate_lines": np.where(lines >= 4, dup / np.maximum(lines, 1), 0),
            "top_word": np.where(n_words >= 20, top / w, 0),
            "few_letters": 1 - (letters + count(data >= 0xC0)) / ch,
            "odd_word_length": np.where((mean < 2.0) | (mean > 14), 1.0, 0.0),
        }
        sign = {
            "word_length": mean,
            "sentence_ends": tc.per_doc(doc[_ends_sentence(data, starts, ends)], n) / w,
            "line_words": n_words / np.maximum(lines, 1),
            "letter_share": (letters + count(data >= 0xC0)) / ch,
            "word_variety": distinct / np.sqrt(w),
        }
        bad = np.stack([share[r] >= at for r, at in DETECTORS.items()], 1)
        near = np.stack([share[r] >= NEAR * at for r, at in DETECTORS.items()], 1)
        good = np.stack([(sign[r] >= low) & (sign[r] <= high) for r, (low, high) in SIGNS.items()], 1)
        votes = np.concatenate([np.where(bad, BAD, ABSTAIN), np.where(good, GOOD, ABSTAIN), np.where(near.any(1), ABSTAIN, GOOD)[:, None]], 1)
        votes[n_words == 0] = ABSTAIN
        text = [bytes(v).decode() for v in (votes.astype(np.uint8) + 48)]
        for k, v in zip(COUNTS, (n_words, word_chars, n_symbols, dup, n_repeat), strict=True):
            out[k].append(v.astype(np.int64))
        out["votes"].append(np.array(text, object))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _lines(data, offs, starts, ends, doc, n):
    r"""For each document: lines (between \n) with a word that equal an earlier one, lines with a word, and those that don't end in closing punctuation."""
    cut = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut + 1])) if len(data) else np.zeros(0, np.int64)
    first = first[first < len(data)]
    end = np.concatenate([first[1:], [len(data)]]).astype(np.int64) if len(first) else first
    if not len(first):
        zero = np.zeros(n, np.int64)
        return zero, zero, zero
    end = end - ((end > first) & (data[end - 1] == 10))
    has = np.searchsorted(starts, end) > np.searchsorted(starts, first)
    first, end = first[has], end[has]
    if not len(first):
        zero = np.zeros(n, np.int64)
        return zero, zero, zero
    of = np.searchsorted(offs, first, side="right") - 1
    h = tc.span_hashes(data, first, end)
    order = np.lexsort((np.arange(len(h)), h, of))
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    last = ends[np.searchsorted(starts, end) - 1] - 1
    closed = np.isin(data[last], np.frombuffer(b".!?:;,\"')", np.uint8))
    return tc.per_doc(of[later], n), tc.per_doc(of, n), tc.per_doc(of[~closed], n)


def _word_counts(hashes, doc, n):
    """Occurrences of each document's most frequent word, and its distinct words."""
    top, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(hashes):
        key = np.sort((doc.astype(np.uint64) << np.uint64(43)) | (hashes >> np.uint64(21)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of = (key[new] >> np.uint64(43)).astype(np.int64)
        np.maximum.at(top, of, np.diff(np.concatenate([new, [len(key)]])))
        distinct = tc.per_doc(of, n)
    return top, distinct


def _ends_sentence(data, starts, ends):
    """Whether each word ends in a full stop, an exclamation or a question mark, also before one closing quote or bracket or as the last byte of a full-width one."""
    if not len(starts):
        return np.zeros(0, bool)
    last = data[ends - 1]
    before = np.where(ends - 2 >= starts, data[np.maximum(ends - 2, 0)], last)
    first = np.where(ends - 3 >= starts, data[np.maximum(ends - 3, 0)], last)
    wide = ((first == 0xE3) & (before == 0x80) & (last == 0x82)) | ((first == 0xEF) & (before == 0xBC) & ((last == 0x81) | (last == 0x9F)))
    marks = np.frombuffer(b".!?", np.uint8)
    return np.isin(np.where(np.isin(last, np.frombuffer(b"\"')]", np.uint8)), before, last), marks) | wide


MEASURED = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("votes", T.StringType())])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the votes of each document."""

    def each(batches):
        for b in batches:
            m = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(m["votes"], pa.string())], ["doc_id", *COUNTS, "votes"])

    return docs.select("doc_id", "text").mapInArrow(each, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *MEASURED.fields]))


def fit(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Each rule's accuracy, the chance that a vote it casts is right, from counts of vote patterns.

    Expectation-maximisation without labels: from the accuracies follow the documents' posteriors, from these the accuracies again. Both classes
    have a prior of one half, so that the many good documents do not outvote a rule that finds one kind of bad ones. For votes of good both classes
    weigh the same in the accuracy, too: a rule that says good of good and bad documents alike has little to say, however many are good. A vote of bad
    is right as often as the documents it falls on are bad. A rule starts at its place in ``STARTS``, which counts as ``PRIOR`` times the votes that
    it casts, and is never taken for worse than chance; this fixes which class is the good one.
    """
    accuracy = STARTS.copy()
    if not patterns:
        return accuracy
    votes = np.array([[ord(c) - 48 for c in p] for p, _ in patterns])
    weight = np.array([c for _, c in patterns], float)
    for _ in range(rounds):
        good = posterior(votes, accuracy)[:, None]
        own = np.stack([weight * (1 - good[:, 0]), weight * good[:, 0]])
        even = own * weight.sum() / 2 / (own.sum(1, keepdims=True) + FLOOR * weight.sum())
        votes_good, votes_bad = (even @ (votes == GOOD)), (own @ (votes == BAD))
        cast = votes_good.sum(0) + votes_bad.sum(0)
        right = votes_good[GOOD] + votes_bad[BAD]
        accuracy = np.clip((right + STARTS * (PRIOR * cast + 1)) / ((1 + PRIOR) * cast + 1), 0.5, 0.999)
    return accuracy


def posterior(votes: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Probability of being good for each row of votes."""
    odds = ((votes == GOOD).astype(int) - (votes == BAD)) @ np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-odds))


def label_model(measured: DataFrame) -> dict[str, float]:
    """Each pattern of votes' probability of good; at most 3 ** rules patterns."""
    seen = [(r[0], r[1]) for r in measured.groupBy("votes").count().collect()]
    votes = np.array([[ord(c) - 48 for c in p] for p, _ in seen]).reshape(-1, len(RULES))
    good = posterior(votes, fit(seen)) if seen else []
    return {p: float(g) for (p, _), g in zip(seen, good, strict=True)}


def judged(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, p_good, votes and kept of each document. Texts are measured once; what is cut holds none."""
    rows = cut(measures(docs))
    model = docs.sparkSession.createDataFrame(list(label_model(rows).items()), "votes string, p_good double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    scored = rows.join(F.broadcast(model), "votes", "left").withColumn("base_failed", failed)
    return scored.select("doc_id", *COUNTS, "base_failed", (~failed & (F.coalesce("p_good", F.lit(0.0)) >= keep_at)).alias("kept"), "p_good", "votes")


def keep_rows(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that are kept, with all the input's columns. Texts are measured twice, once for the model and once for the verdicts, so that none is stored."""
    model, at = label_model(measures(docs)), docs.columns.index("text")

    def keep(batches):
        for b in batches:
            m = measure(b.column(at))
            good = np.array([model.get(v, 0.0) >= keep_at for v in m["votes"]], bool)
            n = m["n_words"]
            yield b.filter(pa.array(good & (n >= MIN_WORDS) & (m["n_repeat_words"] * 100 <= n * REPEAT_PERCENT)))

    return docs.mapInArrow(keep, docs.schema)
