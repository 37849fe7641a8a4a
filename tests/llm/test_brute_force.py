"""Rows of whole queries against plain Python: rules' verdicts, languages, shards."""

import base64
import collections
import functools
import math
import random
import re
import struct
import zlib

import pytest
import xxhash

from folianta.llm import language_id, sharding, weak_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = {"en": lambda: rng.choice(["the", "of", "house", "running", "water", "ship"]), "de": lambda: rng.choice(["der", "und", "häuser", "laufend", "wasser", "schiff"])}
    out = [(0, None, "en", "a", 0), (1, "", None, None, 0), (2, "12 34 !!", "de", "a", 0)]
    for i in range(3, 120):
        lang = rng.choice(["en", "de"])
        n = rng.choice([5, 60, 90])
        plain = i % 3 == 0
        text = " ".join((word[lang]() if not plain or rng.random() < 0.3 else "".join(rng.choices("abcdeiostn", k=rng.randint(3, 8)))) + rng.choice([""] * 9 + ["."] if plain else ["", "", "", ".", " ###", "!"]) for _ in range(n))
        text = rng.choice([text, text.upper(), "\n".join([text[:40]] * 6 + [text]), text.replace(" ", "\n", 9)])
        out.append((i, text, lang, rng.choice(["a", "b", None]), len(text)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_verdicts_are_those_of_a_plain_expectation_maximisation(docs, rows):
    """One document after the other, one rule after the other, from the votes that the query shows."""
    got = {r.doc_id: r for r in weak_rules.judged(docs).collect()}
    votes = [got[r[0]].votes for r in rows]
    accuracy = list(map(float, weak_rules.STARTS))

    def good(vote):
        odds = sum((c == "1") * math.log(a / (1 - a)) - (c == "0") * math.log(a / (1 - a)) for c, a in zip(vote, accuracy, strict=True))
        return 1 / (1 + math.exp(-odds))

    n = len(rows)
    for _ in range(weak_rules.ROUNDS):
        p = [good(v) for v in votes]
        mass = {"1": sum(p), "0": n - sum(p)}
        even = {c: n / 2 / (mass[c] + weak_rules.FLOOR * n) for c in mass}
        new = []
        for k, start in enumerate(map(float, weak_rules.STARTS)):
            right = cast = 0.0
            for v, q in zip(votes, p, strict=True):
                if v[k] == "1":
                    right += q * even["1"]
                    cast += q * even["1"] + (1 - q) * even["0"]
                elif v[k] == "0":
                    right += 1 - q
                    cast += 1
            new.append(min(0.999, max(0.5, (right + start * (weak_rules.PRIOR * cast + 1)) / ((1 + weak_rules.PRIOR) * cast + 1))))
        accuracy = new
    for r, vote in zip(rows, votes, strict=True):
        words = re.findall(WORD, r[1] or "")
        seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        own = got[r[0]]
        assert own.p_good == pytest.approx(good(vote), rel=1e-6) and own.base_failed == failed and own.n_repeat_words == len(repeated)
        assert own.kept == (not failed and good(vote) >= weak_rules.KEEP_AT)
    assert {True, False} == {r.kept for r in got.values()}


def test_languages_are_those_of_all_segmentations(docs, rows, tmp_path):
    vocabulary = sorted({bytes([i]) for i in range(256)} | {b" the", b" of", b" h", b"ouse", b"er", b" der", b" und", b"ing", b" s", b"sch", b"iff", b"ship", b"wa", b"ter", b"ser"})
    path = tmp_path / "pieces"
    path.write_text("\n".join(f"{base64.b64encode(p).decode()} {i}" for i, p in enumerate(vocabulary)))
    got = {r.doc_id: r for r in language_id.predict_documents(docs, language_id.train(docs, str(path))).collect()}
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts, share = collections.defaultdict(collections.Counter), collections.Counter(r[2] for r in learned)
    for r in learned:
        counts[r[2]].update(b" " + w for w in r[1].lower().encode().split())
    pieces = language_id.fit(counts, vocabulary)
    langs = sorted(share)

    @functools.cache
    def chance(word, k):
        """The sum over all ways to cut the word into pieces."""
        if not word:
            return 1.0
        return sum(pieces[word[:e]][k] * chance(word[e:], k) for e in range(1, len(word) + 1) if word[:e] in pieces)

    for doc_id, text, *_ in rows:
        own = got[doc_id]
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        total = [math.log(share[g] / len(learned)) + sum(math.log(chance(b" " + w, k)) for w in text.lower().encode().split()) for k, g in enumerate(langs)]
        best = max(range(len(langs)), key=lambda k: total[k])
        assert own.lang_pred == langs[best] and own.score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), rel=1e-6)
        assert own.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_shards_are_those_of_a_plain_rebalance(docs, rows):
    got = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    slot = {r[0]: xxhash.xxh64(struct.pack("<q", r[0]), seed=42).intdigest() % 2**64 for r in rows}
    slot = {k: (v - 2**64 if v >= 2**63 else v) % sharding.N_SLOTS for k, v in slot.items()}
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    load = collections.Counter()
    for k, s in slot.items():
        load[s] += size[k]
    share, held, where, rest = sum(load.values()) * sharding.KEEP / sharding.N_SHARDS, [0] * sharding.N_SHARDS, {}, []
    for s in sorted(range(sharding.N_SLOTS), key=lambda s: (-load[s], s)):
        if held[s % sharding.N_SHARDS] + load[s] <= share:
            where[s] = s % sharding.N_SHARDS
            held[where[s]] += load[s]
        else:
            rest.append(s)
    for s in rest:
        where[s] = held.index(min(held))
        held[where[s]] += load[s]
    for r in rows:
        own = got[r[0]]
        assert (own.vslot, own["size"], own.text_crc32) == (slot[r[0]], size[r[0]], zlib.crc32((r[1] or "").encode())) and own.shard == where[slot[r[0]]]
    for shard in range(sharding.N_SHARDS):
        assert sorted(r.slot for r in got.values() if r.shard == shard) == list(range(sum(r.shard == shard for r in got.values())))
