"""The ten operators on awkward rows and against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folianta.llm import blockwise, components, context_mixing, doubling, language_id, line_crf, minhash, mixing, sharding, suffix_dedup, tiling, weak_rules
from folianta.sources import versions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, shard string, votes string, _row string, taken int, held_out string"
WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", "v", "r", 5, "h")


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows and ids, many scripts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    out = [row(0, None), row(1, ""), row(2, " \n\t "), row(3, "one"), row(4, "One"), row(5, "a b c d"), row(None, "without an id " + passage), row(None, None)]
    base = [prose(rng.randint(20, 120)) for _ in range(12)]
    for i, t in enumerate(base):
        out.append(row(10 + i, t, source=rng.choice(["s1", "s2", None, ""])))
    for i in range(6):
        w = base[0].split()
        w[rng.randrange(len(w))] = "edited"
        out.append(row(100 + i, " ".join(w), source="s1"))
    out += [row(200, base[1]), row(201, base[1]), row(201, base[1]), row(201, base[2])]
    out += [row(300 + i, prose(15) + "\n" + passage + ".\n" + prose(15), source="hot") for i in range(8)]
    out += [row(400, ("é ñ ü 漢字 😀 " * 40).strip(), lang=None), row(401, "\x00 \x1f nul"), row(402, "spam " * 3000), row(403, base[3] + " " + prose(30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(d):
    return float("inf") if d is None else d


def test_suffix_dedup_is_exact(docs, rows, empty):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], order(d))
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.repeated_bytes(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 3000
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_suffix_classes_follow_bytes():
    import numpy as np

    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=60)) for _ in range(40)]
    strings += [s[:55] + b"zzzzz" for s in strings]
    text = np.frombuffer(b"".join(strings), np.uint8)
    place = np.concatenate([np.arange(60) - 20 for _ in strings])
    starts = np.concatenate([np.arange(11) + 60 * i for i in range(len(strings))])
    got = suffix_dedup.suffix_classes(text, starts, place)
    by = collections.defaultdict(set)
    for s, c in zip(starts, got, strict=True):
        by[int(c)].add((int(place[s]), text[s : s + 50].tobytes()))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({next(iter(v)) for v in by.values()})


def test_doubling_is_exact(docs, rows, empty):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), order(d))
    want = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order(d):
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in doubling.repeated_words(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 400
    assert doubling.repeated_words(empty).count() == 0


def test_levels_double_until_the_width():
    assert [doubling.levels(w) for w in (13, 4, 3, 8, 50)] == [[4, 8, 13], [4], [3], [4, 8], [4, 8, 16, 32, 50]]


@pytest.mark.parametrize("width", [1, 3, 4, 7, 30])
def test_doubling_at_other_widths(spark, width):
    """Also where only short runs repeat, so that no candidate survives the first levels."""
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(10)]
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    want = {}
    for d, t in rows:
        w = t.split()
        want[d] = len({k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for k in range(i, i + width)})
    got = doubling.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and sum(want.values()) > 100


def test_blocks_of_any_size_give_the_same(spark, docs, monkeypatch):
    want = sorted(map(tuple, doubling.repeated_words(docs).collect()), key=repr)
    monkeypatch.setattr(blockwise.document_blocks, "__defaults__", (3000,))
    assert sorted(map(tuple, doubling.repeated_words(docs).collect()), key=repr) == want


def test_sharding_law_places_and_growth(spark, docs, rows, empty, tmp_path):
    placed = sharding.shard_documents(docs, n_shards=4, n_slots=64).collect()
    assert len(placed) == len(rows)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in placed if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    for s in {r.shard for r in placed}:
        mine = sorted(r.slot for r in placed if r.shard == s)
        assert mine == list(range(len(mine)))
    plain = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    loads = sharding.slot_loads(plain, 512)
    v0 = sharding.first_map(spark, 8, 512)
    v1 = sharding.rebalance(v0, loads, 8)
    sums = v1.join(loads, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.min("b"), F.max("b"), F.count("b")).first()
    assert sums[2] == 8 and sums[1] - sums[0] < 0.01 * sums[1]
    moved = v1.join(v0.withColumnRenamed("shard", "old"), "vslot").where("shard <> old").count()
    assert moved < 256
    sharding.save_map(v0, str(tmp_path / "m"))
    sharding.save_map(v1, str(tmp_path / "m"))
    with pytest.raises(versions.Conflict):
        sharding.save_map(v1, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="one shard"):
        sharding.save_map(v1.withColumn("version", F.lit(2)).withColumn("shard", F.when(F.col("vslot") > 0, F.col("shard"))), str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m")) == ["version=0", "version=1"]
    assert sharding.load_map(spark, str(tmp_path / "m")).first().version == 1 and sharding.load_map(spark, str(tmp_path / "m"), 0).count() == 512
    assert sharding.shard_documents(empty).count() == 0
    first = sharding.shard_documents(plain, 8, 512, str(tmp_path / "kept")).select("doc_id", "shard", "map_version").collect()
    again = sharding.shard_documents(plain, 8, 512, str(tmp_path / "kept")).select("doc_id", "shard", "map_version").collect()
    assert {r.map_version for r in first} == {1} and {r.map_version for r in again} == {2}
    assert len({tuple(r[:2]) for r in first} & {tuple(r[:2]) for r in again}) > 0.8 * len(first)
    want = {r.vslot: r.shard for r in v1.collect()}
    slot = {r.doc_id: r.v for r in plain.select("doc_id", sharding.virtual_slot(F.col("doc_id"), F.col("text"), 512).alias("v")).collect()}
    assert all(r.shard == want[slot[r.doc_id]] for r in first)
    grown = sharding.rebalance(v1, loads, 9)
    assert grown.select("shard").distinct().count() == 9


def fill(sizes, weights, budget, epochs):
    """Clamping and resharing in rounds."""
    left, target = dict(sizes), {}
    while True:
        rest = budget - sum(target.values())
        total = sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * rest / total > epochs * sizes[s]] if left else []
        if not over:
            return target | {s: weights[s] * rest / total for s in left}
        for s in over:
            target[s] = float(epochs * sizes[s])
            del left[s]


def test_mixing_targets_and_repetitions(docs, rows, empty):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows) and mixing.mix_sizes(empty).count() == 0
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(WORD, r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    by_size = {sizes[s]: want[s] for s in names}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - by_size[r.source_size]) < 1e-6
        taken[r.source_size] += r.taken
    assert all(taken[n] == int(t + 0.5) for n, t in by_size.items())
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    assert {(r["size"], r.kept, r.shard, r.taken, r._row) for r in mixed.collect()} == {("x", "y", "z", 5, "r")}
    clash = docs.select("doc_id", "text", "source", *(F.lit(f"own {c}").alias(c) for c in ("_key", "_source", "_range", "_start", "_before", "size", "row", "nth", "due", "edge", "part", "whole", "taken")))
    out = mixing.mix_rows(clash)
    assert out.columns == clash.columns and all(v == f"own {c}" for c, v in out.drop("doc_id", "text", "source").distinct().first().asDict().items())
    assert sum(len(re.findall(WORD, r.text)) for r in mixed.collect()) == sum(taken.values())


def test_tiling_finds_reordered_passages(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = [(1, f"before {item.upper()}, after"), (2, " ".join(w[10:]) + ". And then: " + " ".join(w[:10])), (3, " ".join(w[:6]) + " something else"), (4, "nothing"), (5, None), (6, " ".join(w[::-1]))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "few words"), (7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in tiling.contamination(d, b).collect()}
    assert [got[i].contaminated for i in range(1, 7)] == [True, True, False, False, False, False]
    assert got[2].coverage == 1.0 and got[3].n_covered == 6 and got[1].item_id == 7 and got[1].n_items == 2
    assert {r.doc_id for r in tiling.clean_rows(d, b).collect()} == {3, 4, 5, 6}
    assert tiling.contamination(empty, b).count() == 0 and tiling.contamination(docs, b.limit(0)).where("contaminated").count() == 0
    assert tiling.clean_rows(docs, b).columns == docs.columns


def test_slices_of_a_benchmark_give_the_same(spark, docs, rows, monkeypatch):
    texts = [r[1] for r in rows if r[1]]
    items = spark.createDataFrame([(i, t[: 40 + 30 * i]) for i, t in enumerate(texts[:40])], "item_id long, text string")
    want, kept = (sorted(map(tuple, f(docs, items).collect()), key=repr) for f in (tiling.contamination, tiling.clean_rows))
    monkeypatch.setattr(tiling, "SLICE_BYTES", 6000)
    assert tiling._n_slices(items) > 2
    assert sorted(map(tuple, tiling.contamination(docs, items).collect()), key=repr) == want and any(w[-1] for w in want)
    assert sorted(map(tuple, tiling.clean_rows(docs, items).collect()), key=repr) == kept


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(200):
        p, t = [rng.randrange(3) for _ in range(rng.randint(0, 25))], [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        found = tiling.tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in found)
        for k in (0, 1):
            used = [x for f in found for x in range(f[k], f[k] + f[2])]
            assert len(used) == len(set(used))
        free_p = [x if not any(i <= a < i + n for i, _, n in found) else None for a, x in enumerate(p)]
        free_t = {tuple(t[j : j + 3]) for j in range(len(t) - 2) if not any(b <= y < b + n for _, b, n in found for y in (j, j + 1, j + 2))}
        assert not any(tuple(free_p[a : a + 3]) in free_t for a in range(len(p) - 2) if None not in free_p[a : a + 3])


def test_minhash_components_are_exact(docs, rows, empty):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(WORD, lower(t or ""))
        sets.append(frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = [(r[0], len(sets[i]), least.get(root(i), r[0]) if sets[i] else r[0]) for i, r in enumerate(rows)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.deduplicate(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (100, 101, 200)").count() == 0 and kept.where("doc_id = 10").count() == 1
    assert minhash.deduplicate(empty).count() == 0


def test_rare_pairs_lose_none(spark):
    from folianta.llm.shared import Tables

    rng = random.Random(4)
    base = [rng.randrange(-(10**9), 10**9) for _ in range(60)]
    made = [sorted(set(base) - set(rng.sample(base, rng.randint(0, 20))) | {rng.randrange(10**9) for _ in range(rng.randint(0, 12))}) for _ in range(40)]
    made += [rng.sample(base, n) for n in (1, 2, 3, 30, 40, 50, 58)]
    sets = spark.createDataFrame(list(enumerate(made)), "cls long, shingles array<long>")
    members = spark.createDataFrame([(i, -(i // 2)) for i in range(len(made))], "cls long, root long")
    got = {frozenset((r.a, r.b)) for r in minhash._rare_pairs(members, sets, Tables(spark)).collect()}
    n = 0
    for i in range(len(made)):
        for j in range(i + 1, len(made)):
            a, b = set(made[i]), set(made[j])
            if 100 * len(a & b) >= 75 * len(a | b) and i // 2 != j // 2:
                assert frozenset((i, j)) in got
                n += 1
    assert n > 50 and all(min(p) // 2 != max(p) // 2 for p in got)


def test_estimate_counts_equal_low_bits(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, (20, minhash.LONGS))
    y = np.where(rng.random((20, minhash.LONGS)) < 0.5, x, x ^ rng.integers(0, 2**63 - 1, (20, minhash.LONGS)) & rng.integers(-(2**63), 2**63 - 1, (20, minhash.LONGS)))
    names = [[f"{s}{i}" for i in range(minhash.LONGS)] for s in "xy"]
    d = spark.createDataFrame([tuple(map(int, (*a, *b))) for a, b in zip(x, y, strict=True)], ", ".join(f"{n} long" for n in names[0] + names[1]))
    got = d.select(minhash.estimate(*([F.col(n) for n in side] for side in names)).alias("e")).collect()
    for r, a, b in zip(got, x.tolist(), y.tolist(), strict=True):
        same = sum(((p ^ q) >> (4 * i)) & 15 == 0 for p, q in zip(a, b, strict=True) for i in range(16))
        assert abs(r.e - (same / minhash.N_MINIMA - 1 / 16) / (15 / 16)) < 1e-12


def test_ways_up_end_at_the_roots(spark):
    from folianta.llm.shared import Tables

    rng = random.Random(11)
    edges = [(i + rng.randint(1, 9), i, 0) for i in range(0, 300) for _ in range(2)] + [(i + 1, i, 0) for i in range(500, 560)]
    edges = [(a, b, a) for a, b, _ in edges if b % 37]
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b, _ in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in components.forest_roots(spark.createDataFrame(edges, "a long, b long, weight long"), Tables(spark)).collect()}
    nodes = {x for e in edges for x in e[:2]}
    assert len({find(x) for x in nodes}) == len({got.get(x, x) for x in nodes}) == len({(find(x), got.get(x, x)) for x in nodes})


def test_one_doc_id_with_two_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    made = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(2)), (4, text(4)), (4, text(4)), (4, text(5)), (None, text(6)), (9, text(6)), (None, text(7)), (None, text(7) + " end"), (5, ""), (5, None), (5, text(8))]
    d = spark.createDataFrame(made, "doc_id long, text string")
    kept = sorted((tuple(r) for r in minhash.keep_first(d).collect()), key=repr)
    want = [(1, text(1)), (2, text(2)), (4, text(4)), (4, text(5)), (None, text(6)), (9, text(6)), (None, text(7)), (None, text(7) + " end"), (5, text(8))]
    assert [k for k in kept if k[1]] == sorted(want, key=repr) and len(kept) == len(want) + 1
    assert minhash.link(d)[1].groupBy("root").count().where("count = 2").count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, 51: 50}
    assert components.components(edges.limit(0)).count() == 0


def test_line_crf_learns_and_scores_everything(spark, docs, empty):
    rng = random.Random(5)
    good = lambda: "\n".join(" ".join(rng.choices(["the", "river", "runs", "slowly", "to", "sea", "and", "home"], k=12)) + "." for _ in range(4))
    bad = lambda: "\n".join("BUY!! NOW!! $$$ " * 6 for _ in range(4))
    made = [(i, good() if i % 2 else bad()) for i in range(300)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in made] + [(9999, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = line_crf.train(d, labels)
    out = line_crf.score_documents(d, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out if r.held_out) and any(r.held_out for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    every = line_crf.score_documents(docs, model)
    assert every.count() == docs.count() and every.where("score is null or score < 0 or score > 1").count() == 0
    assert line_crf.score_documents(empty, model).count() == 0
    none = line_crf.score_documents(d, line_crf.train(d, labels.limit(0))).first()
    assert 0 <= none.score <= 1


def test_crf_marginals_sum_over_all_labelings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 1, 1])
    p, pair, logz = line_crf.marginals(emit, move, doc)
    want, total = np.zeros((5, 2)), 0.0
    for first, n in ((0, 3), (3, 2)):
        z = 0.0
        part = np.zeros((n, 2))
        for ys in itertools.product((0, 1), repeat=n):
            s = math.exp(sum(emit[first + i, y] for i, y in enumerate(ys)) + sum(move[a, b] for a, b in itertools.pairwise(ys)))
            z += s
            for i, y in enumerate(ys):
                part[i, y] += s
        want[first : first + n] = part / z
        total += math.log(z)
    assert np.allclose(p, want) and abs(logz - total) < 1e-9 and abs(pair.sum() - 3) < 1e-9


def test_language_id(spark, docs, empty):
    if not os.path.exists(language_id.VOCABULARY):
        pytest.skip("no vocabulary")
    rng = random.Random(6)
    lists = {"en": "the of and river water running slowly under bridges".split(), "de": "der die und fluss wasser langsam unter brücken fließt".split()}
    made = [(i, " ".join(rng.choices(lists[lang], k=25)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    d = spark.createDataFrame([*made, (900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict_documents(d, language_id.train(d)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in made)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    model = language_id.train(docs)
    assert language_id.predict_documents(docs, model).count() == docs.count()
    assert language_id.predict_documents(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict_documents(d, language_id.train(empty)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    rng = random.Random(7)
    pieces = {bytes([c]): (0.01, 0.02) for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 4))): (rng.random() / 9, rng.random() / 9) for _ in range(15)}
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(50)] + [b"abc" * 400]
    got = language_id.Trie(pieces, 2).forward(words)

    def total(w, k):
        a = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            a[e] = sum(a[s] * pieces[w[s:e]][k] for s in range(e) if w[s:e] in pieces)
        return math.log(a[-1])

    assert all(abs(g[k] - total(w, k)) < 1e-6 for w, g in zip(words[:-1], got, strict=False) for k in (0, 1))
    assert all(math.isfinite(x) and x < -700 for x in got[-1])


def test_weak_rules_counts_and_verdicts(docs, rows, empty):
    got = weak_rules.judged(docs).collect()
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(grams)
        marked = {k + i for k, g in enumerate(grams) if n[g] > 1 for i in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert all(not (r.kept and r.base_failed) for r in got)
    kept = weak_rules.keep_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert weak_rules.judged(empty).count() == 0 and weak_rules.keep_rows(empty).count() == 0


def test_one_false_alarm_does_not_reject(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    lines = lambda n, w=word: "\n".join(" ".join(w() for _ in range(10)) + "." for _ in range(n))
    prose = [lines(8) for _ in range(150)]
    junk = [lines(8, lambda: word() + rng.choice(["###", "$$$", "%%%", "&&&"])) for _ in range(20)]
    notice = lines(1) + "\n" + "\n".join(["Open from nine to five."] * 8) + "\n" + lines(8)
    capitals = lines(8).upper()
    made = [(i, t) for i, t in enumerate([*prose, *junk, notice, capitals])]
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r for r in weak_rules.judged(d).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 170))
    assert [got[i].votes[: len(weak_rules.DETECTORS)].count("0") for i in (170, 171)] == [1, 1] and not got[170].base_failed
    assert got[170].kept and got[171].kept
    assert {r.doc_id for r in weak_rules.keep_rows(d).collect()} == {i for i, r in got.items() if r.kept}


def test_signs_vote_whatever_detectors_say():
    text = "These words stand in capitals and in plain lines. " * 2 + "\n" + " ".join(f"Word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)) + ". Fin.\u3002"
    (votes,) = weak_rules.measure(pa.array([text.upper()]))["votes"]
    assert votes[list(weak_rules.DETECTORS).index("capitals")] == "0" and votes[-1] == "2"
    assert votes[len(weak_rules.DETECTORS) : -1] == "11111"


def test_label_model_trusts_rules_that_agree():
    n = len(weak_rules.RULES)
    ordinary, junk = "2" * (n - 1) + "1", "00" + "2" * (n - 2)
    accuracy = weak_rules.fit([(ordinary, 900), (junk, 100)])
    assert (accuracy >= 0.5).all() and accuracy[0] > weak_rules.START
    import numpy as np

    p = weak_rules.posterior(np.array([[int(c) for c in ordinary], [int(c) for c in junk]]), accuracy)
    assert p[0] > 0.5 > p[1]


def test_context_mixing_counts_and_distribution(docs, rows, empty):
    out = context_mixing.score_documents(docs, 5).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tokens = [(r[0], [w.encode() for w in re.findall(WORD, lower(r[1] or ""))] + [b""]) for r in rows]
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in tokens), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == want
    assert all(r.score < 0 for r in out)
    assert context_mixing.score_documents(empty, 5).count() == 0


def test_order_of_words_tells(spark):
    rng = random.Random(10)
    names = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    after = {w: rng.sample(names, 3) for w in names}

    def run(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain = [(i, run(60)) for i in range(300) if not held(i)]
    ids = [i for i in range(1000, 1400) if held(i)][:20]
    tests = {i: run(60) for i in ids[:10]}
    mixed = dict(zip(ids[10:], (rng.sample(t, len(t)) for t in tests.values()), strict=True))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in [*plain, *tests.items(), *mixed.items()]], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in context_mixing.score_documents(d, 5).collect()}
    assert all(got[a] > got[b] + 15 for a, b in zip(ids[:10], ids[10:], strict=True))


def test_equal_texts_have_equal_scores(spark):
    """Whether they were learned from or not; every text once under an id of either kind."""
    rng = random.Random(9)
    out = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    learned = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 10][: len(out)]
    texts = [" ".join(rng.choices(["to", "be", "or", "not", "question", "Nobler", "mind"], k=rng.randint(1, 60))) for _ in out]
    docs = spark.createDataFrame([*zip(out, texts, strict=True), *zip(learned, texts, strict=True)], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.score_documents(docs).collect()}
    for a, b in zip(out, learned, strict=True):
        assert got[a].held_out and not got[b].held_out
        assert got[a].score == pytest.approx(got[b].score, rel=1e-12) and got[a].base_score == pytest.approx(got[b].base_score, rel=1e-12)


def test_very_long_words_have_finite_scores(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghijklmnop", k=20_000))
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    docs = spark.createDataFrame([(out[0], "to be " + long), (out[1], long + long), (1000, "to be or not"), (1001, "to be " * 40), (1002, "b" + long)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_mixing.score_documents(docs).collect()}
    assert all(math.isfinite(v) and v < 0 for v in got.values()) and got[out[1]] < got[out[0]] < -300 < got[1000]


def test_pair_counts_are_exact():
    import numpy as np

    keys = [b"0", b"0a", b"0b", b"1", b"1a", b"1b"]
    tokens, sizes = np.array([1, 2, 1, 2, 0, 4, 5, 3, 0], np.uint32), np.array([5, 3, 1])
    other = [b"5zz", b"5", b"5b", b"5a"]
    same = dict(zip(keys + other, context_mixing.key_hashes(keys).tolist() + context_mixing.key_hashes(other).tolist(), strict=True))
    assert [same[b"5" + w] for w in (b"", b"a", b"b")] == [same[b"0" + w] for w in (b"", b"a", b"b")] == [same[b"1" + w] for w in (b"", b"a", b"b")]
    pairs, of, before = context_mixing.word_pairs(tokens, sizes, context_mixing.key_hashes(keys))
    assert before.tolist() == [0, 1, 2, 1, 2, 3, 4, 5, 0] and (np.diff(pairs.astype(np.int64)) >= 0).all()
    seen = collections.Counter((keys[a][1:], keys[b][1:]) for a, b in zip(before, tokens, strict=True))
    total = collections.Counter(pairs[of].tolist())
    assert all(total[int(pairs[o])] == seen[keys[a][1:], keys[b][1:]] for o, a, b in zip(of, before, tokens, strict=True)) and len(total) == len(seen)


def test_codes_are_complete_and_decisions_follow_them():
    import numpy as np

    coder = context_mixing.Coder(np.arange(256.0))
    assert abs((0.5 ** coder.length.astype(float)).sum() - 1) < 1e-9
    paths = {tuple(zip(coder.nodes[b, :n].tolist(), coder.bits[b, :n].tolist(), strict=True)) for b, n in enumerate(coder.length)}
    assert len(paths) == 256
    sides = collections.Counter(step for path in paths for step in set(path))
    assert {(node, 1 - bit) for node, bit in sides} == set(sides)
    model = context_mixing.Model(coder, np.zeros((context_mixing.ORDERS, 1 << context_mixing.TABLE_BITS, 2), np.float32), context_mixing.Mixer())
    assert abs(sum(10 ** model.score([b"3"])[0] for _ in range(1)) - 0.5 ** int(coder.length[32])) < 1e-6


def test_tasks_read_arrow_slices():
    from folianta.llm import textcore as tc

    column = pa.array(["skip", "a bb", None, "ccc"])[1:]
    (a, b, data, offs), *rest = tc.parts(column)
    assert (a, b, not rest) == (0, 3, True) and data.tobytes() == b"a bbccc" and offs.tolist() == [0, 4, 4, 7]
    starts, ends, doc = tc.words(data, offs)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [b"a", b"bb", b"ccc"] and doc.tolist() == [0, 0, 2]


def test_scores_agree_on_reruns(spark, rows):
    made = [r[:2] for r in rows]
    runs = []
    for n in (3, 5):
        random.Random(n).shuffle(made)
        d = spark.createDataFrame(made, "doc_id long, text string").repartition(n)
        runs.append(sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in context_mixing.score_documents(d, 5).collect()), key=repr))
    assert runs[0] == runs[1]


def test_expected_pieces_of_whole_words():
    rng = random.Random(12)
    pieces = {bytes([c]): 0.02 for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 20))): rng.random() / 20 for _ in range(30)}
    words = {bytes(rng.choices(b"abc", k=n)): n for n in (1, 5, 30, 64)}
    plain, logs = language_id.expected(words, pieces), {}
    for w, c in words.items():
        language_id._expected_in_logs(w, c, pieces, 20, logs)
    assert plain.keys() == logs.keys() and all(abs(plain[p] - logs[p]) < 1e-9 * max(1, plain[p]) for p in plain)
    long = b"abc" * 3000
    got = language_id.expected({long: 2}, pieces)
    assert abs(sum(len(p) * x for p, x in got.items()) - 2 * len(long)) < 1e-4


def test_every_language_is_learned(spark):
    if not os.path.exists(language_id.VOCABULARY):
        pytest.skip("no vocabulary")
    names = [f"l{i:02d}" for i in range(70)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    made = [(1000 * k + j, " ".join(f"q{k}z{k}x" for _ in range(6)), n) for k, n in enumerate(names) for j in range(4)]
    made += [(500_000, "q69z69x q69z69x", None)]
    d = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict_documents(d, language_id.train(d)).collect()}
    learned = {n for i, _, n in made if n and not held(i)}
    assert all(got[i] == n for i, _, n in made if n in learned) and len(learned) > 64


def covered_by_longest(item, text, least):
    """Tokens of the item in tiles, by looking for the longest common run of unmarked tokens again and again."""
    p, t, n = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] is not None and p[i + k] == t[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return n
        p[i : i + k], t[j : j + k] = [None] * k, [""] * k
        n += k


def test_contamination_agrees_with_all_pairs(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words[:12] if i % 3 == 0 else words, k=rng.randint(3, 40)))) for i in range(12)]
    texts = []
    for d in range(40):
        parts = [rng.choices(words, k=rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += [w[a : a + rng.randint(3, 25)], rng.choices(words, k=rng.randint(0, 6))]
        texts.append((d, " ".join(x for p in parts for x in p)))
    got = {r.doc_id: r for r in tiling.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in texts:
        n = {i: covered_by_longest(item.split(), text.split(), tiling.MIN_TILE) for i, item in items}
        share = {i: n[i] / len(item.split()) for i, item in items if n[i]}
        best = min(share, key=lambda i: (-share[i], i)) if share else None
        assert (got[d].item_id, got[d].n_items) == (best, sum(s >= tiling.COVERAGE for s in share.values())), d
        assert got[d].n_covered == (n[best] if share else 0)
    assert any(r.contaminated for r in got.values()) and not all(r.contaminated for r in got.values())


def test_a_phrase_in_thousands_of_items_takes_one_look(spark):
    import time

    rng = random.Random(1)
    item = lambda: "one shared phrase of five " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    made = tiling.Slice([(i, item()) for i in range(4_000)])
    began = time.time()
    assert made.best(pa.array(["hello one shared phrase of five there"] * 50)) == [(0, 0.2, 5, 0)] * 50
    assert time.time() - began < 1


def test_bounds_change_no_result():
    """The most covered item and the number of those at the threshold, against tiling with every item."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    for _ in range(60):
        items = [(rng.randrange(50), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(rng.randint(1, 12))]
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(4)] + [" x ".join(t for _, t in rng.sample(items, min(2, len(items))))]
        made = tiling.Slice(sorted(items))
        for text, got in zip(texts, made.best(pa.array(texts)), strict=True):
            seq = [int(x) for x in tiling.tokens(*tiling.tc.buffers(pa.array([text])))[0]]
            best = (None, 0.0, 0, 0)
            for i, own in zip(made.ids, made.items, strict=True):
                own_seeds = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
                starts = [j for j in range(len(seq) - 4) if tuple(seq[j : j + 5]) in own_seeds]
                if starts:
                    n = sum(t[2] for t in tiling.tiles(own, tiling.Slice._parts(seq, starts)))
                    share = n / len(own)
                    first = best[0] is None or share > best[1] or (share == best[1] and i < best[0])
                    best = (*((i, share, n) if first else best[:3]), best[3] + (share >= tiling.COVERAGE))
            assert got == best


def test_repeats_take_no_cubic_time():
    import time

    began = time.time()
    assert tiling.tiles([7] * 300, [7] * 3000) == [(0, 0, 300)]
    assert time.time() - began < 20
