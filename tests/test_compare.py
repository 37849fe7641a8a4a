"""Alignment of pages against the full table of lengths."""

import random
import time

from folianta.operators import compare


def by_table(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_matches_are_those_of_the_table():
    rng = random.Random(2)
    for _ in range(600):
        x, y = (rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 30)) for _ in range(2))
        assert list(compare.common_rows(x, y)) == by_table(x, y)


def test_many_pages_take_seconds():
    rng = random.Random(2)
    x = [rng.randrange(10**9) for _ in range(20_000)]
    y = list(x)
    for _ in range(100):
        at = rng.randrange(len(y))
        y[at : at + rng.randint(0, 2)] = [rng.randrange(10**9) for _ in range(rng.randint(0, 2))]
    began = time.time()
    found = list(compare.common_rows(x, y))
    assert len(found) >= 20_000 - 300 and time.time() - began < 10
    began = time.time()
    assert len(list(compare.common_rows(["same"] * 3_000, ["same", "other"] * 1_500))) == 1_500
    assert time.time() - began < 10


def test_gaps_pair_up(spark):
    rows = lambda keys: spark.createDataFrame([("d", i + 1, k) for i, k in enumerate(keys)] or [], "doc_id string, page int, key string")
    got = compare.align(rows("abcde"), rows("axcyzef")).collect()
    assert [(r.before_page, r.after_page, r.status) for r in got] == [
        (1, 1, "unchanged"), (2, 2, "changed"), (3, 3, "unchanged"), (4, 4, "changed"), (None, 5, "added"), (5, 6, "unchanged"), (None, 7, "added"),
    ]
    assert [r.status for r in compare.align(rows("ab"), rows("")).collect()] == ["removed", "removed"]


def test_documents_are_paired_in_batches(spark):
    rows = lambda text, of: spark.createDataFrame([(of, i, c) for i, c in enumerate(text, 1)], "doc_id int, page int, key string")
    before = rows("abc", 1).unionByName(rows("xy", 2)).unionByName(rows("k", None))
    after = rows("bdc", 1).unionByName(rows("z", 3)).unionByName(rows("kl", None))
    out = compare.align(before, after)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(1, 1, None, "removed"), (1, 2, 1, "unchanged"), (1, None, 2, "added"), (1, 3, 3, "unchanged"), (2, 1, None, "removed"), (2, 2, None, "removed"), (3, None, 1, "added"), (None, 1, 1, "unchanged"), (None, None, 2, "added")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
