"""Visible text runs against a plain walk with a stack."""

import math
import random

from folianta.operators import runs

SCHEMA = "doc_id long, page int, seq int, op string, nums array<double>, str string"


def times(a, b):
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def walk(ops):
    same = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    now, stack, text, out = {"c": same, "font": "", "size": 0.0, "fill": "#000000", "mode": 0}, [], same, []
    for doc, page, seq, op, nums, s in sorted(ops, key=lambda o: o[2]):
        whole = nums is not None and len(nums) == 6
        if op in ("save", "formBegin"):
            stack.append(dict(now))
        if op in ("transform", "formBegin") and whole:
            now["c"] = times(nums, now["c"])
        elif op in ("restore", "formEnd"):
            now = stack.pop() if stack else now
        elif op == "fill" and s is not None:
            now["fill"] = s
        elif op == "font":
            now["font"], now["size"] = s or "", abs(nums[0]) if nums else 0.0
        elif op == "render":
            now["mode"] = int(nums[0]) if nums else 0
        elif op == "beginText":
            text = same
        elif op == "textMatrix" and whole:
            text = nums
        elif op in runs.SHOWS and now["mode"] != 3 and now["font"] and (s or "").strip():
            m = times(text, now["c"])
            size = math.floor(now["size"] * math.hypot(m[2], m[3]) * 2 + 0.5) / 2
            if size > 0:
                out.append((doc, page, seq, s, now["font"], size, now["fill"], m[4], m[5]))
    return out


def near(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def test_runs_equal_a_walk_with_a_stack(spark):
    rng, pages = random.Random(11), []
    for doc in range(25):
        ops = []
        for seq in range(rng.randint(1, 120)):
            op = rng.choice(["save", "save", "restore", "restore", "formBegin", "formEnd", "transform", "fill", "font", "font", "render", "beginText", "textMatrix", "showText", "showSpacedText", "nextLineShowText", "odd", None])
            nums = [rng.choice([1.0, -0.5, 2.0, 0.0, 0.7]) for _ in range(6)] if op in ("transform", "textMatrix", "formBegin") else [float(rng.randint(-9, 12))] if op == "font" else [float(rng.choice([0, 0, 0, 1, 3]))] if op == "render" else None
            if rng.random() < 0.1:
                nums = rng.choice([None, []])
            s = rng.choice(["F1", "F2", "", None]) if op == "font" else rng.choice(["#ff0000", "#00ff00", None]) if op == "fill" else rng.choice(["text", " ", "é x", None])
            ops.append((doc, 1 + doc % 2, seq, op, nums, s))
        pages.append(ops)
    df = spark.createDataFrame([o for ops in pages for o in ops], SCHEMA).repartition(3)
    got = near(tuple(r) for r in runs.visible_runs(df).collect())
    assert got == near(r for ops in pages for r in walk(ops)) and len(got) > 30
    assert runs.visible_runs(df.limit(0)).count() == 0


def test_deep_frames_hand_their_state_on(spark):
    ops = [(1, 1, 0, "font", [10.0], "F")]
    ops += [(1, 1, i, "save" if i % 2 else "transform", [1.0, 0.0, 0.0, 1.0, 1.0, 0.0], None) for i in range(1, 41)]
    ops += [(1, 1, 50, "showText", None, "in"), *((1, 1, 51 + i, "restore", None, None) for i in range(25)), (1, 1, 90, "showText", None, "out")]
    got = sorted(tuple(r)[2:] for r in runs.visible_runs(spark.createDataFrame(ops, SCHEMA)).collect())
    assert got == [(50, "in", "F", 10.0, "#000000", 20.0, 0.0), (90, "out", "F", 10.0, "#000000", 0.0, 0.0)]


def test_pages_are_sorted_once_and_walked(spark):
    """One shuffle and no table a level, also for pages whose rows lie in several batches."""
    ops = [(1, 1, i, "save", None, None) for i in range(6_000)] + [(1, 1, 6_000, "font", [10.0], "F")] + [(1, 1, 6_001 + i, "showText" if i % 2 else "other", None, "x") for i in range(6_000)] + [(1, 2, 0, "showText", None, "no font")]
    found = runs.visible_runs(spark.createDataFrame(ops, SCHEMA))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert found.count() == 3_000
