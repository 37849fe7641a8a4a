"""Measured texts against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from folianta.operators import measure


def plain_wrap(text, most):
    """Word after word, each line measured anew."""
    fits = lambda t: sum(map(measure.sans, t.rstrip())) <= most
    words, at = [], 0
    while at < len(text) or not words:
        space = text.find(" ", at)
        end = len(text) if space < 0 else space + 1
        words.append(text[at:end])
        at = end
    lines, line = [], ""
    for word in words:
        if fits(line + word):
            line += word
            continue
        if line:
            lines.append(line.rstrip())
        while not fits(word):
            n = 1
            while n < len(word) and fits(word[: n + 1]):
                n += 1
            lines.append(word[:n])
            word = word[n:]
        line = word
    return [*lines, line.rstrip()]


def test_lines_equal_a_plain_fold():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices("iiWWmabc é漢" + " " * rng.randint(1, 5), k=rng.randint(0, 80)))
        most = rng.choice([0, 200, 600, 1500, 5000, 20_000])
        assert measure.wrap(text, measure.sans, most) == plain_wrap(text, most), (text, most)


def test_long_paragraphs_are_quick(spark):
    import time

    began = time.time()
    text = "word " * 200_000 + "W" * 100_000
    lines = measure.wrap(text, measure.sans, 20_000)
    assert time.time() - began < 10 and "".join(lines).replace(" ", "") == text.replace(" ", "")


def test_pages_hold_what_fits(spark):
    docs = spark.createDataFrame([(1, "a\tb\r\n" + "word " * 60 + "\fnext\rlast"), (2, ""), (None, "x")], "doc_id long, text string")
    got = measure.text_pages(docs, size=10.0, width=200.0, height=150.0, margin=20.0).orderBy("doc_id", "page", "line").collect()
    one = [r for r in got if r.doc_id == 1]
    assert one[0].text == "a    b" and (one[0].x, one[0].y) == (20.0, 120.0) and one[1].y == 107.5
    assert max(r.line for r in one) == 8 and [r.text for r in one if r.page == max(q.page for q in one)] == ["next", "last"]
    assert [(r.page, r.line, r.text) for r in got if r.doc_id != 1] == [(1, 1, "x"), (1, 1, "")]


def test_widths_and_rectangles(spark):
    row = spark.range(1).select(measure.text_width(F.lit("AV é")).alias("w"), measure.range_rect(F.array(*map(F.lit, (0.0, 1.0, -10.0, 0.0, 5.0, 7.0))), F.lit("iiWW"), F.lit(40.0), F.lit(2), F.lit(4)).alias("r"), measure.range_rect(F.array(*map(F.lit, (1.0, 0.0, 0.0, 10.0, 5.0, 7.0))), F.lit("iiWW"), F.lit(40.0), F.lit(2), F.lit(4), None).alias("e"), measure.range_rect(F.array(*map(F.lit, (1.0, 0.0, 0.0, 10.0, 5.0, 7.0))), F.lit(""), F.lit(40.0), F.lit(0), F.lit(0)).alias("n")).first()
    assert row.w == 667 * 2 + 278 + 556
    share = 40 * 444 / (444 + 2 * 944)
    assert [row.r.x0, row.r.y0, row.r.x1, row.r.y1] == pytest.approx([5 - 11, 7 + share - 3.5, 5 + 3, 7 + 40 + 3.5])
    assert [row.e.x0, row.e.y0, row.e.x1, row.e.y1] == pytest.approx([5 + 20 - 3.5, 7 - 3, 5 + 40 + 3.5, 7 + 11]) and row.n is None


def test_copied_runs_keep_their_shape(spark):
    runs = [(1, 0, 1, 10.0, "One", 12.0, "Serif"), (1, 1, 1, 10.4, " more", 12.25, ""), (1, 2, 1, 20.0, "two", 0.0, None), (1, 3, 1, 30.5, "three", 0.0, ""), (1, 4, 1, 60.0, "far <b>", 0.0, 'A";x'), (1, 5, 1, 50.0, "up", 0.0, ""), (1, 6, 2, 50.0, "page", 0.0, "")]
    got = measure.copied_html(spark.createDataFrame(runs, "doc_id long, seq int, page int, top double, text string, size double, family string").repartition(2)).collect()
    assert [r.html for r in got] == [
        '<p><span style="font-size:12pt;font-family:Serif">One</span><span style="font-size:12.3pt"> more</span><br>two<br>three</p>\n<p><span style="font-family:Ax">far &lt;b&gt;</span></p>\n<p>up</p>\n<p>page</p>'
    ]


def test_a_range_is_measured_once(spark):
    box = measure.range_rect(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))), F.col("t"), F.lit(50.0), F.lit(1), F.lit(3))
    df = spark.createDataFrame([("abcde",)], "t string").select(box.alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 3
