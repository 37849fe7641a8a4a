"""Forms within forms on small fixtures."""

import pytest

from folianta.operators import objects

ITEM = "doc_id long, stream string, seq int, kind string, ref string, matrix array<double>, x0 double, y0 double, x1 double, y1 double, text string"


def item(stream, seq, kind, ref=None, matrix=(1, 0, 0, 1, 0, 0), text=None, doc=1):
    return (doc, stream, seq, kind, ref, [float(v) for v in matrix], 0.0, 0.0, 1.0, 1.0, text)


def test_boxes_are_multiplied_on_the_way(spark):
    items = spark.createDataFrame([item("p", 0, "form", "f", (2, 0, 0, 2, 10, 0)), item("p", 1, "text", text="t"), item("f", 0, "image", "i", (0, 3, -3, 0, 5, 5)), item("f", 1, "form", "gone")], ITEM)
    got = {tuple(r.path): r for r in objects.placed(spark.createDataFrame([(1, 1, "p")], "doc_id long, page int, stream string"), items).collect()}
    assert got.keys() == {(0,), (1,), (0, 0), (0, 1)} and not any(r.cut for r in got.values())
    b = got[0, 0].box
    assert [b.x0, b.y0, b.x1, b.y1] == pytest.approx([10 + 2 * 2, 2 * 5, 10 + 2 * 5, 2 * 8])


def test_a_form_that_draws_itself_ends(spark):
    items = spark.createDataFrame([item("p", 0, "form", "p"), item("q", 0, "text", text="x", doc=2)], ITEM)
    got = objects.placed(spark.createDataFrame([(1, 1, "p"), (2, 1, "q")], "doc_id long, page int, stream string"), items, depth=3).collect()
    assert sorted(len(r.path) for r in got if r.doc_id == 1) == [1, 2, 3, 4] and all(r.cut == (r.doc_id == 1) for r in got)


def test_shared_images(spark):
    items = [item("a", 0, "image", "i"), item("a", 1, "image", "j"), item("a", 2, "image", "j"), item("b", 0, "form", "f"), item("f", 0, "image", "i"), item("b", 1, "image", "k"), item("b", 2, "text", text=""), item("b", 3, "image")]
    drawn = objects.placed(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id long, page int, stream string"), spark.createDataFrame(items, ITEM))
    got = {(r.page, r.seq): (r.ref, r.pixel_width, r.shared) for r in objects.inventory(drawn, spark.createDataFrame([(1, "i", 7, 8)], "doc_id long, ref string, width int, height int")).collect()}
    assert got == {(1, 0): ("i", 7, True), (1, 1): ("j", None, True), (1, 2): ("j", None, True), (2, 1): ("k", None, False), (2, 3): (None, None, False)}


def test_forms_are_followed_after_one_shuffle(spark, monkeypatch):
    """No join or table a level; a few drawings at a time give the same as many."""
    items = [item("p", i, "form", f"f{i % 3}", (1, 0, 0, 1, i, 0)) for i in range(6)] + [item(f"f{i}", j, "form", f"f{i + 1}", None or (2, 0, 0, 2, 0, j)) for i in range(3) for j in range(2)] + [item("f3", 7, "text", text="end")]
    frames = spark.createDataFrame([(1, 1, "p"), (1, 2, "f3"), (2, 1, "p")], "doc_id long, page int, stream string"), spark.createDataFrame(items, ITEM)
    drawn = objects.placed(*frames)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan
    got = sorted(tuple(r) for r in drawn.collect())
    assert len([r for r in got if r[5] == "end"]) == 2 * (8 + 4 + 2) + 1 and {r[0] for r in got} == {1}
    monkeypatch.setattr(objects, "AT_ONCE", 3)
    assert sorted(tuple(r) for r in objects.placed(*frames).collect()) == got
