import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folianta.functions import geometry as geo
from folianta.operators import audit, comments, compare, exports, forms, layout, pages, trees
from folianta.plans.pipeline import Pipeline, Step
from folianta.sources import exchange


def test_review_states_by_time_and_by_order(spark):
    rows = [(1, 1, "a", None, None, None), (1, 2, "b", "a", "accepted", "2024-01-02"), (1, 3, "c", "a", "rejected", "2024-01-01"), (1, 4, "d", "gone", None, None)]
    c = spark.createDataFrame(rows, "doc_id long, seq int, id string, reply_to string, review_state string, modified string").withColumn("modified", F.to_timestamp("modified"))
    t = {r.id: (r.is_root, r.replies, r.status) for r in comments.threads(c).collect()}
    assert t == {"a": (True, 2, "rejected"), "b": (False, 0, None), "c": (False, 0, None), "d": (True, 0, None)}
    assert comments.latest_state(c).first().state == "accepted"


def test_threads_of_any_depth(spark):
    rows = [(1, i, str(i), None if i == 0 else str(i - 1)) for i in range(13)] + [(2, 1, "a", "b"), (2, 2, "b", "a")]
    c = spark.createDataFrame(rows, "doc_id long, seq int, id string, reply_to string")
    got = comments.flat_threads(c).orderBy("path").collect()
    assert [(r.seq, r.depth) for r in got] == [(i, i) for i in range(13)] and got[-1].path.count("/") == 12
    assert comments.flat_threads(c, 3).count() == 4


def test_page_labels_and_selection(spark):
    p = spark.createDataFrame([(1, i) for i in range(1, 6)], "doc_id long, page int")
    r = spark.createDataFrame([(1, 2, "roman-lower", "p", 1), (1, 4, "decimal", "", 7)], "doc_id long, start_page int, style string, prefix string, first_number int")
    assert [x.label for x in pages.labels_as_of(p, r).orderBy("page").collect()] == ["1", "pi", "pii", "7", "8"]
    one = spark.range(1).select(pages.selected_pages(F.lit("3-1, 9,2,zz,40"), F.lit(8)).alias("x")).first().x
    assert one == [1, 2, 3]
    assert pages.check_selection("2,4-5", 5) == [2, 4, 5]
    for bad in ("0", "4-9", "5-4", "x"):
        with pytest.raises(ValueError):
            pages.check_selection(bad, 5)


def test_booklet_pads_to_four(spark):
    rows = pages.booklet(spark.createDataFrame([(1, 5)], "doc_id long, pages int")).orderBy("sheet", F.desc("side")).collect()
    assert [(r.sheet, r.side, r.left_page, r.right_page) for r in rows] == [(1, "front", 0, 1), (1, "back", 2, 0), (2, "front", 0, 3), (2, "back", 4, 5)]


def test_mappings(spark):
    p = spark.createDataFrame([(1, i) for i in range(1, 5)], "doc_id long, page int")
    assert {r.page: r.new_page for r in pages.delete_mapping(p, p.where("page = 2")).collect()} == {1: 1, 3: 2, 4: 3}
    assert {r.page: r.new_page for r in pages.move_mapping(p, p.where("page = 4"), 2).collect()} == {1: 1, 4: 2, 2: 3, 3: 4}
    assert {r.page: r.new_page for r in pages.reverse_mapping(p).collect()} == {1: 4, 2: 3, 3: 2, 4: 1}


def test_forms(spark):
    f = spark.createDataFrame([("x", 1, "name", "text", "Ann", True, False), ("x", 2, "ok", "checkbox", "false", True, False), ("y", 3, "extra", "text", "e", False, False)], "file string, seq int, name string, type string, value string, required boolean, read_only boolean")
    wide = {r.file: r.asDict() for r in forms.merged(f).collect()}
    assert list(wide["x"]) == ["file", "name", "ok", "extra"] and wide["y"]["name"] == "" and wide["y"]["extra"] == "e"
    assert [r.name for r in forms.missing_required(f).collect()] == ["ok"]


def test_heading_tree_and_merge(spark):
    h = spark.createDataFrame([(1, s, lv) for s, lv in ((1, 1), (2, 2), (3, 3), (4, 2), (5, 1), (6, 3))], "doc_id long, seq int, level int")
    assert [r.parent_seq for r in trees.nearest_above(h).orderBy("seq").collect()] == [None, 1, 2, 1, None, 5]
    assert audit.heading_skips(h).first().skips == 1
    lines = spark.createDataFrame([(1, 1, 1, "A long", 20.0, 700.0), (1, 1, 2, "title", 20.0, 675.0), (1, 1, 3, "far", 20.0, 500.0)], "doc_id long, page int, seq int, text string, size double, y double")
    assert [r.text for r in layout.merge_wrapped(lines).orderBy("seq").collect()] == ["A long title", "far"]


def test_layout_and_paragraphs(spark):
    items = spark.createDataFrame([(1, 1, 1, "World", 90.0, 700.0, 10.0, 30.0), (1, 1, 2, "Hello", 54.0, 701.0, 10.0, 30.0), (1, 1, 3, "Cell", 300.0, 700.0, 10.0, 20.0), (1, 1, 4, "below", 54.0, 680.0, 10.0, 30.0)], "doc_id long, page int, seq int, str string, x double, y double, size double, width double")
    rows = layout.page_layout(items).orderBy("line").collect()
    assert [r.cells for r in rows] == [["Hello World", "Cell"], ["below"]]
    lines = spark.createDataFrame([(1, 1, 1, 700.0, 10.0, "a hyphen-"), (1, 1, 2, 685.0, 10.0, "ated line"), (1, 1, 3, 600.0, 17.0, "Big")], "doc_id long, page int, line int, y double, size double, text string")
    got = layout.paragraphs(lines).orderBy("line").collect()
    assert [(r.text, r.heading) for r in got] == [("a hyphen-ated line", 0), ("Big", 1)]


def test_alignment_golden(spark):
    make = lambda ks: spark.createDataFrame([(1, i + 1, k) for i, k in enumerate(ks)], "doc_id long, page int, key string")
    rows = compare.align(make("ABC"), make("AXBC")).orderBy("after_page").collect()
    assert [r.status for r in rows] == ["unchanged", "added", "unchanged", "unchanged"]
    with pytest.raises(Exception, match="more than 2"):
        compare.align(make("ABC"), make("ABC"), limit=2).collect()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_text_change_rebuilds_both_sides(spark, a, b):
    c = spark.createDataFrame([(a, b)], "a string, b string").select(compare.text_change(F.col("a"), F.col("b")).alias("c")).first().c
    assert c.prefix + c.removed + c.suffix == a and c.prefix + c.added + c.suffix == b
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert c.prefix == a[:n]


def test_cover_ups_need_paint_order(spark):
    g = spark.createDataFrame([(1, 1, 5.0, 5.0, 8.0, 8.0, o, t) for o, t in ((1, "a"), (9, "b"))], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, paint_order int, text string")
    f = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 5)], "doc_id long, page int, fill int, x0 double, y0 double, x1 double, y1 double, paint_order int")
    r = audit.cover_ups(g, f).first()
    assert (r.characters, r.sample) == (1, "a")


def test_redaction_is_checked_by_another_path(spark):
    p = spark.createDataFrame([(1, 1, "The Secret  Plan"), (1, 2, "SecretPlan")], "doc_id long, page int, text string")
    t = spark.createDataFrame([("secret plan",)], "term string")
    assert audit.residual_terms(p, t).first().pages == 2
    assert audit.residual_terms(audit.redact(p, ["secret"]), t).count() == 0


def test_images_are_seen_before_they_are_measured(spark):
    i = spark.createDataFrame([(1, 1, 1, "r", 2, 2), (1, 2, 1, "r", 50, 50), (1, 2, 2, "s", 50, 50)], "doc_id long, page int, seq int, ref string, width int, height int")
    assert [(r.page, r.ref, r.nth) for r in audit.first_images(i, 10).collect()] == [(2, "s", 1)]


def test_role_chains_and_cycles(spark):
    tags = spark.createDataFrame([(1, "x"), (1, "loop"), (1, "P")], "doc_id long, role string")
    roles = spark.createDataFrame([(1, "x", "y"), (1, "y", "H1"), (1, "loop", "pool"), (1, "pool", "loop")], "doc_id long, role string, to string")
    got = {r.role: r.standard_role for r in trees.role_of(tags, roles).collect()}
    assert got["x"] == "H1" and got["P"] == "P" and got["loop"] in ("loop", "pool")


def test_geometry(spark):
    m = F.array(*[F.lit(float(x)) for x in (2, 0, 0, 4, 1, 3)])
    inv = geo.matrix_invert(m)
    p = geo.matrix_apply(inv, F.lit(5.0), F.lit(11.0))
    assert tuple(spark.range(1).select(p.alias("p")).first().p) == (2.0, 2.0)
    d = spark.range(1).select(geo.segment_distance(*[F.lit(float(x)) for x in (0, 5, -1, 0, 1, 0)]).alias("d")).first().d
    assert d == 5.0
    r = spark.range(1).select(geo.overlaps(geo.rect(0, 0, 1, 1), geo.rect(1, 0, 2, 1)).alias("x")).first().x
    assert r is False


def test_exchange_errors_and_strict_mode(spark):
    files = spark.createDataFrame([(1, 3, "junk"), (2, 3, '{"format":"document-comments","version":1,"pages":3,"comments":[{"id":"a","page":1,"type":"Text","text":"t","rect":[0,0,1,1]},{"id":"a","page":1,"type":"Text","text":"t","rect":[0,0,1,1]}]}')], "doc_id long, pages int, body string")
    assert {(r.doc_id, r.error) for r in exchange.comments(files).collect()} == {(1, "not a comment exchange"), (2, "id used twice")}
    with pytest.raises(Exception, match="exchange"):
        exchange.comments(files, strict=True).collect()


def test_text_pages(spark):
    f = spark.createDataFrame([(1, "one\r\ntwo\fthree " + "word " * 30)], "doc_id long, text string")
    rows = exchange.text_pages(f, width=40, per_page=2).orderBy("page", "line").collect()
    assert [(r.page, r.line) for r in rows][:3] == [(1, 1), (1, 2), (2, 1)] and max(len(r.text) for r in rows) <= 40
    assert " ".join(r.text for r in rows if r.page > 1).split() == ["three", *["word"] * 30]


def test_pipeline_names_the_step_that_fails(spark):
    good = Pipeline.of(Step("one", lambda d: d.withColumn("a", F.lit(1)))).then("two", lambda d: d.withColumn("b", F.col("a") + 1))
    assert good.transform(spark.range(1)).first().b == 2
    with pytest.raises(RuntimeError, match="'bad'"):
        good.then("bad", lambda d: d.select("nope")).transform(spark.range(1))


def test_csv_files(spark, tmp_path):
    exports.write_csv(spark.createDataFrame([("=x", 'q"')], "a string, b string"), ["a", "b"], str(tmp_path / "o"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "o/rows").glob("part*"))
    assert text == b"'=x,\"q\"\"\"\r\n"


def test_streams_run_the_same_operators(spark, tmp_path):
    from folianta.streaming import pages as stream

    spark.createDataFrame([(1, 1, "river"), (2, 1, "lake")], "doc_id long, page int, text string").write.parquet(str(tmp_path / "in"))
    hits = stream.stream_matches(stream.read_pages(spark, str(tmp_path / "in")), "river")
    stream.write_batches(hits, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
