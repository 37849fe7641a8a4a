"""Trees of any depth, cycles, and the rules over structure, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from folianta.functions import text as tx
from folianta.operators import comments, exports, inventory, pages, search, structure, trees


def chain(spark, n):
    return spark.createDataFrame([(1, str(i), str(i - 1) if i else None, i) for i in range(n)], "doc_id long, id string, parent_id string, seq long")


def test_deep_chains_are_whole(spark):
    tree = chain(spark, 40)
    assert {r.id: r.depth for r in trees.levels(tree).collect()} == {str(i): i for i in range(40)}
    with pytest.raises(ValueError, match="32 levels"):
        trees.levels(tree, trees.OUTLINE_DEPTH)
    got = trees.filtered(tree, F.col("id") == "39").collect()
    assert len(got) == 40 and [r.id for r in got if r.is_hit] == ["39"]
    assert trees.ancestors(tree.where("seq < 9")).count() == 9 * 8 // 2


def test_cycles_are_errors_or_end(spark):
    tree = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "x", "z"), (1, "y", "x"), (1, "z", "y"), (1, "o", "gone")], "doc_id long, id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        trees.levels(tree)
    assert {r.id for r in trees.levels(tree.where("id in ('a', 'b', 'o')")).collect()} == {"a", "b"}
    assert {r.id for r in comments.with_ancestors(tree.where("id = 'y'"), tree).collect()} == {"x", "y", "z"}
    both = tree.where("id in ('x', 'y', 'z')").unionByName(tree.where("id in ('a', 'b')").withColumn("doc_id", F.lit(2).cast("long")))
    got = trees.ancestors(both, 8).collect()
    assert {r.distance for r in got if r.doc_id == 1} == set(range(1, 8)) and all(r.cut for r in got if r.doc_id == 1)
    assert [(r.id, r.ancestor, r.distance, r.cut) for r in got if r.doc_id == 2] == [("b", "a", 1, False)]


def test_one_bad_document_leaves_the_others(spark):
    two = spark.createDataFrame([(2, "a", None, 0), (2, "b", "a", 1)], "doc_id long, id string, parent_id string, seq long")
    loop = spark.createDataFrame([(3, "a", None, 0), (3, "x", "y", 1), (3, "y", "x", 2)], "doc_id long, id string, parent_id string, seq long")
    got = trees.levels(chain(spark, 60).unionByName(two).unionByName(loop), trees.OUTLINE_DEPTH, strict=False).collect()
    by = {d: [r for r in got if r.doc_id == d] for d in (1, 2, 3)}
    assert len(by[1]) == 33 and {r.error for r in by[1]} == {"more than 32 levels"}
    assert [(r.id, r.depth, r.error) for r in sorted(by[2])] == [("a", 0, None), ("b", 1, None)]
    assert [(r.id, r.error) for r in by[3]] == [("a", "nodes hang in a cycle")]
    deep = trees.ancestors(chain(spark, 40).unionByName(two), 16).collect()
    assert all(r.cut == (r.doc_id == 1) for r in deep) and max(r.distance for r in deep) == 15


def test_attachments_come_as_a_walk_meets_them(spark):
    nodes = spark.createDataFrame([(1, "top", None, 0), (1, "z", "top", 0), (1, "b", "top", 1), (1, "c", "c", 0), (1, "deep", "z", 5), (1, "first", "z", 2)], "doc_id long, id string, parent_id string, place int")
    names = spark.createDataFrame([(1, "b", 0, "last", 1), (1, "deep", 1, "", 2), (1, "deep", 0, "second", 3), (1, "first", 0, None, 4), (1, "z", 0, "not a leaf", 5), (1, "c", 0, "not met", 6)], "doc_id long, node string, seq int, name string, size int").withColumn("description", F.lit(""))
    got = structure.attachments(nodes, names).orderBy("nth").collect()
    assert [(r.nth, r.name, r.size) for r in got] == [(1, "attachment-1", 4), (2, "second", 3), (3, "attachment-3", 2), (4, "last", 1)]


def test_far_objects_are_reached(spark):
    objects = spark.createDataFrame([(1, i) for i in range(40)], "doc_id long, obj_id long")
    refs = spark.createDataFrame([(1, i, i + 2) for i in range(0, 36, 2)] + [(1, 36, 0), (1, 3, 5)], "doc_id long, obj_id long, to long")
    got = {r.obj_id: r.new_id for r in trees.reachable(objects, refs, objects.where("obj_id = 0")).collect()}
    assert got == {2 * i: i + 1 for i in range(19)}


def test_long_role_chains(spark):
    tags = spark.createDataFrame([(1, 1, "r0"), (1, 2, "c1"), (1, 3, "plain")], "doc_id long, id long, role string")
    roles = spark.createDataFrame([(1, f"r{i}", f"r{i + 1}") for i in range(20)] + [(1, "c1", "c2"), (1, "c2", "c1")], "doc_id long, role string, to string")
    assert {r.id: r.standard_role for r in trees.role_of(tags, roles).collect()} == {1: "r20", 2: "c2", 3: "plain"}


def test_long_sequence_numbers_keep_their_paths(spark):
    rows = spark.createDataFrame([(1, 10**11 + i, f"c{i}", None) for i in range(3)], "doc_id long, seq long, id string, reply_to string")
    assert comments.flat_threads(rows).select("path").distinct().count() == 3


def test_places_of_many_matches(spark):
    text = "ab" * 3000 + "xaab"
    d = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    got = d.select(F.explode(tx.match_starts(F.col("text"), "a+b")).alias("m")).select("m.*").collect()
    want = [2 * i for i in range(3000)] + [6001]
    assert [r.start for r in got] == want and got[-1].text == "aab"
    assert search.find_text(d, "AAB").first().start == 6001


def test_terms_overlap_and_lists_are_sliced(spark, monkeypatch):
    d = spark.createDataFrame([(1, 1, "Banana band AAAA"), (1, 2, None), (1, 3, "none")], "doc_id long, page int, text string")
    t = spark.createDataFrame([("an",), ("ANA",), ("aa",), ("band",), ("",), (None,)], "term string")
    want = {("an", 3), ("ana", 1), ("aa", 2), ("band", 1)}
    assert {(r.term, r.hits) for r in search.find_terms(d, t, "text").collect()} == want
    monkeypatch.setattr(search, "TERM_BYTES", 4)
    assert {(r.term, r.hits) for r in search.find_terms(d, t, "text").collect()} == want
    assert search.find_terms(d, t.limit(0), "text").count() == 0


def test_limits_are_errors(spark):
    big = spark.createDataFrame([(1, 90000.0, 90000.0)], "doc_id long, width double, height double")
    with pytest.raises(Exception, match="500 tiles"):
        pages.poster(big, 1.0, 300.0, 400.0, 10.0).collect()
    many = spark.range(600).select(F.lit(1).alias("doc_id"), F.lit(False).alias("locked"), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("points"))
    with pytest.raises(Exception, match="500 annotations"):
        inventory.shift(many, 1.0, 1.0).collect()
    parts = spark.range(1200).select(F.lit(1).alias("doc_id"), F.col("id").alias("part"), F.col("id").alias("page"))
    with pytest.raises(Exception, match="1000 files"):
        exports.archive_manifest(parts).collect()


def test_selections_meet_their_pages_once(spark):
    p = spark.createDataFrame([(1, i, 1000.0 * i, 1000.0 * i + 990) for i in range(6)], "doc_id long, page int, top double, bottom double")
    r = spark.createDataFrame([(1, 5.0, 1500.0, 50.0, 3200.0), (1, 5.0, 991.0, 6.0, 999.0), (1, 0.0, 10.0, 1.0, 20.0)], "doc_id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((q.page, q.y0, q.y1) for q in inventory.selection_quads(r, p).collect())
    assert got == [(0, 10.0, 20.0), (1, 1500.0, 1990.0), (2, 2000.0, 2990.0), (3, 3000.0, 3200.0)]


def test_columns_part_at_the_gutter(spark):
    words = [(1, 1, i, 50.0 + 20 * (i % 8), 15.0) for i in range(16)] + [(1, 1, 20 + i, 350.0 + 20 * (i % 8), 15.0) for i in range(16)] + [(1, 2, i, 40.0 * i, 45.0) for i in range(14)]
    w = spark.createDataFrame(words, "doc_id long, page int, seq int, x double, width double")
    widths = spark.createDataFrame([(1, 1, 612.0), (1, 2, 612.0)], "doc_id long, page int, page_width double")
    got = structure.in_columns(w, widths).collect()
    assert all(r.column == (2 if r.page == 1 and r.seq >= 20 else 1) for r in got) and structure.column_gutters(w, widths).count() == 1


def test_parts_by_size(spark):
    d = spark.createDataFrame([(1, i, b) for i, b in enumerate([10, 10, 50, 5, 5, 200, 1], 1)], "doc_id long, page int, bytes int")
    assert [r.part for r in structure.split_by_size(d, 30).orderBy("page").collect()] == [1, 1, 2, 3, 3, 4, 5]


def test_join_styles(spark):
    d = spark.createDataFrame([(1, 1, 1, "a", False), (1, 1, 2, "", True), (1, 1, 3, "b", False)], "doc_id long, page int, seq int, str string, eol boolean")
    assert {s: structure.page_text(d, s).first().text for s in structure.STYLES} == {"search": "a\nb", "compare": "a \nb ", "spaced": "a  b", "filled": "a b"}
    with pytest.raises(ValueError, match="style"):
        structure.page_text(d, "other")


def test_nested_bookmarks_of_bad_files_are_an_error(spark):
    from folianta.sources import exchange

    wrap = lambda inner: '{"format":"bookmarks","version":1,"bookmarks":[' + inner + "]}"
    deep = '{"title":"x","page":1,"children":[' * 40 + '{"title":"x","page":1}' + "]}" * 40
    bodies = [wrap('{"title":"a \\"b\\"","page":null,"children":[{"title":"c","page":2},{"title":"d"}]}'), wrap('{"title":" ","page":1}'), wrap('{"title":"a","page":0}'), "{}", None, wrap(deep), wrap("")]
    got = exchange.bookmark_tree(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")).collect()
    assert sorted((r.path, r.title, r.page) for r in got if r.doc_id == 0) == [([0], 'a "b"', None), ([0, 0], "c", 2), ([0, 1], "d", None)]
    assert {r.doc_id: r.error for r in got if r.doc_id} == {1: "bad title", 2: "no such page", 3: "not bookmarks", 4: "not bookmarks", 5: "nested too deep"}


def test_own_bookmarks_are_read_whole(spark):
    from folianta.sources import exchange

    body = '{"format":"bookmarks","version":1,"bookmarks":[' + ",".join('{"title":"t%d","page":1}' % i for i in range(10_001)) + "]}"
    files = spark.createDataFrame([(1, body)], "doc_id int, body string")
    assert [r.error for r in exchange.bookmark_tree(files).collect()] == ["too many bookmarks"]
    assert [r.error for r in exchange.bookmark_tree(files, most_bytes=1000).collect()] == ["not bookmarks"]
    got = exchange.bookmark_tree(files, most=None, most_bytes=None).collect()
    assert len(got) == 10_001 and all(r.error is None and r.title == f"t{r.path[0]}" for r in got)


def test_roles_take_one_join(spark):
    """No round of joins a step; entries that occur twice or lead nowhere, roles that are missing, and documents without a map."""
    tags = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 4, "a"), (1, 5, "d")], "doc_id long, id long, role string")
    roles = spark.createDataFrame([(1, "a", "c"), (1, "a", "b"), (1, "b", "d"), (1, "d", None), (3, "a", "x")], "doc_id long, role string, to string")
    found = trees.role_of(tags, roles)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "tables-" not in plan
    assert {r.id: r.standard_role for r in found.collect()} == {1: "d", 2: "d", 3: None, 4: "a", 5: "d"}
