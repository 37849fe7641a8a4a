"""Reports of checks, labels and columns on small fixtures."""

from pyspark.sql import functions as F

from folianta.operators import checks, forms, layout


def test_an_incomplete_tree_warns(spark):
    rows = [(1, 1, None, 1, "L", None), (1, 2, 1, 2, "P", None), (2, 1, None, 1, "Document", None), (2, 2, 1, 2, None, None), (3, 1, None, 1, "Document", None), (4, 1, None, 1, "Document", None), (4, 2, 3, 2, "P", None), (4, 3, 2, 3, "P", None)]
    tags = spark.createDataFrame(rows, "doc_id long, id long, parent_id long, seq int, role string, alt string").withColumn("actual_text", F.lit(""))
    got = {(r.doc_id, r.check): (r.status, r.bad) for r in checks.structure_report(tags.where("doc_id < 4")).collect()}
    assert got[1, "list-items"] == ("failed", 1) and got[1, "structure-integrity"] == ("passed", 0)
    assert got[2, "structure-integrity"] == ("failed", 1) and got[2, "list-items"] == ("warning", 0)
    assert got[3, "list-items"] == ("passed", 0) and {got[d, "table-regularity"] for d in (1, 2, 3)} == {("manual", 0)}


def test_pages_are_listed_up_to_a_number(spark):
    pages = spark.createDataFrame([(1, p) for p in range(12, 0, -1)] + [(2, 5)], "doc_id long, page int")
    assert sorted(tuple(r) for r in checks.listed(pages, 3).collect()) == [(1, 12, "1, 2, 3 and 9 more"), (2, 1, "5")]


def test_labels_left_win_over_labels_above(spark):
    widgets = spark.createDataFrame([(1, 1, "a", 100.0, 50.0, 160.0, 64.0), (1, 1, "b", 300.0, 50.0, 360.0, 64.0), (1, 1, "c", 500.0, 500.0, 560.0, 514.0)], "doc_id int, page int, widget string, x0 double, y0 double, x1 double, y1 double")
    items = [(1, 1, 0, "far", 10.0, 52.0, 20.0, 10.0), (1, 1, 1, "near", 60.0, 52.0, 38.0, 10.0), (1, 1, 2, "over a", 100.0, 70.0, 40.0, 10.0), (1, 1, 3, "over b", 290.0, 80.0, 40.0, 0.0), (1, 1, 4, "lower", 310.0, 70.0, 40.0, 0.0), (1, 1, 5, " ", 310.0, 66.0, 40.0, 0.0)]
    got = forms.nearby_label(widgets, spark.createDataFrame(items, "doc_id int, page int, seq int, str string, x double, y double, width double, size double")).collect()
    assert {r.widget: r.label for r in got} == {"a": "near", "b": "lower", "c": ""}


def test_equally_near_labels_of_one_number_go_by_text(spark):
    widgets = spark.createDataFrame([(1, 1, "a", 100.0, 50.0, 160.0, 64.0), (1, 1, "b", 300.0, 150.0, 360.0, 164.0)], "doc_id int, page int, widget string, x0 double, y0 double, x1 double, y1 double")
    items = [(1, 1, 1, t, 60.0, 52.0, 38.0, 10.0) for t in ("y", "x", "z")] + [(1, 1, 2, t, 300.0, 170.0, 38.0, 10.0) for t in ("q", "p", "r")]
    for rows in (items, items[::-1]):
        got = forms.nearby_label(widgets, spark.createDataFrame(rows, "doc_id int, page int, seq int, str string, x double, y double, width double, size double").coalesce(1)).collect()
        assert {r.widget: r.label for r in got} == {"a": "x", "b": "p"}


def test_the_left_column_is_read_first(spark):
    items = [(1, 1, i, f"w{i}", 50.0 if i % 2 else 350.0, 700.0 - 12 * (i // 2), 100.0, 10.0) for i in range(40)]
    df = spark.createDataFrame(items, "doc_id long, page int, seq int, str string, x double, y double, width double, size double")
    got = layout.reading_order(df, spark.createDataFrame([(1, 1, 612.0)], "doc_id long, page int, page_width double")).orderBy("line").collect()
    assert [r.text for r in got] == [f"w{i}" for i in range(1, 40, 2)] + [f"w{i}" for i in range(0, 40, 2)] and [r.line for r in got] == list(range(1, 41))
    one = layout.reading_order(df.where("seq < 10"), spark.createDataFrame([(1, 1, 612.0)], "doc_id long, page int, page_width double")).orderBy("line").collect()
    assert [r.text for r in one] == [f"w{i + 1} w{i}" for i in range(0, 10, 2)]


def plain_report(rows):
    """What breaks which rule, and whether the tree is whole, by walks from each tag."""
    out = {r: 0 for r in ("heading-nesting", "list-items", "list-bodies", "table-rows", "table-cells", "table-headers", "nested-alt", "other-alt")}
    last, headed, nested, broken = 0, set(), set(), False
    at = {t[1]: t for t in rows}
    for _, id_, up, _, role, alt, _ in rows:
        seen, found, n = [], False, 0
        while up in at and n < 127:
            n += 1
            if at[up][5]:
                nested.add(id_)
            if role == "TH" and not found and at[up][4] == "Table":
                found = headed.add(up) is None
            seen.append(up)
            up = at[up][2]
        broken |= up in at
    for _, id_, _, _, role, alt, actual in sorted(rows, key=lambda t: t[3]):
        kids = [t[4] for t in rows if t[2] == id_ and t[4] is not None]
        other = lambda *ok: not kids or any(k not in ok for k in kids)  # noqa: E731, B023
        level = int(role[1]) if role in ("H1", "H2", "H3") else 0
        out["heading-nesting"] += level > last + 1
        last = level or last
        out["list-items"] += role == "L" and other("LI")
        out["list-bodies"] += role == "LI" and (kids.count("LBody") != 1 or other("Lbl", "LBody"))
        out["table-rows"] += role == "Table" and other("TR", "Caption")
        out["table-cells"] += role == "TR" and other("TH", "TD")
        out["table-headers"] += role == "Table" and id_ not in headed
        out["nested-alt"] += bool(alt) and id_ in nested
        out["other-alt"] += role == "Formula" and not alt and not actual
    return out, broken or any(not (t[4] or "").strip() for t in rows)


def test_documents_are_checked_where_their_tags_are(spark):
    """One shuffle, whatever the depth; the counts are those of plain walks, with cycles, long chains and parents that aren't there."""
    import random

    rng, docs = random.Random(3), {}
    for doc in range(40):
        ids = rng.sample(range(100), rng.randint(1, 30))
        docs[doc] = [
            (doc, i, rng.choice([None, *ids[: n + doc % 2], *([999] if doc % 5 == 0 else [])]), n, rng.choice(["Table", "TR", "TH", "TD", "L", "LI", "LBody", "Lbl", "Caption", "H1", "H2", "H3", "Formula", "P", *([None, " "] if doc % 7 == 0 else [])]), rng.choice([None, "", "alt"]), rng.choice([None, "", "x"]))
            for n, i in enumerate(ids)
        ]
    for doc, n in ((50, 128), (51, 131)):
        docs[doc] = [(doc, i, i - 1 if i else None, i, "P", "alt" if i == 0 else None, None) for i in range(n)]
    tags = spark.createDataFrame([t for rows in docs.values() for t in rows], "doc_id long, id long, parent_id long, seq int, role string, alt string, actual_text string").repartition(3)
    report = checks.structure_report(tags)
    assert report._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    got = {(r.doc_id, r.check): (r.status, r.bad) for r in report.collect()}
    for doc, rows in docs.items():
        rules, odd = plain_report(rows)
        assert {r: got[doc, r][1] for r in rules} == rules and got[doc, "structure-integrity"] == (("failed", 1) if odd else ("passed", 0)), doc
    assert len({got[d, "structure-integrity"] for d in docs}) == 2 and any(got[d, "nested-alt"][1] for d in docs)


def test_documents_are_whole_in_a_batch():
    import pyarrow as pa

    from folianta.operators import grouped

    keys = [None, None, 1, 2, 2, 2, 2, 3, 4, 4]
    for size in (1, 2, 3, 10):
        parts = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + size], pa.int64()), "v": list(range(i, min(10, i + size)))}) for i in range(0, 10, size)]
        got = [b.to_pydict() for b in grouped.whole(iter(parts), "k")]
        assert [v for b in got for v in b["v"]] == list(range(10)) and sum(len(set(b["k"])) for b in got) == 5
