"""Pages that hold their items: no shuffle of words, and the same lines as a plain walk over each page."""

import random

from folianta.operators import layout, structure
from folianta.plans import catalog

SF = "/root/testdata/sf0.001"


def some_items():
    r, rows = random.Random(7), []
    for doc in range(12):
        for page in (1, 2, 3):
            rough = r.random() < 0.5
            for seq in range(r.choice([1, 3, 15, 60])):
                y = r.uniform(0, 60) if rough else r.choice([700.0, 690.0, 688.0, 687.0, 599.5])
                rows.append((doc, page, seq, r.choice(["a", "bb", " ", "", "x y"]), r.choice([r.uniform(0, 250), r.uniform(330, 600)]), y, r.choice([9.0, 10.0, 10.24, 0.0]), r.uniform(0, 30)))
    return rows


def by_page(rows):
    pages = {}
    for d, p, *item in rows:
        pages.setdefault((d, p), []).append(tuple(item))
    return pages


def lines_of(words):
    lines = []
    for k, t, x, y, size, width in sorted(words, key=lambda w: (-w[3], w[2], w[0])):
        home = next((n for n in lines if abs(n[0] - y) <= 0.5 * size), None)
        if home is None:
            lines.append((y, [(x, k, t, size, width)]))
        else:
            home[1].append((x, k, t, size, width))
    for y, ws in lines:
        cells, end = [], None
        for x, _, t, size, width in sorted(ws):
            if end is None or x - end > 1.5 * size:
                cells.append(t)
            else:
                cells[-1] += (" " if x - end > 0.15 * size else "") + t
            end = x + width
        yield y, cells


def chains_of(words):
    out = []
    for k, t, _, y, z, _ in sorted(words):
        size = int(z * 2 + 0.5) / 2
        if out and out[-1][1] == size and abs(out[-1][2] - y) <= 0.2 * size:
            out[-1][3].append(t)
        elif t.strip():
            out.append((k, size, y, [t]))
    return [(k, size, y, " ".join(t)) for k, size, y, t in out]


def test_lines_are_those_of_a_walk(spark):
    rows = some_items()
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, str string, x double, y double, size double, width double").repartition(3)
    got = sorted((r.doc_id, r.page, r.line, r.y, r.text, tuple(r.cells)) for r in layout.page_layout(items).collect())
    assert got == sorted((*key, n, y, " ".join(c), tuple(c)) for key, words in by_page(rows).items() for n, (y, c) in enumerate(lines_of(words), 1))
    got = sorted((r.doc_id, r.page, r.seq, r["size"], r.y, r.text) for r in layout.merge_items(items).collect())
    assert got == sorted((*key, *line) for key, words in by_page(rows).items() for line in chains_of(words))


def test_pages_need_no_shuffle(spark):
    for name in ("column_text", "word_columns", "page_layout", "line_merge", "page_text_search", "page_text_compare", "page_text_spaced", "page_text_filled"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "FlatMapGroups" not in plan, name


def test_columns_of_pages_are_those_of_words(spark):
    rows = [(1, p, k, f"w{k}", 50.0 if k % 2 else 350.0, 700.0 - k // 2, 10.0, 100.0) for p in (1, 2) for k in range(30 if p == 1 else 12)]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, str string, x double, y double, size double, width double")
    widths = spark.createDataFrame([(1, 1, 612.0), (1, 2, 612.0)], "doc_id long, page int, page_width double")
    from folianta.operators import paged

    pages = paged.gathered(items, *paged.KINDS).join(widths, ["doc_id", "page"])
    each = {(r.page, r.seq): r.column for r in structure.columns_of(pages).collect()}
    assert each == {(r.page, r.seq): r.column for r in structure.in_columns(items, widths).collect()}
    assert {k: c for k, c in each.items() if k[0] == 2} == {(2, k): 1 for k in range(12)} and {c for (p, k), c in each.items() if p == 1 and k % 2 == 0} == {2}


def test_words_of_texts_are_read_as_items_are(spark):
    from folianta.plans.structure_queries import column_places

    rough = lambda k, n: (54 + 290 * (k % 2) + 37 * k % 150, 700 - 12 * (k - k % 14) / 14 - 3.0 * (k % 3), k * 0 + 4.0 + 3 * (n % 3), n * 5.0)
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "bé", "", "x\ty", "日本語", "w" * r.randrange(1, 30)]) for _ in range(r.choice([1, 3, 19, 20, 60, 300]))) for _ in range(120)]
    texts += ["", " ", "   ", "\t", " one", "one ", None]
    rows = [(k // 5, k % 5 + 1, t, 612.0 if k % 7 else None) for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string, page_width double").repartition(3)
    for places in (column_places, rough):
        words = [(d, p, k, w, *(float(v) for v in places(k, len(w))), across) for d, p, t, across in rows for k, w in enumerate((w for w in (t or "").split(" ") if w), 1)]
        items = spark.createDataFrame(words, "doc_id long, page int, seq int, str string, x double, y double, size double, width double, across double")
        lines = layout.reading_order(items, items.select("doc_id", "page", "across").distinct().withColumnRenamed("across", "page_width")).collect()
        want = {}
        for line in sorted(lines, key=lambda x: (x.doc_id, x.page, x.column, x.line)):
            want.setdefault((line.doc_id, line.page), []).append(line.text)
        got = {(x.doc_id, x.page): x.text for x in layout.read_texts(pages, places).collect()}
        assert got == {k: "\n".join(t) for k, t in want.items()}
        assert any(x.column == 2 for x in lines)


def test_texts_are_parted_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from folianta.operators import paged

    monkeypatch.setattr(paged, "AT_ONCE", 3)
    texts = ["aa  bb", "", None, " ", "é", "c" * 40, " d e ", "f"]
    parts = list(paged._words(pa.array(texts)))
    assert len(parts) > 2 and [k for n, _ in parts for k in n.tolist()] == [2, 0, 0, 0, 1, 1, 2, 1]
    assert [w for _, words in parts for w in words.to_pylist()] == [w for t in texts for w in (t or "").split()]


def test_pages_are_worked_out_once(spark):
    plan = catalog.QUERIES["column_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    for name in ("word_columns", "page_layout", "line_merge", "page_text_spaced"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and plan.count("ArrowEvalPython") <= 1, name
