"""Queries over the reports of structure and accessibility checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import audit, checks, exports, forms, layout
from ..operators import pages as page_ops
from .registry import ORACLES, PAGES, pages, query, table
from .structure_queries import PAGE_WIDTH, column_places, tags_of

_ODD = ORACLES["structure_checks"].replace("['Table', 'TR', 'TH'", "CASE WHEN l_partkey % 41 = 0 THEN '' ELSE ['Table', 'TR', 'TH'").replace("% 12 + 1)::INT] AS role", "% 12 + 1)::INT] END AS role")


@query(f"""WITH b AS (SELECT * FROM ({_ODD})), o AS (SELECT doc_id, bool_or(odd) AS odd FROM (SELECT l_orderkey AS doc_id, min(l_partkey) % 41 = 0 AS odd FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1)
SELECT doc_id, "check", CASE WHEN bad > 0 THEN 'failed' WHEN odd THEN 'warning' ELSE 'passed' END AS status, bad FROM b JOIN o USING (doc_id)
UNION ALL SELECT doc_id, 'structure-integrity', CASE WHEN odd THEN 'failed' ELSE 'passed' END, odd::BIGINT FROM o UNION ALL SELECT doc_id, 'table-regularity', 'manual', 0 FROM o""")
def structure_report(spark, sf_dir):
    """Outcomes of the structure checks; some lines of an order have no role."""
    return checks.structure_report(tags_of(spark, sf_dir, bare=True))


def _parts(spark, sf_dir):
    k = F.col("doc_id")
    allowed = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.array(F.lit("print"))).otherwise(F.array(F.lit("print"), F.lit("accessibility")))
    d = table(spark, sf_dir, "documents").select("doc_id", (k % 3 != 0).alias("tagged"), F.lit(4).alias("figures"), (k % 4).alias("figures_without"), F.when(k % 5 > 0, F.concat(F.lit(" "), "source", F.lit(" & <"), k)).alias("title"), (k % 2 == 0).alias("display_title"), "lang", allowed.alias("permissions"), (k % 2 == 1).alias("outlines"))
    p = pages(spark, sf_dir).withColumn("annotations", F.col("page") % 3).withColumn("tabs", F.when(F.col("page") % 5 == 1, "S").when(F.col("page") % 5 == 2, "R"))
    p = p.withColumn("text", F.when(F.length("text") > 40, F.col("text")))
    f = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 4").alias("doc_id"), F.concat(F.lit("f"), "l_partkey").alias("name"), F.when(F.col("l_linestatus") != "F", "tip").alias("tooltip"))
    links = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 4").alias("doc_id"), F.when(F.col("l_returnflag") != "N", "to").alias("description"))
    return d, p, f, links


_REPORT = f"""WITH {PAGES}, d AS (SELECT doc_id, doc_id % 3 <> 0 AS tagged, doc_id % 4 AS without, CASE WHEN doc_id % 5 > 0 THEN source || ' & <' || doc_id END AS title, doc_id % 2 = 0 AS shown, lang, doc_id % 7 AS perm, doc_id % 2 = 1 AS outlines FROM documents),
x AS (SELECT doc_id, page, coalesce(length(text) > 40 AND trim(text) <> '', false) AS has, page % 3 > 0 AND coalesce(page % 5 <> 1, true) AS tab FROM pages_), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
l AS (SELECT doc_id, list(page ORDER BY page) FILTER (NOT has) AS bare, list(page ORDER BY page) FILTER (tab) AS tabs FROM x GROUP BY 1),
f AS (SELECT l_orderkey // 4 AS doc_id, count(*) AS n, min('f' || l_partkey) AS name FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), k AS (SELECT l_orderkey // 4 AS doc_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS bad FROM lineitem GROUP BY 1),
g AS (SELECT d.*, coalesce(n.n, 0) AS pages, coalesce(bare, []) AS bare, coalesce(tabs, []) AS tabs, coalesce(f.n, 0) AS fields, f.name, coalesce(k.n, 0) AS links, coalesce(k.bad, 0) AS undescribed FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)),
r AS (SELECT doc_id, title, unnest(range(1, 13)) AS nth, unnest(['tagged', 'figures', 'title', 'display-title', 'language', 'text', 'tab-order', 'field-tooltips', 'link-text', 'security', 'bookmarks', 'manual']) AS "check",
  unnest([CASE WHEN tagged THEN 'passed' ELSE 'failed' END, CASE WHEN NOT tagged THEN 'manual' WHEN without = 0 THEN 'passed' ELSE 'failed' END, CASE WHEN title IS NOT NULL THEN 'passed' ELSE 'failed' END, CASE WHEN shown THEN 'passed' ELSE 'failed' END,
    CASE WHEN coalesce(trim(lang), '') <> '' THEN 'passed' ELSE 'failed' END, CASE WHEN len(bare) = 0 THEN 'passed' ELSE 'failed' END, CASE WHEN len(tabs) = 0 THEN 'passed' ELSE 'failed' END, CASE WHEN fields = 0 THEN 'passed' ELSE 'failed' END,
    CASE WHEN undescribed = 0 THEN 'passed' ELSE 'warning' END, CASE WHEN perm = 1 THEN 'failed' ELSE 'passed' END, CASE WHEN pages <= 20 OR outlines THEN 'passed' ELSE 'warning' END, 'manual']) AS status,
  unnest(['', CASE WHEN tagged AND without > 0 THEN without || ' of 4 without alternate text' ELSE '' END, coalesce(title, ''), '', coalesce(trim(lang), ''),
    CASE WHEN len(bare) > 0 THEN 'pages without text: ' || array_to_string(bare[:8], ', ') || CASE WHEN len(bare) > 8 THEN ' and ' || (len(bare) - 8) || ' more' ELSE '' END ELSE '' END,
    CASE WHEN len(tabs) > 0 THEN 'pages without a tab order: ' || array_to_string(tabs[:8], ', ') || CASE WHEN len(tabs) > 8 THEN ' and ' || (len(tabs) - 8) || ' more' ELSE '' END ELSE '' END,
    CASE WHEN fields > 0 THEN fields || ' without a tooltip, such as ' || name ELSE '' END, CASE WHEN undescribed > 0 THEN undescribed || ' of ' || links || ' without a description' ELSE '' END, '', '', '']) AS detail FROM g)"""


@query(_REPORT + ' SELECT doc_id, "check", status, detail FROM r')
def accessibility_report(spark, sf_dir):
    return checks.accessibility_report(*_parts(spark, sf_dir))


_NOTE = "Checks can't judge reading order & contrast."
_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(_REPORT + f""", t AS (SELECT doc_id, {_ESC.format("coalesce(any_value(title), 'Untitled document')")} AS t, string_agg('<tr><th scope="row">' || CASE "check" WHEN 'title' THEN 'Title' ELSE "check" END || '</th><td>' || status || '</td><td>' || {_ESC.format("detail")} || '</td></tr>', '' ORDER BY nth) AS b FROM r GROUP BY doc_id)
SELECT doc_id, '<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src ''none''; style-src ''unsafe-inline''"><title>' || t || '</title></head><body><main><h1>' || t || '</h1><p>' || '{_NOTE.replace("'", "&#39;").replace("& ", "&amp; ")}' ||
  '</p><table><caption>Checks</caption><thead><tr><th scope="col">Check</th><th scope="col">Status</th><th scope="col">Details</th></tr></thead><tbody>' || b || '</tbody></table></main></body></html>' AS html FROM t""")
def accessibility_html(spark, sf_dir):
    """The report of each document as a page."""
    d, p, f, links = _parts(spark, sf_dir)
    order = ["tagged", "figures", "title", "display-title", "language", "text", "tab-order", "field-tooltips", "link-text", "security", "bookmarks", "manual"]
    nth = F.array_position(F.array(*map(F.lit, order)), F.col("check"))
    return checks.report_page(checks.accessibility_report(d, p, f, links).withColumn("nth", nth), d.select("doc_id", "title"), {"title": "Title"}, _NOTE)


@query(f"""SELECT doc_id, page, '--- Page ' || page || ' ---' || chr(10) || string_agg(text, chr(10) ORDER BY c, y DESC) AS text FROM (
SELECT doc_id, page, c, y, string_agg(CASE WHEN x - before > 1.5 THEN ' ' ELSE '' END || str, '' ORDER BY x, seq) AS text FROM (
SELECT w.doc_id, w.page, w.seq, w.str, k."column" AS c, 700 - 12 * (w.seq // 14) AS y, 54 + 300 * (w.seq % 2) + 37 * w.seq % 170 AS x, lag(54 + 300 * (w.seq % 2) + 37 * w.seq % 170 + length(w.str) * 5.0) OVER (PARTITION BY w.doc_id, w.page, k."column", w.seq // 14 ORDER BY 54 + 300 * (w.seq % 2) + 37 * w.seq % 170, w.seq) AS before
FROM (SELECT doc_id, page, unnest(range(1, len(w) + 1))::INT AS seq, unnest(w) AS str FROM (SELECT doc_id, page, regexp_extract_all(text, '[^ ]+') AS w FROM (WITH {PAGES} SELECT * FROM pages_))) w JOIN ({ORACLES["word_columns"]}) k ON k.doc_id = w.doc_id AND k.page = w.page AND k.seq = w.seq) GROUP BY ALL) GROUP BY doc_id, page""")
def column_text(spark, sf_dir):
    """Pages of words in one or two columns as plain text, the left column first."""
    return exports.plain_pages(layout.read_texts(pages(spark, sf_dir).withColumn("page_width", F.lit(PAGE_WIDTH)), column_places))


@query("""WITH w AS (SELECT o_orderkey // 10 AS doc_id, 1 AS page, o_orderkey AS widget, o_custkey % 400 + 100.0 AS x0, o_orderkey % 10 * 30 + 20.0 AS y0, o_custkey % 400 + 160.0 AS x1, o_orderkey % 10 * 30 + 34.0 AS y1 FROM orders),
i AS (SELECT l_orderkey // 10 AS doc_id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'label ' || l_partkey END AS str, l_partkey * 7 % 500 AS x, l_suppkey * 11 % 340 AS y, l_quantity AS width, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE 6 + l_partkey % 8 END AS size FROM lineitem),
j AS (SELECT w.*, seq, str, x, y, x + width AS e, CASE WHEN size = 0 THEN 10 ELSE size END AS s FROM w JOIN i USING (doc_id) WHERE trim(str) <> ''),
n AS (SELECT *, e <= x0 + 2 AND x0 - e < 150 AND abs(y + s * 0.35 - (y0 + y1) / 2) < greatest(s, y1 - y0) * 0.6 AS l, y > y1 AND y - y1 < 24 AND x < x1 AND e > x0 - 2 AS a FROM j),
g AS (SELECT doc_id, widget, arg_min(str, (-e, seq)) FILTER (l) AS l, arg_min(str, (y, seq)) FILTER (a) AS a FROM n GROUP BY ALL)
SELECT w.doc_id, w.page, w.widget, coalesce(l, a, '') AS label FROM w LEFT JOIN g USING (doc_id, widget)""")
def nearby_labels(spark, sf_dir):
    """Labels left of or above each widget."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 400
    low = k % 10 * 30 + 20.0
    w = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 10").alias("doc_id"), F.lit(1).alias("page"), k.alias("widget"), (c + 100.0).alias("x0"), low.alias("y0"), (c + 160.0).alias("x1"), (low + 14.0).alias("y1"))
    p = F.col("l_partkey")
    i = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 10").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(p % 9 == 0, " ").otherwise(F.concat(F.lit("label "), p)).alias("str"),
        (p * 7 % 500).cast("double").alias("x"), (F.col("l_suppkey") * 11 % 340).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("width"), F.when(p % 5 == 0, 0.0).otherwise(6.0 + p % 8).alias("size"),
    )
    return forms.nearby_label(w, i)


@query("""WITH RECURSIVE f AS (SELECT p_partkey // 25 AS bundle, p_partkey % 25 // 5 AS source, p_partkey AS seq, CASE p_size % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'a.b' WHEN 2 THEN 'a.b.c' WHEN 3 THEN 'd' WHEN 4 THEN NULL WHEN 5 THEN 'e' || p_size % 3 ELSE 'd.x' END AS name FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY source, seq) AS k, coalesce(name, 'field') AS own FROM f),
w AS (SELECT DISTINCT bundle, 0::BIGINT AS k, []::VARCHAR[] AS names, NULL::VARCHAR AS u FROM n UNION ALL
SELECT bundle, k, list_append(names, u), u FROM (SELECT n.bundle, n.k, w.names, list_filter(list_prepend(n.own, list_transform(range(1, 30), lambda i: 'Source' || (n.source + 1) || '_' || n.own || '_' || i)),
  lambda c: len(list_filter(w.names, lambda x: x = c OR starts_with(x, c || '.') OR starts_with(c, x || '.'))) = 0)[1] AS u FROM w JOIN n ON n.bundle = w.bundle AND n.k = w.k + 1))
SELECT n.bundle, n.source, n.seq, n.name, w.u AS "unique" FROM n JOIN w ON w.bundle = n.bundle AND w.k = n.k""")
def fields_merged(spark, sf_dir):
    """Names of the fields of five merged documents each."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(s % 7 == 0, "a").when(s % 7 == 1, "a.b").when(s % 7 == 2, "a.b.c").when(s % 7 == 3, "d").when(s % 7 == 4, F.lit(None)).when(s % 7 == 5, F.concat(F.lit("e"), s % 3)).otherwise("d.x")
    return forms.merged_fields(table(spark, sf_dir, "part").select(F.expr("p_partkey div 25").alias("bundle"), F.expr("p_partkey % 25 div 5").alias("source"), k.alias("seq"), name.alias("name")))


@query("""WITH b AS (SELECT l_orderkey // 100 AS doc_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber % 3 > 0 AS has_dest, l_partkey % 9 AS target_page FROM lineitem), p AS (SELECT DISTINCT l_orderkey // 100 AS doc_id, l_suppkey % 9 AS target_page FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT b.*, has_dest AND p.doc_id IS NULL AS cleared FROM b LEFT JOIN p USING (doc_id, target_page)) SELECT doc_id, id, has_dest AND NOT cleared AS has_dest, CASE WHEN NOT cleared THEN target_page END AS target_page, cleared FROM c""")
def bookmarks_cleared(spark, sf_dir):
    """Bookmarks without their dead destinations."""
    t = table(spark, sf_dir, "lineitem")
    d = F.expr("l_orderkey div 100").alias("doc_id")
    marks = t.select(d, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") % 3 > 0).alias("has_dest"), (F.col("l_partkey") % 9).alias("target_page"))
    return audit.without_broken(marks, t.where("l_linenumber = 1").select(d, (F.col("l_suppkey") % 9).alias("page")))


@query("""WITH p AS (SELECT l_orderkey AS id, list(l_partkey % 600 ORDER BY l_linenumber, l_partkey, l_suppkey) AS x, list(l_suppkey % 790 ORDER BY l_linenumber, l_partkey, l_suppkey) AS y, ['distance', 'perimeter', 'area'][(l_orderkey % 3 + 1)::INT] AS kind, (l_orderkey % 5) / 2 AS inches, (l_orderkey % 7 + 1) * 25 AS real, ['ft', 'm', 'in'][(l_orderkey % 3 + 1)::INT] AS unit FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, len(x) AS n, CASE WHEN inches > 0 THEN real / (inches * 72) END AS f, list_sum(list_transform(range(1, len(x)), lambda i: sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2))) AS path, sqrt((x[1] - x[-1]) ** 2 + (y[1] - y[-1]) ** 2) AS back,
  abs(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i % len(x) + 1] - x[i % len(x) + 1] * y[i]))) / 2 AS area FROM p)
SELECT id, CASE WHEN f IS NULL OR n < CASE WHEN kind = 'area' THEN 3 ELSE 2 END THEN NULL WHEN kind = 'area' THEN format('{:,.2f}', round(area * f * f, 2)) || ' sq ' || unit ELSE format('{:,.2f}', round((path + CASE WHEN kind = 'perimeter' AND n > 2 THEN back ELSE 0 END) * f, 2)) || ' ' || unit END AS text FROM s""")
def measurements(spark, sf_dir):
    """Paths through the places of an order's lines, as text in real units."""
    k = F.col("id")
    at = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(at, lambda p: F.struct((p["l_partkey"] % 600).cast("double").alias("x"), (p["l_suppkey"] % 790).cast("double").alias("y"))).alias("p"))
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    return t.select("id", geo.measurement_text(of("distance", "perimeter", "area"), F.col("p"), k % 5 / 2, (k % 7 + 1) * 25.0, of("ft", "m", "in")).alias("text"))


_TSV = """g AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
r AS (SELECT doc_id, (seq % 2 + 1)::INT AS page, seq, s % 2 AS block, p * 7 % 900 AS l, s * 11 % 700 AS t, p % 90 + CASE WHEN p % 13 = 0 THEN -89 ELSE 1 END AS w, s % 40 + 1 AS h, CASE WHEN p % 11 = 0 THEN -1 ELSE q * 3 END AS c, CASE WHEN s % 9 = 0 THEN ' ' ELSE 'w' || p END AS word, CASE WHEN p % 17 = 0 THEN 4 ELSE 5 END AS level FROM g),
k AS (SELECT *, least(c / 100, 1) AS conf FROM r WHERE level = 5 AND trim(word) <> '' AND c >= 0 AND w > 0),
n AS (SELECT *, CASE WHEN lag(block) OVER (PARTITION BY doc_id, page ORDER BY seq) = block THEN 0 ELSE 1 END AS new FROM k), m AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page ORDER BY seq))::BIGINT AS nth FROM n)"""


def _tsv(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q"))
    p, s = F.col("p"), F.col("s")
    cells = [F.when(p % 17 == 0, 4).otherwise(5), F.lit(1), s % 2, F.lit(1), F.lit(1), F.col("seq"), p * 7 % 900, s * 11 % 700, p % 90 + F.when(p % 13 == 0, -89).otherwise(1), s % 40 + 1, F.when(p % 11 == 0, -1).otherwise(F.col("q") * 3), F.when(s % 9 == 0, " ").otherwise(F.concat(F.lit("w"), p))]
    return t.select("doc_id", (F.col("seq") % 2 + 1).cast("int").alias("page"), "seq", F.concat_ws("\t", *(c.cast("string") for c in cells)).alias("line"))


@query(f"""WITH {_TSV}, z AS (SELECT doc_id, page, nth, least(l / 800, 1) AS x, greatest(0, 1 - (t + h) / 600) AS y, w / 800 AS w, h / 600 AS h FROM m)
SELECT doc_id, page, nth, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM z GROUP BY ALL""")
def ocr_boxes(spark, sf_dir):
    """Boxes of recognised lines in images of 800 x 600."""
    tsv = _tsv(spark, sf_dir)
    return layout.ocr_boxes(tsv, tsv.select("doc_id", "page").distinct().withColumn("image_width", F.lit(800.0)).withColumn("image_height", F.lit(600.0)))


@query(f"""WITH {_TSV}, a AS (SELECT DISTINCT doc_id, page FROM r), b AS (SELECT doc_id, page, count(*) AS words, max(nth)::BIGINT AS lines, avg(conf) AS confidence FROM m GROUP BY ALL)
SELECT a.doc_id, a.page, coalesce(words, 0) AS words, coalesce(lines, 0) AS lines, coalesce(confidence, 0) AS confidence FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.page = b.page""")
def ocr_pages(spark, sf_dir):
    return layout.ocr_pages(_tsv(spark, sf_dir))


_ARRANGE = ("left", "right", "top", "bottom", "center-horizontal", "center-vertical", "match-width", "match-height", "match-size")


@query(f"""WITH w AS (SELECT p_partkey // 7 AS "group", p_partkey AS nth, (p_partkey * 37 % 500)::DOUBLE AS x, (p_size * 13 % 700) / 4 AS y, (p_partkey % 30 + 5) / 2 AS width, (p_size % 20 + 3)::DOUBLE AS height, [{", ".join(repr(a) for a in _ARRANGE)}][(p_partkey // 7 % 9 + 1)::INT] AS o FROM part),
a AS (SELECT *, first_value(x) OVER g AS ax, first_value(y) OVER g AS ay, first_value(width) OVER g AS aw, first_value(height) OVER g AS ah FROM w WINDOW g AS (PARTITION BY "group" ORDER BY nth))
SELECT nth, floor(100 * CASE o WHEN 'left' THEN ax WHEN 'right' THEN ax + aw - width WHEN 'center-horizontal' THEN ax + (aw - width) / 2 ELSE x END + 0.5) / 100 AS new_x, floor(100 * CASE o WHEN 'top' THEN ay WHEN 'bottom' THEN ay + ah - height WHEN 'center-vertical' THEN ay + (ah - height) / 2 ELSE y END + 0.5) / 100 AS new_y,
  floor(100 * CASE WHEN o IN ('match-width', 'match-size') THEN aw ELSE width END + 0.5) / 100 AS new_width, floor(100 * CASE WHEN o IN ('match-height', 'match-size') THEN ah ELSE height END + 0.5) / 100 AS new_height FROM a""")
def widgets_aligned(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    g = F.expr("p_partkey div 7")
    op = F.element_at(F.array(*map(F.lit, _ARRANGE)), (g % 9 + 1).cast("int"))
    w = table(spark, sf_dir, "part").select(g.alias("group"), k.alias("nth"), (k * 37 % 500).cast("double").alias("x"), (s * 13 % 700 / 4).alias("y"), ((k % 30 + 5) / 2).alias("width"), (s % 20 + 3).cast("double").alias("height"), op.alias("operation"))
    return forms.aligned(w).select("nth", "new_x", "new_y", "new_width", "new_height")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber * 3 - 2 AS start_page, min(l_returnflag) AS style FROM lineitem GROUP BY ALL), d AS (SELECT o_orderkey AS doc_id, o_custkey % 18 AS pages FROM orders)
SELECT r.doc_id, start_page, style, row_number() OVER (PARTITION BY r.doc_id ORDER BY start_page)::INT AS nth FROM r JOIN d USING (doc_id) WHERE start_page <= pages""")
def label_ranges(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 3 - 2).alias("start_page")).agg(F.min("l_returnflag").alias("style"))
    return page_ops.label_ranges(r, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 18).alias("pages")))
