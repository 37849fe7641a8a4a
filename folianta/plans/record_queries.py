"""Queries over names, boxes, inventories and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import names
from ..operators import forms, inventory
from .registry import query, table


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS a, strftime(o_orderdate, '%B ') || extract('day' FROM o_orderdate) || ', ' || strftime(o_orderdate, '%Y') AS b, o_orderdate::DATE AS back FROM orders")
def field_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.field_date(d, "dd.mm.yy").alias("a"), names.field_date(d, "mmmm d, yyyy").alias("b"), names.parse_field_date(names.field_date(d, "mmmm d, yyyy"), "mmmm d, yyyy").alias("back"))


#: Names of fonts and the standard style that is nearest.
_FONTS = {"ABCDEF+DejaVuMono-Bold": "Courier-Bold", "Arial": "Helvetica", "GeorgiaBoldItalic": "Times-BoldItalic", "Unknown-Oblique": "Helvetica-Italic", "Menlo-Regular": "Courier", "Baskerville": "Times", "BarcodeSans": "Helvetica", "Fira Code": "Courier",
          "NotoSansSerif-Demi": "Helvetica-Bold", "XYZABC+Didot,It": "Times-Italic", "Encoder": "Helvetica", "PT Serif Slanted": "Times-Italic"}
_KNOWN = ", ".join(f"('{a}', '{b}')" for a, b in _FONTS.items())


@query(f"WITH f AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_KNOWN}) v(name, font)) SELECT p_partkey, font FROM part JOIN f ON k = p_partkey % {len(_FONTS)}")
def font_styles(spark, sf_dir):
    n = F.element_at(F.array(*[F.lit(x) for x in _FONTS]), (F.col("p_partkey") % len(_FONTS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.standard_font(n).alias("font"))


@query("""WITH t AS (SELECT n_regionkey, n_nationkey, left(n_name, 2) AS name, row_number() OVER (PARTITION BY n_regionkey, lower(left(n_name, 2)) ORDER BY n_nationkey) AS k FROM nation) SELECT n_regionkey, n_nationkey, name, name || CASE WHEN k > 1 THEN ' ' || k ELSE '' END AS "unique" FROM t""")
def unique_field_names(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.substring("n_name", 1, 2).alias("name"))
    return names.unique_names(t, "n_regionkey", "n_nationkey", "name")


@query("SELECT s_suppkey, 'x' AS plain, 's' || s_suppkey AS raised, 'tail^{' AS rest FROM supplier")
def script_text(spark, sf_dir):
    runs = names.script_runs(F.concat(F.lit("x^{s"), F.col("s_suppkey"), F.lit("}tail^{")))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", runs.alias("r"))
    return t.select("s_suppkey", F.get("r", F.lit(0))["text"].alias("plain"), F.get("r", F.lit(1))["text"].alias("raised"), F.array_join(F.transform(F.slice("r", 3, 9), lambda x: x["text"]), "").alias("rest"))


@query("SELECT p_partkey, greatest(1, least(20, p_size - 10))::INT AS page, greatest(0.25, least(5, p_size / 5.0))::DOUBLE AS zoom FROM part")
def clamped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geo.clamp_page(F.col("p_size") - 10, F.lit(20)).alias("page"), geo.clamp_zoom(F.col("p_size") / 5).alias("zoom"))


@query("SELECT p_partkey, 69.9::DOUBLE AS x0, round((700 - p_size * 0.3)::DOUBLE, 6) AS y0, 98.1::DOUBLE AS x1, round((700 + p_size * 1.1)::DOUBLE, 6) AS y1 FROM part")
def match_rects(spark, sf_dir):
    r = geo.match_rect(F.lit(54.0), F.lit(700.0), F.lit(60.0), F.col("p_size"), F.lit(10), F.lit(3), F.lit(7))
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", *[F.round(F.col("r")[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT p_partkey, round(least(1.0, 300.0 / (p_size * 20), 200.0 / (p_size * 10)) * p_size * 20, 2) AS width, greatest(0.1, least(150 / 72.0::DOUBLE, 2000.0 / (p_size * 20), sqrt(1000000.0 / (p_size * 20.0 * p_size * 10))))::DOUBLE AS scale FROM part")
def fitted(spark, sf_dir):
    w, h = F.col("p_size") * 20.0, F.col("p_size") * 10.0
    return table(spark, sf_dir, "part").select("p_partkey", geo.fit(w, h, F.lit(300.0), F.lit(200.0))["width"].alias("width"), geo.print_scale(w, h, 150.0, 2000.0, 1000000.0).alias("scale"))


@query("SELECT p_partkey, (10 + p_size % 5)::BIGINT AS x0, least(10 + (p_size % 5) + p_size * 3, 100)::DOUBLE AS x1 FROM part WHERE 100 > 10 + p_size % 5")
def cropped(spark, sf_dir):
    r = geo.crop(geo.rect(10, 10, 100, 100), (F.col("p_size") % 5).cast("double"), F.lit(20.0), F.col("p_size") * 3.0, F.lit(40.0))
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).where("r is not null").select("p_partkey", F.col("r.x0").cast("long").alias("x0"), "r.x1")


@query("SELECT l_orderkey // 100 AS doc_id, 'F' || l_linenumber AS font, array_to_string(list_sort(list_distinct(list(l_partkey % 9))), ',') AS pages FROM lineitem GROUP BY l_orderkey // 100, l_linenumber")
def font_inventory(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("doc_id"), (F.col("l_partkey") % 9).alias("page"), F.concat(F.lit("F"), F.col("l_linenumber")).alias("font"), F.lit(True).alias("embedded"))
    return inventory.fonts(u).select("doc_id", "font", F.array_join(F.transform(F.array_sort("pages"), lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM customer")
def keyword_lists(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 2 == 0, "a b, c;d").otherwise("one  two")
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(inventory.keywords(t)).alias("n"))


@query("""WITH o AS (SELECT l_orderkey // 100 AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'scripts' WHEN l_linestatus = 'F' THEN 'layers' END AS "option" FROM lineitem) SELECT doc_id, "option", count(*) AS removed FROM o WHERE "option" IS NOT NULL GROUP BY ALL""")
def discard_counts(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("doc_id"), "l_returnflag", "l_linestatus")
    return inventory.discarded(o, {"scripts": "l_returnflag = 'A'", "layers": "l_linestatus = 'F'"})[1]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unchanged' WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 IN (1) THEN 'permitted' WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 IN (1, 2) THEN 'permitted' ELSE 'broken' END AS verdict FROM orders")
def signature_changes(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", (k % 3 + 1).alias("level"), F.when(k % 4 == 1, "form").when(k % 4 == 2, "comment").when(k % 4 == 3, "page").alias("change"))
    return inventory.permitted_changes(s).select("o_orderkey", "verdict")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey BETWEEN 1 AND 9 THEN n_nationkey END AS page, NOT (n_nationkey BETWEEN 1 AND 9) AS unplaced FROM nation")
def bookmarks_moved(spark, sf_dir):
    b = table(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("page"))
    return inventory.move_bookmarks(b, spark.createDataFrame([(1, 9)], "doc_id int, pages int")).select("id", "page", "unplaced")


@query("""WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS seq, l_returnflag = 'R' AS barrier, l_suppkey FROM lineitem), g AS (SELECT doc_id, seq, bool_or(barrier) AS barrier FROM u GROUP BY ALL), i AS (SELECT *, sum(barrier::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM g)
SELECT doc_id, seq, max(seq) OVER (PARTITION BY doc_id, i) AS front_seq FROM i WHERE NOT barrier""")
def z_order(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq")).agg(F.max(F.col("l_returnflag") == "R").alias("b"))
    rows = u.select("doc_id", F.lit(1).alias("page"), "seq", F.when(F.col("b"), "barrier").otherwise("paint").alias("kind"))
    return inventory.raise_units(rows).select("doc_id", "seq", "front_seq")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS nth, max(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY ALL), k AS (SELECT * FROM p WHERE abs(x - 25) > 5), g AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS piece FROM k), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, piece) AS n FROM g)
SELECT doc_id, nth, dense_rank() OVER (PARTITION BY doc_id ORDER BY piece)::INT AS piece FROM n WHERE n >= 2""")
def ink_erased(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("nth")).agg(F.max("l_quantity").alias("x"))
    pts = p.withColumn("page", F.lit(1)).withColumn("stroke", F.lit(1)).withColumn("y", F.lit(0.0))
    eraser = p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(25.0).alias("x"), F.lit(0.0).alias("y"))
    return inventory.erase_ink(pts, eraser, 5.0).select("doc_id", "nth", "piece")


@query("SELECT p_partkey, unnest(range(1, 3))::INT AS row, 'f' || p_partkey || '_' || unnest(range(1, 3)) || '_1' AS cell_name FROM part")
def field_grid(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"))
    return forms.grid(f, 2, 1, 2.0).select("p_partkey", "row", "cell_name")


@query("WITH p AS (SELECT l_orderkey // 3 AS doc_id, CASE WHEN l_orderkey % 5 > 0 THEN l_returnflag END AS o FROM lineitem) SELECT doc_id, CASE WHEN count(DISTINCT coalesce(o, '')) > 1 THEN 'mixed' ELSE coalesce(any_value(o), '') END AS tab_order FROM p GROUP BY 1")
def tab_orders(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 3").alias("doc_id"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_returnflag")).alias("tab_order"))
    return forms.tab_order(p).withColumn("tab_order", F.coalesce("tab_order", F.lit("")))


@query("SELECT p_partkey, list_aggregate(list_filter([CASE WHEN (p_partkey >> 2) & 1 = 1 THEN 'print' END, CASE WHEN (p_partkey >> 3) & 1 = 1 THEN 'modify' END, CASE WHEN (p_partkey >> 4) & 1 = 1 THEN 'copy' END, CASE WHEN (p_partkey >> 5) & 1 = 1 THEN 'annotate' END, CASE WHEN (p_partkey >> 8) & 1 = 1 THEN 'fill' END, CASE WHEN (p_partkey >> 9) & 1 = 1 THEN 'extract' END, CASE WHEN (p_partkey >> 10) & 1 = 1 THEN 'assemble' END, CASE WHEN (p_partkey >> 11) & 1 = 1 THEN 'print well' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS allowed FROM part")
def permission_names(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.array_join(inventory.permissions(F.col("p_partkey")), ",").alias("allowed"))
    return t.withColumn("allowed", F.nullif("allowed", F.lit("")))
