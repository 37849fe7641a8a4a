"""Queries over small records of pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports, views
from ..sources import exchange
from .registry import query, table

_LIST = lambda names: ", ".join(repr(n) for n in names)
_STYLES = (*views.TRANSITIONS, "Odd", "None")


def _pick(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


@query(f"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), r AS (SELECT doc_id, page, [{_LIST(_STYLES)}][(p % 13 + 1)::INT] AS style, CASE WHEN s % 3 > 0 THEN s / 10 END AS d, s % 8 * 45 AS di, CASE WHEN p % 2 = 0 THEN 'V' WHEN p % 3 = 0 THEN 'X' END AS dm, CASE WHEN s % 2 = 0 THEN 'O' END AS m, CASE WHEN p % 5 > 0 THEN p % 7 - 2 END AS dur FROM p)
SELECT doc_id, page, style, coalesce(d, 1)::DOUBLE AS duration, CASE WHEN di % 90 = 0 AND di < 360 THEN di ELSE 0 END::INT AS direction, CASE WHEN dm = 'V' THEN 'V' ELSE 'H' END AS dimension, CASE WHEN m = 'O' THEN 'O' ELSE 'I' END AS motion, CASE WHEN dur >= 0 THEN dur END::DOUBLE AS advance_after FROM r WHERE style NOT IN ('Odd', 'None')""")
def page_transitions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, s = F.col("p"), F.col("s")
    rows = t.select("doc_id", "page", _pick(_STYLES, p).alias("style"), F.when(s % 3 > 0, s / 10).alias("d"), (s % 8 * 45).alias("di"), F.when(p % 2 == 0, "V").when(p % 3 == 0, "X").alias("dm"), F.when(s % 2 == 0, "O").alias("m"), F.when(p % 5 > 0, (p % 7 - 2).cast("double")).alias("dur"))
    return views.transitions(rows)


_LAYOUTS, _PANELS, _FITS = (*views.LAYOUTS, "Odd"), (*views.PANELS, ""), (*views.FITS, "FitR")


@query(f"""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k AS doc_id, CASE WHEN k % 7 = 6 THEN 'SinglePage' ELSE [{_LIST(_LAYOUTS)}][(k % 7 + 1)::INT] END AS layout, CASE WHEN c % 6 = 5 THEN 'UseNone' ELSE [{_LIST(_PANELS)}][(c % 6 + 1)::INT] END AS panel,
(CASE WHEN c % 9 - 1 BETWEEN 0 AND k % 5 THEN c % 9 ELSE 1 END)::INT AS page, CASE WHEN k % 4 = 3 THEN 'Fit' ELSE [{_LIST(_FITS)}][(k % 4 + 1)::INT] END AS fit, (CASE WHEN c % 4 > 0 THEN c % 4 * 50 ELSE 100 END)::DOUBLE AS zoom, k % 3 = 1 AS display_title, c % 3 = 1 AS right_to_left FROM d""")
def initial_views(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(k.alias("doc_id"), _pick(_LAYOUTS, k).alias("layout"), _pick(_PANELS, c).alias("panel"), (c % 9 - 1).alias("page_index"), _pick(_FITS, k).alias("fit"), (c % 4 / 2).alias("zoom"), F.when(k % 3 > 0, k % 3 == 1).alias("display_title"), F.when(c % 3 == 1, "R2L").when(c % 3 == 2, "L2R").alias("direction"), (k % 5 + 1).alias("pages"))
    return views.initial_view(d)


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), i AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_partkey % 2 = 0) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT d.k AS doc_id, CASE WHEN k % 4 < 2 THEN 'PDF/A-' || (c % 3 + 1) || CASE WHEN k % 4 = 0 THEN 'b' ELSE '' END END AS pdfa, CASE WHEN c % 5 = 0 THEN 'PDF/UA-1' END AS pdfua, CASE WHEN c % 7 = 0 THEN 'X-4' WHEN c % 7 = 1 THEN 'X-' || k % 9 END AS pdfx, coalesce(n, 0) AS intents, coalesce(m, 0) AS profiles FROM d LEFT JOIN i USING (k)""")
def declared_standards(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = (c % 3 + 1).cast("string")
    pdfa = F.when(k % 4 == 0, F.concat(F.lit('<x pdfaid:part="'), part, F.lit("\" pdfaid:conformance='B'/>"))).when(k % 4 == 1, F.concat(F.lit("<pdfaid:part> "), part, F.lit(" </pdfaid:part>"))).when(k % 4 == 2, '<x pdfaid:part=""/>')
    xmp = F.concat_ws("\n", pdfa, F.when(c % 5 == 0, "<pdfuaid:part>1</pdfuaid:part>"), F.when(c % 7 == 1, F.concat(F.lit('<y pdfxid:GTS_PDFXVersion = "X-'), k % 9, F.lit('"/>'))))
    d = table(spark, sf_dir, "orders").select(k.alias("doc_id"), xmp.alias("xmp"), F.when(c % 7 == 0, "X-4").when(c % 7 == 2, "").alias("pdfx"))
    i = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 2 == 0).alias("has_profile"))
    return views.declared_standards(d, i)


_HANDLES = ("nw", "n", "ne", "e", "se", "s", "sw", "w", "move")
_HELD = f"[{_LIST(_HANDLES)}][(p_partkey % 9 + 1)::INT]"


@query(f"""WITH b AS (SELECT p_partkey AS id, {_HELD} AS h, p_partkey % 40 AS x, p_size % 30 AS y, p_size % 17 + 1 AS w, p_partkey % 13 + 1 AS t, (p_partkey * 7 % 121 - 60) / 2 AS dx, (p_size * 11 % 81 - 40) / 4 AS dy FROM part),
c AS (SELECT *, CASE WHEN h = 'move' THEN greatest(0, least(64 - w, floor(x + dx + 0.5))) WHEN contains(h, 'w') THEN greatest(0, least(x + w - 1, floor(x + dx + 0.5))) ELSE x END AS l, CASE WHEN h = 'move' THEN greatest(0, least(48 - t, floor(y + dy + 0.5))) WHEN contains(h, 'n') THEN greatest(0, least(y + t - 1, floor(y + dy + 0.5))) ELSE y END AS o FROM b)
SELECT id, l::BIGINT AS x, o::BIGINT AS y, (CASE WHEN h = 'move' THEN w ELSE CASE WHEN contains(h, 'e') AND h <> 'move' THEN greatest(l + 1, least(64, floor(x + w + dx + 0.5))) ELSE x + w END - l END)::BIGINT AS width, (CASE WHEN h = 'move' THEN t ELSE CASE WHEN contains(h, 's') THEN greatest(o + 1, least(48, floor(y + t + dy + 0.5))) ELSE y + t END - o END)::BIGINT AS height FROM c""")
def crops_dragged(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    box = F.struct((k % 40).alias("x"), (s % 30).alias("y"), (s % 17 + 1).alias("width"), (k % 13 + 1).alias("height"))
    whole = lambda n: F.lit(n).cast("long")
    return table(spark, sf_dir, "part").select(k.alias("id"), views.dragged(box, _pick(_HANDLES, k), (k * 7 % 121 - 60) / 2, (s * 11 % 81 - 40) / 4, whole(64), whole(48)).alias("b")).select("id", "b.*")


@query("""SELECT o_custkey AS doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k) FILTER (t <> '') || chr(10) || chr(10), '') || '(' || count(*) || CASE WHEN count(*) = 1 THEN ' comment)' ELSE ' comments)' END AS text
FROM (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS t FROM orders) GROUP BY o_custkey""")
def comments_copied(spark, sf_dir):
    k = F.col("o_orderkey")
    return views.clipboard_text(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("seq"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("text")))


@query("SELECT user_id AS doc_id, event_id % 4 AS page, event_id AS seq, (row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) - 1)::INT * 18 AS \"offset\" FROM events")
def paste_offsets(spark, sf_dir):
    return views.paste_offsets(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("seq")))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, c_custkey % 20 AS doc_id, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
a AS (SELECT DISTINCT doc_id, r FROM c), b AS (SELECT DISTINCT doc_id, r, n FROM c), x AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) - 1 AS i FROM a), y AS (SELECT doc_id, r, n, row_number() OVER (PARTITION BY doc_id, r ORDER BY n DESC) - 1 AS i FROM b),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY k DESC) - 1 AS i FROM c)
SELECT doc_id, i::VARCHAR AS path, 'R "' || r || '"' AS title, NULL::INT AS page FROM x UNION ALL SELECT y.doc_id, x.i || '/' || y.i, 'N ' || y.n, (y.n + 1)::INT FROM y JOIN x USING (doc_id, r)
UNION ALL SELECT z.doc_id, x.i || '/' || y.i || '/' || z.i, c_name, CASE WHEN k % 3 > 0 THEN (k % 50 + 1)::INT END FROM z JOIN y ON y.doc_id = z.doc_id AND y.n = z.n JOIN x ON x.doc_id = z.doc_id AND x.r = z.r""")
def bookmarks_there_and_back(spark, sf_dir):
    """Bookmarks written as nested JSON and read again."""
    k, n, r = F.col("c_custkey"), F.col("c_nationkey"), F.col("n_regionkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == n).withColumn("doc_id", k % 20)
    name = lambda a, v: F.concat(F.lit(a), v.cast("string"))
    none = F.lit(None)
    top = c.select("doc_id", name("r", r).alias("id"), none.cast("string").alias("parent_id"), (-r).cast("long").alias("seq"), F.concat(F.lit('R "'), r, F.lit('"')).alias("title"), none.cast("int").alias("page")).distinct()
    mid = c.select("doc_id", name("n", n).alias("id"), name("r", r).alias("parent_id"), (-n).cast("long").alias("seq"), name("N ", n).alias("title"), (n + 1).cast("int").alias("page")).distinct()
    low = c.select("doc_id", name("c", k).alias("id"), name("n", n).alias("parent_id"), (-k).cast("long").alias("seq"), F.col("c_name").alias("title"), F.when(k % 3 > 0, k % 50 + 1).cast("int").alias("page"))
    back = exchange.bookmark_tree(exports.bookmarks_json(top.unionByName(mid).unionByName(low)), most=None, most_bytes=None)
    return back.where("error is null").select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "title", "page")


_TAGS = ("text", "highlight", "underline", "strikeout", "freetext", "ink")


@query(f"""SELECT l_orderkey AS doc_id, [{_LIST(_TAGS)}][(l_partkey % 6 + 1)::INT] AS tag, (l_linenumber % 9 + 1)::INT AS page, (l_partkey % 500)::DOUBLE AS x0, l_suppkey / 4 AS y1, 'm' || l_linenumber || '-' || l_partkey AS name
FROM lineitem WHERE l_partkey % 6 < 5 AND l_suppkey % 10 > 0 AND l_linenumber % 9 + 1 <= 5""")
def annotations_there_and_back(spark, sf_dir):
    """Annotations written as XFDF and read again for documents of five pages."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rect = F.array((p % 500).cast("double"), F.lit(1.5), F.lit(600.0), F.when(s % 10 > 0, s / 4))
    name = F.concat(F.lit("m"), n, F.lit("-"), p)
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), name.alias("seq"), _pick(_TAGS, p).alias("tag"), (n % 9 + 1).cast("int").alias("page"), rect.alias("rect"), name.alias("name"), F.lit('A & "B"').alias("title"), F.concat(F.lit("<b> "), "l_shipdate").alias("contents"))
    back = exchange.xfdf_marks(exports.annotations_xfdf(marks).withColumn("pages", F.lit(5)))
    return back.select("doc_id", "tag", "page", F.col("rect")[0].alias("x0"), F.col("rect")[3].alias("y1"), "name")
