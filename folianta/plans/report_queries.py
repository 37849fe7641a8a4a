"""Queries over reports, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, compare, reports
from .registry import query, table

_LINES = """lines_ AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS flag, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)"""


def lines_of(spark, sf_dir):
    """A page for each line of an order."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    return t.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"), F.min("l_quantity").cast("long").alias("q"))


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, page, flag AS text, s % 4 AS annotations, p % 3 AS fonts, q AS images FROM lines_),
b AS (SELECT doc_id, page, CASE WHEN p % 17 = 0 THEN flag || '!' ELSE flag END AS text, s % 4 AS annotations, CASE WHEN p % 23 = 0 THEN 9 ELSE p % 3 END AS fonts, CASE WHEN p % 29 = 0 THEN q - 1 ELSE q END AS images FROM lines_ WHERE page < 7),
j AS (SELECT doc_id, page, a.page IS NOT NULL AS ia, b.page IS NOT NULL AS ib, a.text AS ta, b.text AS tb, a.annotations AS aa, b.annotations AS ab, a.fonts AS fa, b.fonts AS fb, a.images AS ma, b.images AS mb FROM a FULL JOIN b USING (doc_id, page)),
g AS (SELECT doc_id, count(*) FILTER (ia) AS na, count(*) FILTER (ib) AS nb, count(*) FILTER (ia AND ib AND ta <> tb) AS nt, coalesce(sum(ab), 0)::BIGINT AS an, coalesce(sum(fb), 0)::BIGINT AS fn, coalesce(sum(mb), 0)::BIGINT AS mn,
  bool_and(ia AND ib AND ta = tb) AS t, bool_and(ia AND ib AND aa = ab) AS x, bool_and(ia AND ib AND fa = fb) AS f, bool_and(ia AND ib AND ma = mb) AS m FROM j GROUP BY 1)
SELECT g.doc_id, unnest(['pages', 'text', 'annotations', 'fonts', 'images', 'fields', 'outlines', 'attachments']) AS "check", unnest([na = nb, t, x, f, m, o_custkey % 10 <> 3, o_custkey % 10 <> 4, true]) AS passed,
  unnest([nb, nt, an, fn, mn, o_custkey % 5 + (o_custkey % 10 = 3)::INT, (o_custkey % 2 = 1 OR o_custkey % 10 = 4)::BIGINT, o_custkey % 3]) AS number FROM g JOIN orders ON o_orderkey = g.doc_id""")
def fidelity_checks(spark, sf_dir):
    t, k = lines_of(spark, sf_dir), F.col("o_custkey")
    a = t.select("doc_id", "page", F.col("flag").alias("text"), (F.col("s") % 4).alias("annotations"), (F.col("p") % 3).alias("fonts"), F.col("q").alias("images"))
    b = t.where("page < 7").select("doc_id", "page", F.when(F.col("p") % 17 == 0, F.concat("flag", F.lit("!"))).otherwise(F.col("flag")).alias("text"), (F.col("s") % 4).alias("annotations"), F.when(F.col("p") % 23 == 0, 9).otherwise(F.col("p") % 3).alias("fonts"), F.when(F.col("p") % 29 == 0, F.col("q") - 1).otherwise(F.col("q")).alias("images"))
    o = table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey"))
    x = o.select("doc_id", (k % 5).alias("fields"), (k % 2 == 1).alias("outlines"), (k % 3).alias("attachments"))
    y = o.select("doc_id", (k % 5 + (k % 10 == 3).cast("int")).alias("fields"), ((k % 2 == 1) | (k % 10 == 4)).alias("outlines"), (k % 3).alias("attachments"))
    return reports.fidelity(a, b, x, y)


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, page AS nth, CASE WHEN s % 7 > 0 THEN p * 37 % 5000 END AS bytes, doc_id % 9000 AS source FROM lines_), r AS (SELECT *, coalesce(bytes < 1500, false) OR (source < 1500 AND nth = 1) AS fits FROM c)
SELECT doc_id, nth, bytes FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN nth END, bytes NULLS LAST, nth) = 1""")
def target_size(spark, sf_dir):
    t = lines_of(spark, sf_dir)
    return reports.small_enough(t.select("doc_id", F.col("page").alias("nth"), F.when(F.col("s") % 7 > 0, F.col("p") * 37 % 5000).alias("bytes"), (F.col("doc_id") % 9000).alias("source_bytes")), 1500)


_KINDS = ("glyph", "pixels", "image", "path", "annotation", "field", "form")


@query(f"""WITH m AS (SELECT l_orderkey // 20 AS doc_id, l_linenumber AS page, [{", ".join(f"'{k}'" for k in _KINDS)}][(l_partkey % 7 + 1)::INT] AS kind, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 = 1 END AS hidden FROM lineitem)
SELECT doc_id, count(DISTINCT page) FILTER (hidden IS DISTINCT FROM true) AS pages, count(*) FILTER (kind = 'glyph') AS glyphs, count(*) FILTER (kind = 'pixels') AS pixel_images, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'path') AS paths,
  count(*) FILTER (kind = 'annotation' AND hidden IS DISTINCT FROM true) AS annotations, count(*) FILTER (kind = 'field') AS form_fields, count(*) FILTER (kind = 'form') AS forms, count(*) FILTER (kind = 'annotation' AND hidden) AS hidden_annotations FROM m GROUP BY 1""")
def redaction_report(spark, sf_dir):
    t, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 3
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return reports.redaction_report(t.select(F.expr("l_orderkey div 20").alias("doc_id"), F.col("l_linenumber").alias("page"), kind.alias("kind"), F.when(s > 0, s == 1).alias("hidden")))


@query("""WITH h AS (SELECT l_suppkey AS doc_id, l_partkey * 7 % 256 AS bin, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY bin) AS below, sum(n) OVER (PARTITION BY doc_id) AS whole FROM h)
SELECT doc_id, coalesce(min(bin) FILTER (below > whole * 0.01::DOUBLE), 255)::INT AS low, coalesce(max(bin) FILTER (whole - below + n > whole * 0.01::DOUBLE), 0)::INT AS high, high > low AS stretches FROM s GROUP BY 1""")
def contrast_range(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") * 7 % 256).alias("bin")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return reports.contrast_range(h)


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""WITH c AS (SELECT user_id AS doc_id, event_id AS nth, event_type AS label, event_type || '<' AS status, props AS detail FROM events), r AS (SELECT doc_id, string_agg('<tr><th>' || {_ESC.format("label")} || '</th><td>' || {_ESC.format("status")} || '</td><td>' || {_ESC.format("coalesce(detail, '')")} || '</td></tr>', '' ORDER BY nth) AS rows FROM c GROUP BY 1)
SELECT r.doc_id, '<!doctype html><html lang="en"><meta charset="utf-8"><title>' || coalesce(nullif({_ESC.format("source")}, ''), 'Accessibility') || '</title><body><table><tbody>' || rows || '</tbody></table></body></html>' AS html FROM r LEFT JOIN documents d USING (doc_id)""")
def accessibility_page(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("nth"), F.col("event_type").alias("label"), F.concat("event_type", F.lit("<")).alias("status"), F.col("props").alias("detail"))
    return reports.accessibility_page(e, table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title")))


@query(f"""WITH {_LINES} SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="{reports.XFDF}" xml:space="preserve"><fields>' || coalesce(string_agg('<field name="f' || page || '"><value>' || flag || '&amp;</value><value>' || q || '</value></field>', '' ORDER BY page) FILTER (p % 5 > 0), '') || '</fields></xfdf>' AS xml FROM lines_ GROUP BY 1""")
def form_xfdf(spark, sf_dir):
    return reports.form_xfdf(_form(spark, sf_dir))


def _form(spark, sf_dir):
    t = lines_of(spark, sf_dir)
    return t.select("doc_id", F.col("page").alias("seq"), F.concat(F.lit("f"), "page").alias("name"), F.array(F.concat("flag", F.lit("&")), F.col("q").cast("string")).alias("values"), (F.col("p") % 5 == 0).alias("read_only"))


@query(f"""WITH {_LINES} SELECT doc_id, 'f' || page AS name, flag || '&|' || q AS joined FROM lines_ WHERE p % 5 > 0""")
def form_xfdf_values(spark, sf_dir):
    """What was written as XFDF, read again."""
    return reports.xfdf_values(reports.form_xfdf(_form(spark, sf_dir)).withColumnRenamed("xml", "body")).select("doc_id", "name", F.array_join("values", "|").alias("joined"))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, page, ['changed', 'unchanged', 'added', 'removed'][(p % 4 + 1)::INT] AS status, flag AS b, CASE WHEN s % 2 = 0 THEN flag ELSE flag || '.' END AS a FROM lines_)
SELECT doc_id, page, status, CASE WHEN status = 'changed' THEN CASE WHEN a = b THEN 'visual' ELSE 'text' END END AS kind FROM r WHERE status IN ('added', 'removed') OR (status = 'changed' AND a <> b)""")
def compare_listed(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("changed", "unchanged", "added", "removed"))), (F.col("p") % 4 + 1).cast("int"))
    t = lines_of(spark, sf_dir).select("doc_id", "page", status.alias("status"), F.col("flag").alias("before_text"), F.when(F.col("s") % 2 == 0, F.col("flag")).otherwise(F.concat("flag", F.lit("."))).alias("after_text"))
    return compare.listed(t, visual=False, only_changes=True).select("doc_id", "page", "status", "kind")


_ANNOTATIONS = ("Text", "Popup", "Link", "3D", "Square", "Movie")
_ACTIONS = ("GoTo", "Launch", "Named", "URI")
_NAMED = ("NextPage", "Print", "LastPage")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 20 AS doc_id, o_custkey AS c FROM orders), l AS (SELECT l_orderkey // 20 AS doc_id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS f FROM lineitem),
d AS (SELECT doc_id, max(c) AS c, min(k) AS k FROM o GROUP BY 1),
a AS (SELECT doc_id, ['Text', 'Popup', 'Link', '3D', 'Square', 'Movie'][(p % 6 + 1)::INT] AS t, s % 8 AS fl, CASE WHEN s % 3 = 0 THEN ['N'] WHEN s % 3 = 1 THEN ['N', 'D'] ELSE [] END AS st, p % 5 AS w, n FROM l),
x AS (SELECT doc_id, ['GoTo', 'Launch', 'Named', 'URI'][(p % 4 + 1)::INT] AS kind, ['NextPage', 'Print', 'LastPage'][(s % 3 + 1)::INT] AS named FROM l),
r AS (SELECT doc_id, unnest([CASE WHEN c % 7 = 0 THEN 'version' END, CASE WHEN c % 3 = 0 THEN 'file-id' END, CASE WHEN c % 5 = 0 THEN 'metadata' END, CASE WHEN c % 5 > 0 AND (c % 2 = 0) THEN 'identification' END, CASE WHEN c % 11 = 0 THEN 'javascript' END,
   CASE WHEN c % 13 = 0 THEN 'xfa' END, CASE WHEN c % 5 > 0 AND c % 4 > 0 THEN 'metadata-match' END, CASE WHEN c % 3 = 1 AND c % 2 = 1 THEN 'output-intent-colour' END, CASE WHEN c % 3 <> 1 AND c % 2 = 0 THEN 'cmyk' END, CASE WHEN c % 3 <> 1 THEN 'output-intent' END, CASE WHEN c % 6 > 0 THEN 'tagged' END, CASE WHEN c % 8 = 0 THEN 'language' END]) AS rule,
   unnest([true, true, true, true, true, true, true, false, false, c % 2 = 1, false, false]) AS fixable, unnest([NULL, NULL, NULL, NULL, NULL, NULL, 'Title', NULL, NULL, NULL, NULL, NULL]) AS example FROM d
 UNION ALL SELECT doc_id, unnest([CASE WHEN t IN ('3D', 'Movie') THEN 'annotation-types' END, CASE WHEN t <> 'Popup' AND (fl & 4 = 0 OR fl & 291 <> 0) THEN 'annotation-flags' END, CASE WHEN t <> 'Popup' AND list_contains(st, 'D') THEN 'appearance-states' END, CASE WHEN t NOT IN ('Popup', 'Link') AND w > 0 AND NOT list_contains(st, 'N') THEN 'annotation-appearance' END]),
   unnest([false, true, true, false]), 'page ' || n || ': ' || t FROM a
 UNION ALL SELECT doc_id, 'actions', true, CASE WHEN kind = 'Named' THEN kind || ' ' || named ELSE kind END FROM x WHERE kind = 'Launch' OR (kind = 'Named' AND named = 'Print')
 UNION ALL SELECT doc_id, unnest([CASE WHEN s % 4 = 0 THEN 'lzw' END, CASE WHEN p % 3 = 0 AND s % 2 = 0 THEN 'image-interpolation' END, CASE WHEN p % 3 = 0 AND n = 1 THEN 'image-alternates' END, CASE WHEN p % 3 = 2 OR (p % 3 = 1 AND n = 1) THEN 'postscript' END]), unnest([true, true, true, false]), NULL FROM l
 UNION ALL SELECT doc_id, unnest([CASE WHEN p % 2 = 1 AND s % 2 = 1 THEN 'fonts-embedded' END, CASE WHEN s % 5 > 0 AND (p % 2 = 0 OR n > 2) THEN 'fonts-unicode' END]), unnest([false, false]), 'F' || s FROM l
 UNION ALL SELECT doc_id, 'associated-files', true, 'file' || p FROM l WHERE s % 3 = 0 OR n = 2),
e AS (SELECT doc_id, rule, string_agg(example, ',' ORDER BY example) AS examples FROM (SELECT DISTINCT doc_id, rule, example FROM r WHERE rule IS NOT NULL AND example IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY doc_id, rule ORDER BY example) <= 5) GROUP BY ALL)
SELECT r.doc_id, r.rule, count(*) AS count, bool_and(fixable) AS fixable, any_value(examples) AS examples FROM r LEFT JOIN e ON e.doc_id = r.doc_id AND e.rule = r.rule WHERE r.rule IS NOT NULL GROUP BY ALL""")
def archive_rules(spark, sf_dir):
    """All archive rules at part 3, level A."""
    t = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 20").alias("doc_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    c, p, s, n = (F.col(x) for x in "cpsn")
    one = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    d = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 20").alias("doc_id")).agg(F.max("o_custkey").alias("c"))
    xmp = F.when(c % 4 == 0, "<dc:title>A &amp; B</dc:title>").otherwise("<dc:title>C</dc:title>")
    d = d.select(
        "doc_id", F.when(c % 7 == 0, "2.0").otherwise("1.7").alias("version"), (c % 3 > 0).alias("has_id"), F.when(c % 5 > 0, xmp).alias("xmp"), F.lit("3").alias("xmp_part"), F.when(c % 2 == 0, "b").otherwise("a").alias("xmp_level"),
        F.create_map(F.lit("Title"), F.lit(" A & B "), F.lit("Other"), F.lit("z")).alias("info"), F.lit(False).alias("additional_actions"), (c % 11 == 0).alias("javascript"), (c % 13 == 0).alias("xfa"), F.lit(None).cast("boolean").alias("need_appearances"), F.lit(False).alias("layers_bad"),
        (c % 2 == 0).alias("marked"), (c % 3 == 0).alias("structure"), F.when(c % 8 > 0, "en").alias("lang"), F.when(c % 3 == 1, 4).alias("intent"), (c % 2 == 1).alias("rgb"), (c % 2 == 0).alias("cmyk"), F.lit(False).alias("gray"),
    )
    kind = one(_ANNOTATIONS, p % 6)
    states = F.when(s % 3 == 0, F.array(F.lit("N"))).when(s % 3 == 1, F.array(F.lit("N"), F.lit("D"))).otherwise(F.array().cast("array<string>"))
    a = t.select("doc_id", F.concat(F.lit("page "), n, F.lit(": "), kind).alias("example"), kind.alias("subtype"), (s % 8).alias("flags"), states.alias("states"), (p % 5).alias("width"), F.lit(1).alias("height"), F.lit(False).alias("additional_actions"))
    x = t.select("doc_id", one(_ACTIONS, p % 4).alias("kind"), one(_NAMED, s % 3).alias("named"))
    streams = t.select("doc_id", one(("Image", "Form", "PS"), p % 3).alias("subtype"), F.array(F.when(s % 4 == 0, "LZWDecode").otherwise("FlateDecode")).alias("filters"), (s % 2 == 0).alias("interpolate"), F.array(F.when(n == 1, "OPI").otherwise("Length")).alias("keys"))
    fonts = t.select("doc_id", F.concat(F.lit("F"), s).alias("example"), F.when(p % 2 == 0, "Type0").otherwise("TrueType").alias("subtype"), (s % 2 == 0).alias("embedded"), (s % 5 == 0).alias("to_unicode"), F.lit(False).alias("symbolic"), (n <= 2).alias("named_encoding"))
    files = t.select("doc_id", F.concat(F.lit("file"), p).alias("example"), F.lit(False).alias("archive"), F.lit(True).alias("relationship"), F.when(s % 3 > 0, "text/plain").otherwise("text").alias("mime"), (n != 2).alias("unicode_name"), F.lit(True).alias("listed"))
    return archive.findings(archive.of_documents(d, 3, "A"), archive.of_annotations(a), archive.of_actions(x), archive.of_streams(streams), archive.of_fonts(fonts, "A"), archive.of_attachments(files, 3))
