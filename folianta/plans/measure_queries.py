"""Queries over measured texts: wrapped lines, rectangles of ranges, the shape of copied text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measure
from .registry import PAGES, pages, query, table

SIZE, MOST = 10.0, 300.0
_W = f"coalesce(CASE WHEN ascii(ch) BETWEEN 32 AND 126 THEN [{', '.join(map(str, measure.SANS))}][ascii(ch) - 31] END, {measure.OTHER})"


@query(f"""WITH RECURSIVE {PAGES}, k AS (SELECT row_number() OVER () AS id, doc_id, page, text, length(text) AS n FROM pages_),
c AS (SELECT id, unnest(range(1, n + 1)) AS i, unnest(string_split(text, '')) AS ch FROM k WHERE n > 0),
s AS (SELECT id, i, ch, sum({_W}) OVER o AS s, coalesce(max(CASE WHEN NOT regexp_matches(ch, '\\s') THEN i END) OVER o, 0) AS ink FROM c WINDOW o AS (PARTITION BY id ORDER BY i)),
u AS (SELECT s.id, s.i, s.ch, s.s, coalesce(t.s, 0) AS trimmed FROM s LEFT JOIN s t ON t.id = s.id AND t.i = s.ink),
e AS (SELECT id, trimmed, max(i) AS i FROM u JOIN k USING (id) WHERE ch = ' ' OR u.i = k.n GROUP BY ALL), f AS (SELECT id, trimmed, max(i) AS i FROM u GROUP BY ALL),
p AS (SELECT id, i - 1 AS start, s - {_W} AS base FROM u),
q AS (SELECT p.id, p.start, p.base, e.i AS word FROM p ASOF LEFT JOIN e ON e.id = p.id AND p.base + {MOST * 1000 / SIZE} >= e.trimmed),
r AS (SELECT q.id, q.start, CASE WHEN q.word > q.start THEN q.word ELSE -greatest(q.start + 1, coalesce(f.i, 0)) END AS stop FROM q ASOF LEFT JOIN f ON f.id = q.id AND q.base + {MOST * 1000 / SIZE} >= f.trimmed),
l AS MATERIALIZED (SELECT id, list(stop ORDER BY start) AS stops FROM r GROUP BY id),
w AS (SELECT id, 0::BIGINT AS start, 0::BIGINT AS stop, 0 AS nth FROM k UNION ALL
  SELECT w.id, abs(w.stop), coalesce(l.stops[abs(w.stop) + 1], 0), w.nth + 1 FROM w JOIN k ON k.id = w.id LEFT JOIN l ON l.id = w.id WHERE abs(w.stop) < k.n OR w.nth = 0)
SELECT k.doc_id, k.page AS seq, w.nth::INT AS nth, CASE WHEN w.stop < 0 THEN k.text[w.start + 1:-w.stop] ELSE regexp_replace(k.text[w.start + 1:w.stop], '\\s+$', '') END AS line FROM w JOIN k ON k.id = w.id WHERE w.nth > 0""")
def wrapped_lines(spark, sf_dir):
    """Each line of a document's text within 300 points at size 10."""
    return measure.wrapped(pages(spark, sf_dir).select("doc_id", F.col("page").alias("seq"), "text"), SIZE, MOST)


@query(f"""WITH p AS (SELECT p_partkey AS id, p_name AS t, p_size AS s, p_partkey % 4 AS turn, length(p_name) AS n, 10.0 + p_size AS width FROM part),
m AS (SELECT *, [[1, 0, 0, 1], [0, 2, -2, 0], [-1, 0, 0, -1], [0.6, 0.8, -0.8, 0.6]][(turn + 1)::INT]::DOUBLE[] AS a, list_transform(string_split(t, ''), lambda ch: {_W}) AS w, s % 3 AS x, least(s % 3 + 5, n) AS y FROM p),
o AS (SELECT *, list_sum(w)::DOUBLE AS whole, sqrt(a[1] * a[1] + a[2] * a[2]) AS k, sqrt(a[3] * a[3] + a[4] * a[4]) AS h FROM m),
d AS (SELECT *, coalesce(list_sum(w[:x]), 0) / whole * width - 0.35 * width / n AS b, coalesce(list_sum(w[:y]), 0) / whole * width + 0.35 * width / n AS e, a[1] / k AS ux, a[2] / k AS uy FROM o),
g AS (SELECT *, unnest([b, b, e, e]) AS q, unnest([-0.3, 1.1, -0.3, 1.1]) * h AS v FROM d)
SELECT id, min(id % 90 + ux * q - uy * v) AS x0, min(s + uy * q + ux * v) AS y0, max(id % 90 + ux * q - uy * v) AS x1, max(s + uy * q + ux * v) AS y1 FROM g GROUP BY id""")
def measured_rects(spark, sf_dir):
    """Boxes of a few characters of each name, in four directions."""
    k, s = F.col("p_partkey"), F.col("p_size")
    turns = F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in ((1, 0, 0, 1), (0, 2, -2, 0), (-1, 0, 0, -1), (0.6, 0.8, -0.8, 0.6))))
    matrix = F.concat(F.element_at(turns, (k % 4 + 1).cast("int")), F.array((k % 90).cast("double"), s.cast("double")))
    start = (s % 3).cast("int")
    box = measure.range_rect(matrix, F.col("p_name"), 10.0 + s, start, F.least(start + 5, F.length("p_name")))
    return table(spark, sf_dir, "part").select(k.alias("id"), box.alias("r")).select("id", "r.x0", "r.y0", "r.x1", "r.y1")


_FAMILIES = ("Serif", "", "A \"b\" <c>, sans-serif", "Mono")


@query(f"""WITH RECURSIVE g AS (SELECT l_orderkey // 10 AS doc_id, l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::BIGINT AS q, min(l_shipdate)::VARCHAR AS d FROM lineitem GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, n) AS seq FROM g),
e AS (SELECT doc_id, seq, seq // 12 AS page, (sum(CASE p % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 48 WHEN 3 THEN 56 ELSE 60 + s % 80 END) OVER (PARTITION BY doc_id, seq // 12 ORDER BY seq) - CASE WHEN p % 31 = 0 THEN 400 ELSE 0 END) / 4 AS top,
  d || CASE WHEN p % 7 = 0 THEN ' <&"' ELSE '' END AS text, CASE WHEN s % 4 > 0 THEN q / 4 ELSE 0 END AS size, [{", ".join(repr(f) for f in _FAMILIES)}][(p % 4 + 1)::INT] AS family FROM h),
w AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, -1::BIGINT AS page, 0.0::DOUBLE AS top, 0.0::DOUBLE AS pitch, 0 AS line, 0 AS par, NULL::VARCHAR AS span FROM e UNION ALL
SELECT e.doc_id, e.seq, e.page, CASE WHEN same THEN w.top ELSE e.top END, CASE WHEN NOT same AND NOT new AND e.seq > 1 THEN CASE WHEN w.pitch > 0 THEN least(w.pitch, e.top - w.top) ELSE e.top - w.top END ELSE w.pitch END,
  w.line + CASE WHEN same THEN 0 ELSE 1 END, w.par + CASE WHEN new AND e.seq > 1 THEN 1 ELSE 0 END,
  CASE WHEN style <> '' THEN '<span style="' || style || '">' || txt || '</span>' ELSE txt END
FROM (SELECT w.*, w.page = e2.page AND abs(e2.top - w.top) < 0.6 AS same, NOT (w.page = e2.page AND abs(e2.top - w.top) < 0.6) AND (w.page <> e2.page OR e2.top - w.top < 0 OR (w.pitch > 0 AND e2.top - w.top > w.pitch * 1.6)) AS new FROM w JOIN e e2 ON e2.doc_id = w.doc_id AND e2.seq = w.seq + 1) w
JOIN (SELECT *, concat_ws(';', CASE WHEN size > 0 THEN 'font-size:' || regexp_replace((floor(size * 10 + 0.5) / 10)::DECIMAL(12, 1)::VARCHAR, '\\.0$', '') || 'pt' END, CASE WHEN family <> '' THEN 'font-family:' || regexp_replace(family, '[^\\w\\s,''-]', '', 'g') END) AS style,
  replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS txt FROM e) e ON e.doc_id = w.doc_id AND e.seq = w.seq + 1),
l AS (SELECT doc_id, par, line, string_agg(span, '' ORDER BY seq) AS html FROM w WHERE seq > 0 GROUP BY ALL), p AS (SELECT doc_id, par, '<p>' || string_agg(html, '<br>' ORDER BY line) || '</p>' AS html FROM l GROUP BY ALL)
SELECT doc_id, string_agg(html, chr(10) ORDER BY par) AS html FROM p GROUP BY doc_id""")
def copied_html(spark, sf_dir):
    """The shape of ten orders' lines, as if they were selected on pages."""
    t = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.expr("l_orderkey div 10")).groupBy("doc_id", F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    g = t.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q"), F.min("l_shipdate").cast("string").alias("d"))
    p, s = F.col("p"), F.col("s")
    h = g.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "n"))).withColumn("page", F.expr("seq div 12"))
    step = F.when(p % 5 == 0, 0).when(p % 5 == 1, 2).when(p % 5 == 2, 48).when(p % 5 == 3, 56).otherwise(60 + s % 80)
    top = (F.sum(step).over(Window.partitionBy("doc_id", "page").orderBy("seq")) - F.when(p % 31 == 0, 400).otherwise(0)) / 4
    text = F.concat("d", F.when(p % 7 == 0, ' <&"').otherwise(""))
    family = F.element_at(F.array(*map(F.lit, _FAMILIES)), (p % 4 + 1).cast("int"))
    return measure.copied_html(h.select("doc_id", "seq", "page", top.alias("top"), text.alias("text"), F.when(s % 4 > 0, F.col("q") / 4).otherwise(0.0).alias("size"), family.alias("family")))
