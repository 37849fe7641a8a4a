"""Queries over drawings: an order is a stream, its lines are what it draws, some of them later orders of its forty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import objects
from .registry import query, table

_DRAWN = """WITH RECURSIVE g AS (SELECT l_orderkey AS k, l_linenumber AS seq, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL),
i AS (SELECT k // 40 AS doc_id, k AS stream, seq, CASE p % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'form' ELSE 'text' END AS kind, CASE p % 4 WHEN 0 THEN 'i' || s % 12 WHEN 1 THEN CASE WHEN (k + seq * 5) // 40 = k // 40 THEN (k + seq * 5)::VARCHAR ELSE 'none' END END AS ref,
  [[1, 0, 0, 1], [0.5, 0, 0, 2], [0, 1, -1, 0], [-1, 0, 0, 0.5]][(s % 4 + 1)::INT]::DOUBLE[] AS a, (p % 50)::DOUBLE AS e, (s % 70)::DOUBLE AS f, q, CASE WHEN p % 4 > 1 AND s % 6 > 0 THEN 't' || p END AS text FROM g),
w AS (SELECT i.doc_id, o_orderkey AS page, [i.seq]::BIGINT[] AS path, i.kind, i.ref, i.text, i.a AS a, i.e AS e, i.f AS f, i.q FROM orders JOIN i ON i.stream = o_orderkey
UNION ALL SELECT w.doc_id, w.page, list_append(w.path, i.seq), i.kind, i.ref, i.text, [i.a[1] * w.a[1] + i.a[2] * w.a[3], i.a[1] * w.a[2] + i.a[2] * w.a[4], i.a[3] * w.a[1] + i.a[4] * w.a[3], i.a[3] * w.a[2] + i.a[4] * w.a[4]],
  i.e * w.a[1] + i.f * w.a[3] + w.e, i.e * w.a[2] + i.f * w.a[4] + w.f, i.q FROM w JOIN i ON w.kind = 'form' AND i.doc_id = w.doc_id AND i.stream::VARCHAR = w.ref),
d AS (SELECT *, [e, a[1] * q + e, a[3] * 10 + e, a[1] * q + a[3] * 10 + e] AS xs, [f, a[2] * q + f, a[4] * 10 + f, a[2] * q + a[4] * 10 + f] AS ys FROM w),
b AS (SELECT doc_id, page, path, kind, ref, text, list_min(xs) AS x0, list_min(ys) AS y0, list_max(xs) AS x1, list_max(ys) AS y1 FROM d)"""


def drawings(spark, sf_dir):
    """(pages, items)"""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("double").alias("q"))
    k, p, s = F.col("k"), F.col("p"), F.col("s")
    to = k + F.col("seq") * 5
    ref = F.when(p % 4 == 0, F.concat(F.lit("i"), s % 12)).when(p % 4 == 1, F.when(F.floor(to / 40) == F.floor(k / 40), to.cast("string")).otherwise("none"))
    turns = F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in ((1, 0, 0, 1), (0.5, 0, 0, 2), (0, 1, -1, 0), (-1, 0, 0, 0.5))))
    matrix = F.concat(F.element_at(turns, (s % 4 + 1).cast("int")), F.array((p % 50).cast("double"), (s % 70).cast("double")))
    kind = F.when(p % 4 == 0, "image").when(p % 4 == 1, "form").otherwise("text")
    items = g.select(F.floor(k / 40).alias("doc_id"), k.cast("string").alias("stream"), "seq", kind.alias("kind"), ref.alias("ref"), matrix.alias("matrix"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("q").alias("x1"), F.lit(10.0).alias("y1"), F.when((p % 4 > 1) & (s % 6 > 0), F.concat(F.lit("t"), p)).alias("text"))
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(o / 40).alias("doc_id"), o.alias("page"), o.cast("string").alias("stream")), items


@query(_DRAWN + " SELECT doc_id, page, array_to_string(path, '/') AS path, kind, ref, text, x0, y0, x1, y1, false AS cut FROM b")
def drawn_objects(spark, sf_dir):
    """All that pages draw, forms expanded."""
    d = objects.placed(*drawings(spark, sf_dir))
    return d.select("doc_id", "page", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "kind", "ref", "text", "box.x0", "box.y0", "box.x1", "box.y1", "cut")


@query(_DRAWN + """, u AS (SELECT doc_id, ref, count(DISTINCT page) > 1 AS wide FROM b WHERE kind = 'image' GROUP BY ALL), h AS (SELECT doc_id, page, ref, count(*) > 1 AS twice FROM b WHERE kind = 'image' AND len(path) = 1 GROUP BY ALL)
SELECT b.doc_id, b.page, b.path[1] AS seq, kind, b.text, b.ref, x0, y1, CASE WHEN kind = 'image' THEN p_size END AS pixel_width, kind = 'image' AND (coalesce(wide, false) OR coalesce(twice, false)) AS shared
FROM b LEFT JOIN u ON u.doc_id = b.doc_id AND u.ref = b.ref LEFT JOIN h ON h.doc_id = b.doc_id AND h.page = b.page AND h.ref = b.ref LEFT JOIN part ON p_partkey = b.doc_id * 12 + substring(b.ref, 2)::BIGINT AND b.kind = 'image' WHERE len(path) = 1 AND kind <> 'form' AND (kind <> 'text' OR b.text IS NOT NULL)""")
def object_inventory(spark, sf_dir):
    """What pages draw themselves, with shared images."""
    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(F.floor(k / 12).alias("doc_id"), F.concat(F.lit("i"), k % 12).alias("ref"), F.col("p_size").alias("width"), F.col("p_size").alias("height"))
    return objects.inventory(objects.placed(*drawings(spark, sf_dir)), images).select("doc_id", "page", "seq", "kind", "text", "ref", "box.x0", "box.y1", "pixel_width", "shared")
