"""Queries over drawing operators: the lines of twenty orders are the operators of a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import runs
from .registry import query, table

_OPS = ("save", "restore", "formBegin", "formEnd", "transform", "fill", "font", "font", "render", "beginText", "textMatrix", "showText", "showText", "showSpacedText", "save", "other")


def operators(spark, sf_dir):
    """(doc_id, page, seq, op, nums, str)"""
    t, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    rows = t.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").cast("long").alias("q"))
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((p * 7 + s * 3 + F.col("q") * 5) % 16 + 1).cast("int"))
    matrix = F.array(*(x.cast("double") for x in (F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), (p % 3 + 1).cast("int")), F.lit(0), F.lit(0), F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (s % 3 + 1).cast("int")), p % 50, s % 70)))
    nums = F.when(F.col("op").isin("transform", "textMatrix"), matrix).when(F.col("op") == "formBegin", F.when(p % 2 == 0, matrix).otherwise(F.array().cast("array<double>"))).when(F.col("op") == "font", F.array((s % 20 - 5).cast("double"))).when(F.col("op") == "render", F.array(F.when(p % 4 == 0, 3.0).otherwise(0.0))).otherwise(F.array().cast("array<double>"))
    text = F.when(F.col("op") == "font", F.when(p % 9 > 0, F.concat(F.lit("F"), p % 4))).when(F.col("op") == "fill", F.concat(F.lit("#00000"), s % 10)).when(F.col("op").startswith("show"), F.when(s % 8 > 0, F.concat(F.lit("t "), p)).otherwise("  "))
    placed = rows.withColumn("op", op).withColumn("doc_id", F.floor(F.col("k") / 20)).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "n")))
    return placed.select("doc_id", F.lit(1).alias("page"), "seq", "op", nums.alias("nums"), text.alias("str"))


_OPS_SQL = f"""g AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
o AS (SELECT *, k // 20 AS doc_id, row_number() OVER (PARTITION BY k // 20 ORDER BY k, n) AS seq, [{", ".join(f"'{x}'" for x in _OPS)}][((p * 7 + s * 3 + q * 5) % 16 + 1)::INT] AS op,
  [[1.0, 2.0, 0.5][(p % 3 + 1)::INT]::DOUBLE, 0, 0, [0.5, 1.0, 2.0][(s % 3 + 1)::INT]::DOUBLE, p % 50, s % 70]::DOUBLE[] AS m FROM g),
ops AS (SELECT doc_id, seq, op, CASE WHEN op <> 'formBegin' OR p % 2 = 0 THEN m ELSE [1, 0, 0, 1, 0, 0]::DOUBLE[] END AS m, CASE WHEN p % 9 > 0 THEN 'F' || p % 4 ELSE '' END AS font, abs(s % 20 - 5)::DOUBLE AS size, '#00000' || s % 10 AS fill,
  CASE WHEN p % 4 = 0 THEN 3 ELSE 0 END AS mode, CASE WHEN s % 8 > 0 THEN 't ' || p ELSE '  ' END AS str FROM o)"""
_TIMES = "[{a}[1] * {b}[1] + {a}[2] * {b}[3], {a}[1] * {b}[2] + {a}[2] * {b}[4], {a}[3] * {b}[1] + {a}[4] * {b}[3], {a}[3] * {b}[2] + {a}[4] * {b}[4], {a}[5] * {b}[1] + {a}[6] * {b}[3] + {b}[5], {a}[5] * {b}[2] + {a}[6] * {b}[4] + {b}[6]]"
_NOW = "{'c': w.c, 'font': w.font, 'size': w.size, 'fill': w.fill, 'mode': w.mode}"
_POPS = "(o.op IN ('restore', 'formEnd') AND len(w.stack) > 0)"


def _walk(rest: str) -> str:
    """One step of a walk over each page with its stack, one operator after another."""
    return f"""WITH RECURSIVE {_OPS_SQL},
w AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS c, '' AS font, 0::DOUBLE AS size, '#000000' AS fill, 0 AS mode, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS tm, []::STRUCT(c DOUBLE[], font VARCHAR, size DOUBLE, fill VARCHAR, mode INT)[] AS stack, '' AS op, '' AS str FROM ops
UNION ALL
SELECT w.doc_id, o.seq, CASE WHEN o.op IN ('transform', 'formBegin') THEN {_TIMES.format(a="o.m", b="w.c")} WHEN {_POPS} THEN w.stack[-1].c ELSE w.c END,
  CASE WHEN o.op = 'font' THEN o.font WHEN {_POPS} THEN w.stack[-1].font ELSE w.font END, CASE WHEN o.op = 'font' THEN o.size WHEN {_POPS} THEN w.stack[-1].size ELSE w.size END,
  CASE WHEN o.op = 'fill' THEN o.fill WHEN {_POPS} THEN w.stack[-1].fill ELSE w.fill END, CASE WHEN o.op = 'render' THEN o.mode WHEN {_POPS} THEN w.stack[-1].mode ELSE w.mode END,
  CASE WHEN o.op = 'beginText' THEN [1, 0, 0, 1, 0, 0]::DOUBLE[] WHEN o.op = 'textMatrix' THEN o.m ELSE w.tm END,
  CASE WHEN o.op IN ('save', 'formBegin') THEN list_append(w.stack, {_NOW}) WHEN {_POPS} THEN w.stack[:-2] ELSE w.stack END, o.op, o.str
FROM w JOIN ops o ON o.doc_id = w.doc_id AND o.seq = w.seq + 1),
seen AS (SELECT doc_id, 1 AS page, seq::INT AS seq, str, font, floor(size * sqrt((tm[3] * c[1] + tm[4] * c[3]) ** 2 + (tm[3] * c[2] + tm[4] * c[4]) ** 2) * 2 + 0.5) / 2 AS size, fill AS colour,
  tm[5] * c[1] + tm[6] * c[3] + c[5] AS x, tm[5] * c[2] + tm[6] * c[4] + c[6] AS y FROM w WHERE starts_with(op, 'show') AND mode <> 3 AND font <> '' AND trim(str) <> ''),
runs AS (SELECT * FROM seen WHERE size > 0) {rest}"""


@query(_walk("SELECT * FROM runs"))
def visible_runs(spark, sf_dir):
    return runs.visible_runs(operators(spark, sf_dir))


@query(_walk(""", g2 AS (SELECT doc_id, page, font, size, colour, sum(length(str))::BIGINT AS characters, min(seq) AS f FROM runs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY characters DESC, f)::INT AS rank FROM g2) SELECT doc_id, page, rank, font, size, colour, characters FROM r WHERE rank <= 12"""))
def run_styles(spark, sf_dir):
    return runs.styles(runs.visible_runs(operators(spark, sf_dir)))
