"""Queries over values, exports, exchange sources and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import exports, layout
from ..sources import exchange
from ..streaming import pages as stream
from .registry import PAGES, pages, query, table

_CELLS = """cells_ AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '=SUM(' || p_size || ')' WHEN 1 THEN '-' || p_size WHEN 2 THEN '(1,' || lpad(p_size::VARCHAR, 3, '0') || '.5)' WHEN 3 THEN '2024-02-' || lpad((p_size % 31 + 1)::VARCHAR, 2, '0') WHEN 4 THEN 'a,"' || p_size ELSE ' @' || p_name END AS t FROM part)"""


def _cells(spark, sf_dir):
    k, s = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit("=SUM("), s, F.lit(")"))).when(k == 1, F.concat(F.lit("-"), s)).when(k == 2, F.concat(F.lit("(1,"), F.lpad(s, 3, "0"), F.lit(".5)"))).when(k == 3, F.concat(F.lit("2024-02-"), F.lpad((F.col("p_size") % 31 + 1).cast("string"), 2, "0"))).when(k == 4, F.concat(F.lit('a,"'), s)).otherwise(F.concat(F.lit(" @"), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))


@query(f"""WITH {_CELLS} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '''' || t WHEN 2 THEN '"' || t || '"' WHEN 4 THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS k1,
  '"' || replace(CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN '''' || t ELSE t END, '"', '""') || '"' AS k2, CASE p_partkey % 6 WHEN 0 THEN '''' || t WHEN 2 THEN '"' || t || '"' WHEN 4 THEN '"' || replace(t, '"', '""') || '"' WHEN 5 THEN '''' || t ELSE t END AS k3 FROM cells_""")
def csv_safe(spark, sf_dir):
    t = F.col("t")
    return _cells(spark, sf_dir).select("p_partkey", tx.csv_field(t).alias("k1"), tx.csv_form_field(t).alias("k2"), tx.csv_search_field(t).alias("k3"))


@query(f"""WITH {_CELLS} SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 AND try_cast(t AS DATE) IS NOT NULL THEN 'date' WHEN p_partkey % 6 IN (1, 2) THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN p_partkey % 6 = 3 THEN date_diff('day', DATE '1899-12-30', try_cast(t AS DATE))::DOUBLE WHEN p_partkey % 6 = 1 THEN t::DOUBLE WHEN p_partkey % 6 = 2 THEN -(replace(replace(replace(t, '(', ''), ')', ''), ',', ''))::DOUBLE END AS number FROM cells_""")
def cell_types(spark, sf_dir):
    t = F.col("t")
    return _cells(spark, sf_dir).select("p_partkey", tx.cell_kind(t).alias("kind"), tx.cell_number(t).alias("number"))


@query(rf"""WITH {PAGES}, p AS (SELECT doc_id, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM pages_), e AS (SELECT doc_id, page, regexp_replace(t, '([\\`*_\[\]<>|~&!])', '\\\1', 'g') AS t FROM p WHERE t <> '')
SELECT doc_id, page, CASE WHEN page % 3 > 0 THEN repeat('#', page % 3 + 1) || ' ' ELSE '' END || regexp_replace(regexp_replace(t, '^(\s*)([#>+=-])', '\1\\\2'), '^(\s*\d+)([.)])', '\1\\\2') AS block FROM e""")
def markdown_export(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("heading", F.col("page") % 3).withColumn("line", F.lit(1))
    return exports.markdown_blocks(p).select("doc_id", "page", "block")


@query(f"""WITH {PAGES} SELECT doc_id, page, CASE page % 3 WHEN 0 THEN '<p>' WHEN 1 THEN '<h2>' ELSE '<h3>' END || replace(replace(replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || CASE page % 3 WHEN 0 THEN '</p>' WHEN 1 THEN '</h2>' ELSE '</h3>' END AS block FROM pages_""")
def html_export(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("heading", F.col("page") % 3).withColumn("line", F.lit(1))
    return exports.html_blocks(p).select("doc_id", "page", "block")


@query(f"WITH {PAGES} SELECT doc_id, ((page - 1) // 5 + 1)::INT AS page, '--- Page ' || ((page - 1) // 5 + 1) || ' ---' || chr(10) || string_agg(text, chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc_id, (page - 1) // 5")
def text_export(spark, sf_dir):
    p = pages(spark, sf_dir)
    return exports.plain_text(p.select("doc_id", F.expr("cast((page - 1) div 5 + 1 as int)").alias("page"), F.col("page").alias("line"), "text"))


@query()
def xml_export(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("heading", (F.col("page") % 3).cast("int")).withColumn("line", F.lit(1))
    sizes = p.select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return exports.xml_pages(p, sizes)


@query(f"""WITH {PAGES}, l AS (SELECT doc_id, ((page - 1) // 10 + 1)::INT AS page, page AS line, (720 - 14 * ((page - 1) % 10))::DOUBLE AS y, 9.0::DOUBLE + 4 * (length(text) % 3 = 0)::INT AS size, text FROM pages_),
b AS (SELECT doc_id, list_sort(list(size))[(count(*) - 1) // 2 + 1] AS body FROM l GROUP BY 1),
n AS (SELECT *, CASE WHEN abs(lag(size) OVER w - size) < 0.5 AND lag(y) OVER w - y <= 1.8 * size THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line) AS p FROM n),
s AS (SELECT *, CASE WHEN coalesce(sum(length(text)) OVER (PARTITION BY doc_id, page, p ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN '' WHEN lag(text) OVER (PARTITION BY doc_id, page, p ORDER BY line) LIKE '%-' THEN '' ELSE ' ' END AS gap FROM r)
SELECT doc_id, page, min(line)::INT AS line, string_agg(gap || text, '' ORDER BY line) AS text, CASE WHEN min(size) >= 1.6 * min(body) THEN 1 WHEN min(size) >= 1.25 * min(body) THEN 2 ELSE 0 END AS heading FROM s JOIN b USING (doc_id) GROUP BY doc_id, page, p""")
def paragraph_merge(spark, sf_dir):
    p = pages(spark, sf_dir)
    lines = p.select("doc_id", F.expr("cast((page - 1) div 10 + 1 as int)").alias("page"), F.col("page").alias("line"), (720 - 14 * ((F.col("page") - 1) % 10)).cast("double").alias("y"), (F.lit(9.0) + 4.0 * (F.length("text") % 3 == 0).cast("int")).alias("size"), "text")
    return layout.paragraphs(lines)


@query("""WITH a AS (SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+02''00''' END AS d, o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS t FROM orders)
SELECT o_orderkey, epoch(t)::BIGINT AS instant FROM a""")
def pdf_date(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    d = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+02'00'"))
    return t.select("o_orderkey", F.unix_timestamp(tx.pdf_date(d)).alias("instant"))


_URLS = "u_ AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' https://ex.org/' || c_custkey WHEN 1 THEN 'javascript:x' || c_custkey WHEN 2 THEN 'mailto:a@b.c' WHEN 3 THEN 'me' || c_custkey || '@mail.example' WHEN 4 THEN 'ftp://x' ELSE 'HTTP://Y.org' END AS u FROM customer)"


@query(f"WITH {_URLS} SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN trim(u) WHEN 2 THEN u WHEN 3 THEN 'mailto:' || u WHEN 5 THEN 'http://y.org/' END AS url FROM u_")
def safe_url(spark, sf_dir):
    k = F.col("c_custkey")
    u = F.when(k % 6 == 0, F.concat(F.lit(" https://ex.org/"), k)).when(k % 6 == 1, F.concat(F.lit("javascript:x"), k)).when(k % 6 == 2, "mailto:a@b.c").when(k % 6 == 3, F.concat(F.lit("me"), k, F.lit("@mail.example"))).when(k % 6 == 4, "ftp://x").otherwise("HTTP://Y.org")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.safe_url(u).alias("url"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'attachment.bin' WHEN 1 THEN 'x' || c_custkey || '.pdf' WHEN 2 THEN 'a_b' || c_custkey ELSE 'c' || c_custkey || 'd' END AS name FROM customer""")
def attachment_name(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, "../..").when(k % 4 == 1, F.concat(F.lit("C:\\dir/..x"), k, F.lit(".pdf."))).when(k % 4 == 2, F.concat(F.lit(".a?:b"), k)).otherwise(F.concat(F.lit("c"), k, F.lit("\u202e...d")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.attachment_name(n).alias("name"))


@query("""SELECT s_suppkey, trim(left(trim(regexp_replace(replace('Field ' || s_name || '  of', '.', ' '), ' +', ' ', 'g')), 40)) AS name FROM supplier""")
def label_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.label_name(F.concat(F.lit("Field "), F.col("s_name"), F.lit(" __ of: ??"))).alias("name"))


@query("""SELECT p_partkey, CASE WHEN n < 26 THEN chr((65 + n)::INT) WHEN n < 702 THEN chr((65 + (n - 26) // 26)::INT) || chr((65 + (n - 26) % 26)::INT) ELSE chr((65 + (n - 702) // 676)::INT) || chr((65 + (n - 702) % 676 // 26)::INT) || chr((65 + (n - 702) % 26)::INT) END AS letters FROM (SELECT p_partkey, p_partkey % 5000 AS n FROM part)""")
def column_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.column_letters(F.col("p_partkey") % 5000).alias("letters"))


@query("""SELECT p_partkey, ((p_size * 90 - 180) % 360 + 360) % 360 AS turn, CASE WHEN p_size = 25 THEN 'Square' WHEN p_size > 25 THEN 'Landscape' ELSE 'Portrait' END AS orientation FROM part""")
def page_orientation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geo.turn(F.col("p_size") * 90 - 180).alias("turn"), geo.orientation(F.col("p_size"), F.lit(25)).alias("orientation"))


@query("""SELECT p_partkey, round((2.0 * (3 + p_size) + 5)::DOUBLE, 6) AS x, round((0.5 * (1 + 2 * p_size) - 1)::DOUBLE, 6) AS y FROM part""")
def matrix_points(spark, sf_dir):
    s = F.col("p_size").cast("double")
    m = geo.matrix_multiply(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(5.0), F.lit(-1.0)))
    p = geo.matrix_apply(m, s, 2 * s)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("SELECT s_suppkey AS doc_id, unnest(['a', 'b']) AS name, unnest(['1', 'two ' || s_suppkey]) AS value, NULL::VARCHAR AS error FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL, 'not form data' FROM supplier WHERE s_suppkey % 5 = 0")
def form_json(spark, sf_dir):
    k = F.col("s_suppkey")
    good = F.concat(F.lit('{"format":"form-data","version":1,"fields":[{"name":"a","type":"text","value":"1"},{"name":"b","type":"text","value":"two '), k, F.lit('"}]}'))
    files = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.when(k % 5 == 0, "{}").otherwise(good).alias("body"))
    return exchange.form_values(files).select("doc_id", "name", "value", "error")


@query("SELECT s_suppkey AS doc_id, 'c' AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'no such page' WHEN s_suppkey % 7 = 0 THEN 'unknown type' END AS error FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey, 'c', 'unknown type' FROM supplier WHERE s_suppkey % 28 = 0")
def comment_json(spark, sf_dir):
    k = F.col("s_suppkey")
    body = F.concat(F.lit('{"format":"document-comments","version":2,"pages":5,"comments":[{"id":"c","page":'), F.when(k % 4 == 0, 9).otherwise(2), F.lit(',"type":"'), F.when(k % 7 == 0, "Sound").otherwise("Text"), F.lit('","text":"t","rect":[0,0,1,1]}]}'))
    return exchange.comments(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit(5).alias("pages"), body.alias("body"))).select("doc_id", "id", "error")


@query("SELECT s_suppkey AS doc_id, 'highlight' AS tag, (s_suppkey % 4 + 1)::INT AS page, 'n' || s_suppkey AS name FROM supplier WHERE s_suppkey % 4 < 3")
def xfdf_source(spark, sf_dir):
    k = F.col("s_suppkey")
    body = F.concat(F.lit('<xfdf><annots><highlight page="'), k % 4, F.lit('" rect="1,2,3,4" name="n'), k, F.lit('"/></annots></xfdf>'))
    return exchange.xfdf_marks(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit(3).alias("pages"), body.alias("body"))).select("doc_id", "tag", "page", "name")


@query()
def text_to_pages(spark, sf_dir):
    return exchange.text_pages(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return stream.activity(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events"))
