"""Exports as lines of text: (key columns, line number, line), to be written with Spark's text sink, one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import Tables
from .layout import markdown_line


def plain_text(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's lines (doc_id, page, line, text) under a header with its number."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return lines.groupBy("doc_id", "page").agg(F.concat(F.format_string("--- Page %d ---\n", F.col("page")), body).alias("text"))


def plain_pages(pages: DataFrame) -> DataFrame:
    """:func:`plain_text` for pages that are one text already (doc_id, page, text)."""
    return pages.select("doc_id", "page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "text").alias("text"))


def csv_lines(rows: DataFrame, columns: list[str], rule=tx.csv_field) -> Column:
    """One CSV line of columns under a rule for fields."""
    return F.concat_ws(",", *[rule(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def write_csv(rows: DataFrame, columns: list[str], path: str, rule=tx.csv_field) -> None:
    """CSV files with a byte order mark and CRLF ends, as spreadsheets like them; no header but the first column names' line in a file of its own."""
    head = rows.sparkSession.createDataFrame([("\ufeff" + ",".join(columns),)], "value string")
    head.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    rows.select(csv_lines(rows, columns, rule).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")


def markdown_blocks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, line, block): paragraphs as escaped Markdown, blank ones left out."""
    block = markdown_line(F.col("text"), F.col("heading"))
    return paragraphs.select("doc_id", "page", "line", block.alias("block")).where(F.regexp_replace("block", "^#+ ", "") != "")


def html_blocks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, line, block): paragraphs as escaped HTML."""
    tag = F.when(F.col("heading") > 0, F.concat(F.lit("h"), F.col("heading") + 1)).otherwise("p")
    body = tx.escape_markup(F.trim(tx.collapse(F.col("text"))))
    return paragraphs.select("doc_id", "page", "line", F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">")).alias("block"))


def xml_pages(paragraphs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page, xml): a page element with its size to hundredths and its headings and paragraphs."""
    tag = F.when(F.col("heading") > 0, "heading").otherwise("paragraph")
    each = F.concat(F.lit("<"), tag, F.when(F.col("heading") > 0, F.concat(F.lit(' level="'), F.col("heading"), F.lit('"'))).otherwise(""), F.lit(">"), tx.escape_markup(F.col("text")), F.lit("</"), tag, F.lit(">"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", each.alias("x")))), lambda s: s["x"]), "")
    pages = paragraphs.groupBy("doc_id", "page").agg(body.alias("body")).join(sizes, ["doc_id", "page"])
    return pages.select("doc_id", "page", F.concat(F.format_string('<page number="%d" width="%.2f" height="%.2f">', F.col("page"), F.col("width"), F.col("height")), F.col("body"), F.lit("</page>")).alias("xml"))


def typed_cells(cells: DataFrame) -> DataFrame:
    """Cells (…, column, text) with their kind, number and spreadsheet column."""
    return cells.withColumn("kind", tx.cell_kind(F.col("text"))).withColumn("number", tx.cell_number(F.col("text"))).withColumn("letters", tx.column_letters(F.col("column")))


def spreadsheet_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page, line, xml): rows of a spreadsheet in XML, with sparse column numbers."""
    t = typed_cells(cells)
    value = F.when(t["kind"] == "text", F.concat(F.lit('<Data ss:Type="String">'), tx.escape_markup(F.col("text")), F.lit("</Data>"))).otherwise(F.concat(F.lit('<Data ss:Type="Number">'), F.regexp_replace(F.col("number").cast("string"), r"\.0$", ""), F.lit("</Data>")))
    cell = F.concat(F.format_string('<Cell ss:Index="%d">', F.col("column") + 1), value, F.lit("</Cell>"))
    return t.groupBy("doc_id", "page", "line").agg(F.concat(F.lit("<Row>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", cell.alias("x")))), lambda s: s["x"]), ""), F.lit("</Row>")).alias("xml"))


def bookmarks_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, body): bookmarks (doc_id, id, parent_id, seq, title, page) as nested JSON, children in the order of seq. Built from the deepest level up, one grouping a level; nodes without a way to the top are left out."""
    from .trees import OUTLINE_DEPTH, levels

    tables = Tables(nodes.sparkSession)
    rows = tables.keep(levels(nodes, OUTLINE_DEPTH))
    own = F.to_json(F.struct("title", "page"), {"ignoreNullFields": "false"})
    below = None
    for depth in range(rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], -1, -1):
        here = rows.where(F.col("depth") == depth).withColumn("_x", own)
        if below is not None:
            here = here.join(below, ["doc_id", "id"], "left").withColumn("_x", F.when(F.col("_kids").isNotNull(), F.concat(F.expr("left(_x, length(_x) - 1)"), F.lit(',"children":['), "_kids", F.lit("]}"))).otherwise(F.col("_x")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_x"))), lambda k: k["_x"]), ",").alias("_kids")
        below = tables.keep(here.groupBy("doc_id", F.col("parent_id").alias("id")).agg(joined))
    return below.select("doc_id", F.concat(F.lit('{"format":"bookmarks","version":1,"bookmarks":['), "_kids", F.lit("]}")).alias("body"))


def annotations_xfdf(marks: DataFrame) -> DataFrame:
    """(doc_id, body): marks (doc_id, seq, tag, page from 1, rect of four numbers, name, title, contents) as XFDF, for the five tags that :func:`sources.exchange.xfdf_marks` reads; marks of other tags and without four finite numbers are left out."""
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    finite = (F.size("rect") == 4) & ~F.exists("rect", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), tx.escape_markup(F.coalesce(value, F.lit(""))), F.lit('"'))
    one = F.concat(
        F.lit("<"), "tag", attribute("page", (F.col("page") - 1).cast("string")), attribute("rect", F.array_join(F.transform("rect", number), ",")), attribute("name", F.col("name")), attribute("title", F.col("title")),
        F.lit("><contents>"), tx.escape_markup(F.coalesce("contents", F.lit(""))), F.lit("</contents></"), "tag", F.lit(">"),
    )
    kept = marks.where(F.col("tag").isin("text", "highlight", "underline", "strikeout", "freetext") & finite & (F.col("page") >= 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("x")))), lambda s: s["x"]), "")
    return kept.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'), body, F.lit("</annots></xfdf>")).alias("body"))


def archive_manifest(parts: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, part, pages, file_name) from pages with a part; documents of more than ``most`` files are an error."""
    each = parts.groupBy("doc_id", "part").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count(F.lit(1)).alias("pages"))
    many = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > most
    name = F.when(F.col("a") == F.col("b"), F.concat(F.lit("page-"), F.col("a"))).otherwise(F.concat(F.lit("pages-"), F.col("a"), F.lit("-"), F.col("b")))
    name = F.when(many, F.raise_error(F.lit(f"more than {most} files"))).otherwise(name)
    return each.select("doc_id", "part", "pages", F.concat(name, F.lit(".pdf")).alias("file_name"))


def comparison_report(aligned: DataFrame, before: DataFrame, after: DataFrame, excerpt: int = 400) -> DataFrame:
    """Rows of a report: pages that differ with an excerpt of either side."""
    cut = lambda c: F.when(F.length(c) > excerpt, F.concat(F.substring(c, 1, excerpt), F.lit("…"))).otherwise(c)
    a = before.select("doc_id", F.col("page").alias("before_page"), cut(F.col("text")).alias("before"))
    b = after.select("doc_id", F.col("page").alias("after_page"), cut(F.col("text")).alias("after"))
    return aligned.where("status <> 'unchanged'").join(a, ["doc_id", "before_page"], "left").join(b, ["doc_id", "after_page"], "left")


def tokens(template: str, page: Column, total: Column, title: Column, author: Column, date: Column) -> Column:
    """A header or footer line of a page: its tokens replaced, in this order, as they are."""
    out = F.lit(template)
    for key, value in (("page", page), ("total", total), ("date", date), ("title", title), ("author", author)):
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
