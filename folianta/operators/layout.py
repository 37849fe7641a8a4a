"""Styles, headings, lines, paragraphs and tables from positioned text items (doc_id, page, seq, str, x, y, size, width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import paged


def half_points(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def body_size(items: DataFrame) -> DataFrame:
    """(doc_id, body): the size with the most characters, the smaller of equal ones."""
    per = items.groupBy("doc_id", half_points(F.col("size")).alias("size")).agg(F.sum(F.length("str")).alias("n"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body"))


def page_styles(items: DataFrame, top: int = 12) -> DataFrame:
    """Styles of a page (doc_id, page, size, bold, characters, sample): the most used, with the first 40 characters."""
    per = items.groupBy("doc_id", "page", "size", "bold").agg(F.sum(F.length("str")).alias("characters"), F.min("seq").alias("first"), F.substring(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "str"))), 1, 40), lambda s: s["str"]), " "), 1, 40).alias("sample"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("characters"), "first"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top).drop("first")


def heading_levels(lines: DataFrame, body: DataFrame, factor: float = 1.15, levels: int = 6) -> DataFrame:
    """Lines (doc_id, page, seq, text, size) that are large enough for headings, with their level by size."""
    big = lines.join(body, "doc_id").where((F.col("size") >= F.col("body") * factor) & F.length("text").between(2, 200) & F.col("text").rlike(r"\p{L}"))
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return big.withColumn("level", level).where(F.col("level") <= levels).select("doc_id", "page", "seq", "text", "size", "level")


def merge_wrapped(lines: DataFrame, reach: float = 1.6) -> DataFrame:
    """Lines of one page and size that follow each other closely (baseline y, downwards) become one: (doc_id, page, seq, text, size, n)."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    gap = F.lag("y").over(w) - F.col("y")
    goes_on = (F.lag("size").over(w) == F.col("size")) & (gap > 0) & (gap <= F.col("size") * reach)
    runs = lines.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    return runs.groupBy("doc_id", "page", "_run").agg(F.min("seq").alias("seq"), F.array_join(parts, " ").alias("text"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")).drop("_run")


def merge_items(items: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Items to lines (doc_id, page, seq, size, y, text): an item goes on with the line while its size is equal and its baseline near the line's first one."""
    return merged_lines(paged.gathered(items, "seq", "str", "y", "size"), tolerance)


def merged_lines(pages: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """:func:`merge_items` for pages that hold their items (doc_id, page, items)."""
    return paged.inlined(pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), paged.merged(F.col("items"), tolerance).alias("_l")), F.col("_l"), "seq")


def page_layout(items: DataFrame) -> DataFrame:
    """Reading order of a page: (doc_id, page, line, y, text, cells). Words from top to bottom and left to right join the first line within half their size; wide gaps part cells."""
    return laid_pages(paged.gathered(items, *paged.KINDS))


def laid_pages(pages: DataFrame) -> DataFrame:
    """:func:`page_layout` for pages that hold their items (doc_id, page, items)."""
    return paged.inlined(pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), paged.laid(F.col("items")).alias("_l")), F.col("_l"), "line").drop("column")


def reading_order(items: DataFrame, widths: DataFrame) -> DataFrame:
    """Lines of pages in the order in which they are read, the left column before the right one: (doc_id, page, column, line, y, text, cells). ``widths``: doc_id, page, page_width."""
    pages = paged.gathered(items, *paged.KINDS).join(widths.select("doc_id", "page", "page_width"), ["doc_id", "page"], "left")
    return paged.inlined(read_pages(pages), F.col("lines"), "line")


def read_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, lines): pages that hold their items (doc_id, page, items, page_width) with their lines as :func:`reading_order` has them, as one list."""
    with_gutter = pages.withColumn("_gutter", paged.gutter(F.col("items"), F.col("page_width")))
    return with_gutter.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), paged.laid(F.col("items"), F.col("_gutter")).alias("lines"))


def read_texts(pages: DataFrame, places: paged.Places) -> DataFrame:
    """(doc_id, page, text): pages whose items are the words of a text (doc_id, page, text, page_width), at ``places``, in the order in which :func:`read_pages` has them, see :func:`paged.read`. Pages without words are left out before they are read: a test of what comes back would read them twice."""
    return pages.where(F.trim("text") != "").select(F.col("doc_id").cast("long"), F.col("page").cast("int"), paged.read(F.col("text"), F.col("page_width"), places).alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line, y, size, text) to paragraphs with a heading mark of 0, 1 or 2; a line that ends in a hyphen is joined without a space and keeps it."""
    sizes = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("size")).alias("s")).select("doc_id", F.get("s", F.floor((F.size("s") - 1) / 2).cast("int")).alias("body"))
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    prev, gap = F.lag("size").over(w), F.lag("y").over(w) - F.col("y")
    on = (F.abs(prev - F.col("size")) < 0.5) & (gap <= 1.8 * F.col("size"))
    marked = lines.withColumn("_n", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("_p", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    joined = F.aggregate(texts, F.lit(""), lambda t, x: F.when(t == "", x).when(t.endswith("-"), F.concat(t, x)).otherwise(F.concat(t, F.lit(" "), x)))
    out = marked.groupBy("doc_id", "page", "_p").agg(F.min("line").alias("line"), F.first("size").alias("size"), joined.alias("text")).join(sizes, "doc_id")
    return out.select("doc_id", "page", "line", "text", F.when(F.col("size") >= 1.6 * F.col("body"), 1).when(F.col("size") >= 1.25 * F.col("body"), 2).otherwise(0).alias("heading"))


def table_rows(cells: DataFrame, gap: float = 12.0, slack: float = 6.0) -> DataFrame:
    """Cells (doc_id, page, line, x, text) in columns: a new anchor where a cell begins more than ``gap`` after the last; a cell belongs to the last anchor at its x or before."""
    xs = F.array_sort(F.collect_set("x"))
    put = lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(F.concat(F.array(F.lit(-1e9)), a), -1) > gap), F.concat(a, F.array(x))).otherwise(a)
    anchors = cells.groupBy("doc_id", "page").agg(xs.alias("xs")).select("doc_id", "page", F.aggregate("xs", F.array().cast("array<double>"), put).alias("anchors"))
    return cells.join(anchors, ["doc_id", "page"]).withColumn("column", F.greatest(F.size(F.filter("anchors", lambda a: a <= F.col("x") + slack)) - 1, F.lit(0))).select("doc_id", "page", "line", "column", "text")


def ocr_words(tsv: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, seq, line: twelve tab-separated columns, the last one with what tabs it has) with their place in the image: doc_id, page, seq, nth (the line's number on its page), word, confidence (0 to 1), left, top, width, height.

    Rows of another level, without text, with a negative confidence or without an extent are left out; a line goes on while block, paragraph and line are equal.
    """
    c = F.split("line", "\t", 12)
    n = lambda i: F.get(c, F.lit(i)).try_cast("double")
    text = F.trim(F.get(c, F.lit(11)))
    rows = tsv.where(F.size(c) == 12).where((F.get(c, F.lit(0)) == "5") & (text != "") & (n(10) >= 0) & (n(8) > 0) & (n(9) > 0) & n(6).isNotNull() & n(7).isNotNull())
    key = F.concat_ws(":", F.get(c, F.lit(2)), F.get(c, F.lit(3)), F.get(c, F.lit(4)))
    words = rows.select("doc_id", "page", "seq", key.alias("_key"), text.alias("word"), F.least(n(10) / 100, F.lit(1.0)).alias("confidence"), n(6).alias("left"), n(7).alias("top"), n(8).alias("width"), n(9).alias("height"))
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    new = F.when(F.lag("_key").over(w).eqNullSafe(F.col("_key")), 0).otherwise(1)
    return words.withColumn("_n", new).withColumn("nth", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n", "_key")


def ocr_lines(tsv: DataFrame) -> DataFrame:
    """Recognised words (see :func:`ocr_words`) to lines: (doc_id, page, nth, text, confidence), the mean of the line's words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda s: s["word"]), " ")
    return ocr_words(tsv).groupBy("doc_id", "page", "nth").agg(text.alias("text"), F.avg("confidence").alias("confidence"))


def ocr_boxes(tsv: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page, nth, x, y, width, height): the box around each line's words as parts of the image (doc_id, page, image_width, image_height), from the lower left; words are cut to it."""
    part = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    w, h = F.col("image_width"), F.col("image_height")
    each = ocr_words(tsv).join(sizes, ["doc_id", "page"]).select("doc_id", "page", "nth", part(F.col("left") / w).alias("_x"), part(1 - (F.col("top") + F.col("height")) / h).alias("_y"), part(F.col("width") / w).alias("_w"), part(F.col("height") / h).alias("_h"))
    x, y = F.min("_x"), F.min("_y")
    return each.groupBy("doc_id", "page", "nth").agg(x.alias("x"), y.alias("y"), (F.max(F.col("_x") + F.col("_w")) - x).alias("width"), (F.max(F.col("_y") + F.col("_h")) - y).alias("height"))


def ocr_pages(tsv: DataFrame) -> DataFrame:
    """(doc_id, page, words, lines, confidence): the mean over all words of each page of the input; 0 for pages without any."""
    per = ocr_words(tsv).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("words"), F.max("nth").alias("lines"), F.avg("confidence").alias("confidence"))
    none = F.lit(0).cast("long")
    return tsv.select("doc_id", "page").distinct().join(per, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("words", none).alias("words"), F.coalesce("lines", none).alias("lines"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def markdown_line(text: Column, heading: Column) -> Column:
    body = tx.escape_markdown(F.trim(tx.collapse(text)))
    return F.when(heading > 0, F.concat(F.repeat(F.lit("#"), heading + 1), F.lit(" "), body)).otherwise(body)
