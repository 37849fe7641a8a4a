"""Structure, destinations, styles and properties of documents: what readers, checks and exports ask of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paged, tagged

# Subtypes of annotations that are comments.
COMMENTS = ("Text", "Highlight", "Underline", "StrikeOut", "Square", "Circle", "Line", "PolyLine", "Polygon", "Stamp")
STYLES = ("search", "compare", "spaced", "filled")


def structure_checks(tags: DataFrame) -> DataFrame:
    """(doc_id, check, bad): how many tags (doc_id, id, parent_id, seq, role, alt, actual_text) break each rule of headings, lists, tables and alternate texts."""
    return rules_of(tagged.looked_at(tags))


def rules_of(looked: DataFrame) -> DataFrame:
    """(doc_id, check, bad) of documents as :func:`tagged.looked_at` gives them."""
    return looked.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("bad")) for n in tagged.RULES))))


def accessibility_checks(documents: DataFrame, pages: DataFrame, fields: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, check, status) of twelve checks: passed, failed, warning or manual.

    documents (doc_id, tagged, figures, figures_without, title, display_title, lang, permissions, outlines), pages (doc_id, page, text, annotations, tabs), fields (doc_id, name, tooltip), links (doc_id, description).
    """
    bare = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    p = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"), F.count_if(bare("text")).alias("_bare"), F.count_if((F.col("annotations") > 0) & ~F.col("tabs").eqNullSafe(F.lit("S"))).alias("_tabs"))
    f = fields.groupBy("doc_id").agg(F.count_if(bare("tooltip")).alias("_fields"))
    k = links.groupBy("doc_id").agg(F.count_if(bare("description")).alias("_links"))
    d = documents
    for side in (p, f, k):
        d = d.join(side, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    said = lambda good, bad="failed": F.when(good, "passed").otherwise(bad)
    blocked = F.col("permissions").isNotNull() & ~F.array_contains("permissions", "accessibility")
    status = {
        "tagged": said(F.col("tagged")),
        "figures": F.when(~F.col("tagged"), "manual").otherwise(said(F.col("figures_without") == 0)),
        "title": said(~bare("title")),
        "display-title": said(F.coalesce("display_title", F.lit(False))),
        "language": said(~bare("lang")),
        "text": said(none("_bare")),
        "tab-order": said(none("_tabs")),
        "field-tooltips": said(none("_fields")),
        "link-text": said(none("_links"), "warning"),
        "security": said(~F.coalesce(blocked, F.lit(False))),
        "bookmarks": said((F.coalesce("_pages", F.lit(0)) <= 20) | F.col("outlines"), "warning"),
        "manual": F.lit("manual"),
    }
    return d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("status")) for n, c in status.items()))).alias("c")).select("doc_id", "c.*")


def page_text(items: DataFrame, style: str = "search") -> DataFrame:
    """(doc_id, page, text) of text items (doc_id, page, seq, str, eol) in order. Styles: `search` puts a line break after an item that ends a line and nothing else, `compare` a break or a space, `spaced` a space
    between all items, `filled` a space between those that aren't empty."""
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    each = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "str", "eol"))).alias("items"))
    return text_of_pages(each, style)


def text_of_pages(pages: DataFrame, style: str = "search") -> DataFrame:
    """:func:`page_text` for pages that hold their items in order (doc_id, page, items: seq, str, eol)."""
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    end = {"search": lambda s: F.when(s["eol"], "\n").otherwise(""), "compare": lambda s: F.when(s["eol"], "\n").otherwise(" ")}.get(style)
    text = F.array_join(F.transform("items", lambda s: F.concat(s["str"], end(s))), "") if end else F.array_join(F.transform("items", lambda s: s["str"]), " ")
    if style == "filled":
        pages = pages.withColumn("items", F.filter("items", lambda s: s["str"] != "")).where(F.size("items") > 0)
    return pages.select("doc_id", "page", text.alias("text"))


def resolved(links: DataFrame, names: DataFrame, refs: DataFrame) -> DataFrame:
    """Links (doc_id, id, dest: a name, page_ref or page_index) with the page (from 0) that they lead to, or null. A name is looked up first: (doc_id, name, page_ref, page_index), the direct entry before the tree's
    (``nth``); a reference is a page (doc_id, page_ref, page), a number is itself."""
    first = names.groupBy("doc_id", F.col("name").alias("dest")).agg(F.min_by(F.struct("page_ref", "page_index"), "nth").alias("_n"), F.lit(True).alias("_known"))
    rows = links.join(first, ["doc_id", "dest"], "left")
    by_name = F.col("dest").isNotNull()
    ref, index = F.when(by_name, F.col("_n.page_ref")).otherwise(F.col("page_ref")), F.when(by_name, F.col("_n.page_index")).otherwise(F.col("page_index"))
    rows = rows.select("doc_id", "id", ref.alias("page_ref"), index.alias("_i"))
    there = refs.select("doc_id", "page_ref", F.col("page").alias("_p"))
    return rows.join(there, ["doc_id", "page_ref"], "left").select("doc_id", "id", F.when(F.col("page_ref").isNotNull(), F.col("_p")).otherwise(F.col("_i")).alias("page"))


def document_styles(lines: DataFrame, sample: int = 40) -> DataFrame:
    """Styles of a document's lines (doc_id, page, seq, font, size, bold, text): how many lines, the first words, and their rank by size, bold ones first, then by lines.

    Only the first ``sample`` lines with a character are gathered for the words, as they have as many characters.
    """
    style = ["doc_id", "font", "size", "bold"]
    said = lines.withColumn("_t", F.trim(F.regexp_replace("text", r"\s+", " "))).where("_t <> ''")
    early = said.withColumn("_r", F.row_number().over(Window.partitionBy(*style).orderBy("page", "seq"))).where(F.col("_r") <= sample)
    words = early.groupBy(*style).agg(F.array_sort(F.collect_list(F.struct("_r", F.substring("_t", 1, sample).alias("t")))).alias("_w"))
    first = words.select(*(F.col(c).alias(f"_{c}") for c in style), F.trim(F.substring(F.array_join(F.transform("_w", lambda x: x["t"]), " "), 1, sample)).alias("sample"))
    per = lines.groupBy(*style).agg(F.count(F.lit(1)).alias("lines"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in style))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), F.desc("bold"), F.desc("lines"), "font"))
    return per.join(first, same, "left").select(*style, "lines", F.coalesce("sample", F.lit("")).alias("sample"), rank.alias("rank"))


def comments_of(annotations: DataFrame) -> DataFrame:
    """Comments (doc_id, page, id, type, text, author, modified) from annotations (doc_id, page, id, name, subtype, endings, contents, author, modified, created). A line with an arrow's end is an Arrow."""
    arrow = F.coalesce(F.exists("endings", lambda e: F.contains(F.lower(e), F.lit("arrow"))), F.lit(False))
    kind = F.when(arrow, "Arrow").otherwise(F.col("subtype"))
    text = F.when(F.coalesce("contents", F.lit("")) != "", F.col("contents")).otherwise(F.concat(kind, F.lit(" annotation")))
    ident = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("id"))
    return annotations.where(F.col("subtype").isin(*COMMENTS)).select("doc_id", "page", ident.alias("id"), kind.alias("type"), text.alias("text"), F.nullif("author", F.lit("")).alias("author"), F.coalesce("modified", "created").alias("modified"))


def same_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, page, same): pages of two versions (doc_id, page, fingerprint) side by side; a page that one version lacks isn't the same."""
    a, b = (d.select("doc_id", "page", F.col("fingerprint").alias(n)) for d, n in ((before, "_a"), (after, "_b")))
    return a.join(b, ["doc_id", "page"], "full").select("doc_id", "page", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each document, with ``truncated`` where there are more."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    more = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > most
    return rows.withColumn("truncated", more).withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def split_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, part, page, page_in_part) for ranges (doc_id, nth, first, last) of pages in their order; pages that aren't there are dropped and parts without any don't count. Ranges are cut to the document before they are taken apart."""
    ends = pages.groupBy("doc_id").agg(F.min("page").alias("_from"), F.max("page").alias("_to"))
    low, high = F.greatest(F.least("first", "last"), "_from"), F.least(F.greatest("first", "last"), "_to")
    within = ranges.join(ends, "doc_id").select("doc_id", "nth", low.alias("_low"), high.alias("_high")).where("_low <= _high")
    rows = within.select("doc_id", "nth", F.explode(F.sequence("_low", "_high")).alias("page")).join(pages.select("doc_id", "page"), ["doc_id", "page"])
    part = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("nth"))
    place = F.row_number().over(Window.partitionBy("doc_id", "nth").orderBy("page"))
    return rows.select("doc_id", part.alias("part"), "page", place.alias("page_in_part"))


def split_by_size(pages: DataFrame, most: int) -> DataFrame:
    """Adds part to pages (doc_id, page, bytes): a new one where the next page would take it over ``most`` bytes. A fold over one document's sizes; a page that is larger by itself is a part."""
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("part"), F.filter(F.array(F.lit(0)), lambda x: F.lit(False)).alias("out"))

    def put(state: Column, p: Column) -> Column:
        new = (state["part"] == 0) | (state["size"] + p["bytes"] > most)
        part = F.when(new, state["part"] + 1).otherwise(state["part"])
        return F.struct(F.when(new, p["bytes"]).otherwise(state["size"] + p["bytes"]).cast("long").alias("size"), part.alias("part"), F.concat(state["out"], F.array(part)).alias("out"))

    sorted_ = F.array_sort(F.collect_list(F.struct("page", F.col("bytes").cast("long").alias("bytes"))))
    folded = pages.groupBy("doc_id").agg(sorted_.alias("p")).select("doc_id", F.arrays_zip(F.transform("p", lambda x: x["page"]).alias("page"), F.aggregate("p", start, put, lambda s: s["out"]).alias("part")).alias("z"))
    return folded.select("doc_id", F.explode("z").alias("z")).select("doc_id", F.col("z.page").alias("page"), F.col("z.part").alias("part"))


def column_gutters(words: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, page, gutter): where a page's words (doc_id, page, x, width) part into two columns, for pages that have two; see :func:`paged.gutter`. ``widths``: doc_id, page, page_width."""
    pages = paged.gathered(words, "x", "width").join(widths.select("doc_id", "page", "page_width"), ["doc_id", "page"])
    return pages.select("doc_id", "page", paged.gutter(F.col("items"), F.col("page_width")).alias("gutter")).where("gutter is not null")


def in_columns(words: DataFrame, widths: DataFrame) -> DataFrame:
    """Words with their column: 1, or 2 for those whose middle is right of their page's gutter."""
    right = F.col("x") + F.col("width") / 2 >= F.col("gutter")
    return words.join(column_gutters(words, widths), ["doc_id", "page"], "left").withColumn("column", F.when(F.coalesce(right, F.lit(False)), 2).otherwise(1)).drop("gutter")


def columns_of(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, column): :func:`in_columns` for pages that hold their items (doc_id, page, items, page_width)."""
    with_gutter = pages.withColumn("_gutter", paged.gutter(F.col("items"), F.col("page_width")))
    each = F.transform("items", lambda i: F.struct(i["seq"].alias("seq"), paged.column_of(i, F.col("_gutter")).alias("column")))
    return paged.inlined(with_gutter, each, "column")


def attachments(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, nth, name, size, description) of the names (node, seq, name, size, description) in name trees (doc_id, id, parent_id, place), as a walk from the roots meets them; unnamed ones have their number.

    A node with children has no names of its own; nodes that no root leads to, as in a cycle, are not met.
    """
    from .trees import walk

    met = walk(nodes)
    inner = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("id")).distinct()
    leaves = met.join(inner, ["doc_id", "id"], "left_anti").select("doc_id", F.col("id").alias("node"), "path")
    rows = names.join(leaves, ["doc_id", "node"]).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "seq")))
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise(F.concat(F.lit("attachment-"), F.col("nth")))
    return rows.select("doc_id", "nth", name.alias("name"), "size", "description")


def rename_fields(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """Fields (doc_id, name) under new names (doc_id, name, new_name), all at once, with an error where a final name is empty or is another field's, or a field to be renamed isn't there."""
    new = renames.select("doc_id", "name", F.trim("new_name").alias("_new"), F.lit(True).alias("_asked"))
    rows = fields.select("doc_id", "name", F.lit(True).alias("_there")).join(new, ["doc_id", "name"], "full")
    last = F.coalesce("_new", "name")
    twice = F.count_if("_there").over(Window.partitionBy("doc_id", "_last")) > 1
    rows = rows.withColumn("_last", last)
    error = F.when(F.col("_there").isNull(), "no such field").when(F.col("_last") == "", "empty name").when(twice, "name in use")
    return rows.select("doc_id", "name", F.col("_last").alias("new_name"), error.alias("error"))


def text_outside(operators: DataFrame, layer: str = "ocr") -> DataFrame:
    """(doc_id, page, has_text): whether a page shows text (operators: doc_id, page, op, layer) that isn't in the layer of recognised text."""
    own = (F.col("op") == "text") & (F.coalesce("layer", F.lit("")) != layer)
    return operators.groupBy("doc_id", "page").agg(F.bool_or(own).alias("has_text"))


def page_boxes(pages: DataFrame) -> DataFrame:
    """Boxes of pages (doc_id, page, and media, crop, bleed, trim, art, each x0, y0, x1, y1 or null): the crop box is cut to the media box and stands for it where it is missing, the others for the crop box."""
    cut = lambda b: F.struct(F.greatest(b["x0"], F.col("media.x0")).alias("x0"), F.greatest(b["y0"], F.col("media.y0")).alias("y0"), F.least(b["x1"], F.col("media.x1")).alias("x1"), F.least(b["y1"], F.col("media.y1")).alias("y1"))
    rows = pages.withColumn("crop", F.when(F.col("crop").isNull(), F.col("media")).otherwise(cut(F.col("crop"))))
    return rows.select("doc_id", "page", "media", "crop", *(F.when(F.col(c).isNull(), F.col("crop")).otherwise(cut(F.col(c))).alias(c) for c in ("bleed", "trim", "art")))
