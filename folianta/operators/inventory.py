"""Inventories and batches over document records: fonts, metadata, boxes, actions, drawing units, ink and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Standard metadata keys.
STANDARD_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")
# First bytes of 3D and image formats.
MAGIC = (("U3D", "55334400"), ("PRC", "505243"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"))


def fonts(uses: DataFrame) -> DataFrame:
    """(doc_id, font, pages, embedded, subset) from uses of fonts on pages (doc_id, page, font, embedded)."""
    return uses.groupBy("doc_id", "font").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.max("embedded").alias("embedded"), F.first(F.col("font").rlike("^[A-Z]{6}\\+")).alias("subset"))


def keywords(text: Column) -> Column:
    """Keywords apart: at commas or semicolons, or else at white space."""
    parts = F.when(text.rlike("[,;]"), F.split(text, "[,;] ?")).otherwise(F.split(text, r"\s+"))
    return F.filter(F.transform(parts, lambda k: F.trim(k)), lambda k: k != "")


def custom_metadata(entries: DataFrame) -> DataFrame:
    """Entries (doc_id, name, value) that aren't standard keys, as one map a document; 100 at most are kept, by name."""
    own = entries.where(~F.col("name").isin(*STANDARD_KEYS))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    return own.withColumn("_n", nth).where("_n <= 100").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("custom"))


def media_kind(content: Column) -> Column:
    """The format that the first bytes tell, or null."""
    out = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, name).otherwise(out)
    return out


def hide_actions(annotations: DataFrame) -> DataFrame:
    """(doc_id, id, targets): link annotations with a hide action and the fields that each hides (true unless it says otherwise)."""
    rows = annotations.where("subtype = 'Link' and action = 'Hide'")
    return rows.groupBy("doc_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("target", F.coalesce("hide", F.lit(True)).alias("hide"))))).alias("targets"))


def printed(annotations: DataFrame, mode: str = "document and markups") -> DataFrame:
    """Annotations that are printed: none of them, stamps and form fields, or all but links and popups."""
    keep = {"document": ["Widget"], "document and stamps": ["Widget", "Stamp"]}
    return annotations.where(F.col("subtype").isin(keep[mode])) if mode in keep else annotations.where(~F.col("subtype").isin("Link", "Popup"))


def discarded(objects: DataFrame, options: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Objects without the classes that the options (name: predicate) remove, and how many each removed; an object counts for the first option that fits."""
    name = F.coalesce(*[F.when(F.expr(p), F.lit(n)) for n, p in options.items()], F.lit(None).cast("string"))
    marked = objects.withColumn("_gone", name)
    return marked.where("_gone is null").drop("_gone"), marked.where("_gone is not null").groupBy("doc_id", F.col("_gone").alias("option")).agg(F.count(F.lit(1)).alias("removed"))


def structure_loss(sources: DataFrame) -> DataFrame:
    """(bundle, outlines, fields) that a merge of sources (bundle, has_outline, fields) loses."""
    return sources.groupBy("bundle").agg(F.count_if("has_outline").alias("outlines"), F.coalesce(F.sum("fields"), F.lit(0)).alias("fields"))


def permitted_changes(signatures: DataFrame) -> DataFrame:
    """Adds verdict to signatures (level 1 to 3, change): no change at level 1, forms at 2, comments too at 3."""
    allowed = F.when(F.col("level") == 1, F.array().cast("array<string>")).when(F.col("level") == 2, F.array(F.lit("form"))).otherwise(F.array(F.lit("form"), F.lit("comment")))
    return signatures.withColumn("verdict", F.when(F.col("change").isNull(), "unchanged").when(F.array_contains(allowed, F.col("change")), "permitted").otherwise("broken"))


def move_bookmarks(bookmarks: DataFrame, target_pages: DataFrame) -> DataFrame:
    """Bookmarks for another document (doc_id, pages): places beyond its pages are cleared and marked unplaced."""
    rows = bookmarks.join(target_pages, "doc_id")
    out = F.col("page").isNotNull() & ~F.col("page").between(1, F.col("pages"))
    return rows.withColumn("unplaced", out).withColumn("page", F.when(~out, F.col("page"))).drop("pages")


def remap_bookmarks(bookmarks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, id, parent_id, page) after a page mapping (doc_id, page, new_page): those that keep a page, and the ancestors of such."""
    from .comments import with_ancestors

    moved = bookmarks.join(mapping, ["doc_id", "page"], "left")
    kept = with_ancestors(moved.where("new_page is not null"), bookmarks)
    return moved.join(kept.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select("doc_id", "id", "parent_id", F.col("new_page").alias("page"))


def raise_units(units: DataFrame) -> DataFrame:
    """Adds front_seq: how far forward a unit (doc_id, page, seq, kind: paint or barrier) may move, the last paint before the next barrier. Barriers part the page into islands."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("kind") == "barrier", 1).otherwise(0)).over(w)
    rows = units.withColumn("_i", island).where("kind = 'paint'")
    whole = Window.partitionBy("doc_id", "page", "_i")
    return rows.withColumn("front_seq", F.max("seq").over(whole)).withColumn("back_seq", F.min("seq").over(whole)).drop("_i")


def erase_ink(points: DataFrame, erasers: DataFrame, radius: float) -> DataFrame:
    """Strokes after erasing: points (doc_id, page, stroke, nth, x, y) within a radius of an eraser point go, and what is left of a stroke falls into pieces of two points or more."""
    e = erasers.select("doc_id", "page", F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = points.join(e, ["doc_id", "page"]).where((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 <= radius * radius).select("doc_id", "page", "stroke", "nth").distinct()
    left = points.join(near, ["doc_id", "page", "stroke", "nth"], "left_anti")
    w = Window.partitionBy("doc_id", "page", "stroke")
    piece = F.col("nth") - F.row_number().over(w.orderBy("nth"))
    marked = left.withColumn("piece", piece)
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page", "stroke", "piece"))
    kept = marked.withColumn("_n", size).where("_n >= 2").drop("_n")
    return kept.withColumn("piece", F.dense_rank().over(w.orderBy("piece")))


def shift(annotations: DataFrame, dx: float, dy: float, most: int = 500) -> DataFrame:
    """Annotations (points: array of x, y) moved together; locked ones stay. More than ``most`` a document are an error."""
    moved = F.transform("points", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    many = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > most
    return annotations.withColumn("points", F.when(many, F.raise_error(F.lit(f"more than {most} annotations"))).when(~F.col("locked"), moved).otherwise(F.col("points")))


def selection_quads(rects: DataFrame, pages: DataFrame, band: float = 1000.0) -> DataFrame:
    """Selection rectangles (doc_id, x0, y0, x1, y1 on the whole scroll) cut to the pages (doc_id, page, top, bottom) that they touch: page, rectangle. Both are dealt to bands of the scroll, in which they meet."""
    bands = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / band), F.floor(F.col(b) / band)))
    p = pages.select("doc_id", "page", "top", "bottom", bands("top", "bottom").alias("_band"))
    r = rects.withColumn("_band", bands("y0", "y1"))
    first = F.greatest(F.floor(F.col("top") / band), F.floor(F.col("y0") / band)) == F.col("_band")
    rows = r.join(p, ["doc_id", "_band"]).where(first & (F.col("y0") < F.col("bottom")) & (F.col("top") < F.col("y1")))
    return rows.select("doc_id", "page", "x0", F.greatest("y0", "top").alias("y0"), "x1", F.least("y1", "bottom").alias("y1"))


def permissions(bits: Column) -> Column:
    """Names of what a permission number allows."""
    # Bit places, from 0, of permissions.
    places = (("print", 2), ("modify", 3), ("copy", 4), ("annotate", 5), ("fill", 8), ("extract", 9), ("assemble", 10), ("print well", 11))
    return F.filter(F.array(*[F.when(F.shiftright(bits.cast("int"), at).bitwiseAND(F.lit(1)) == 1, F.lit(name)) for name, at in places]), lambda n: n.isNotNull())


def blank_fields(items: DataFrame, reach: float = 200.0, slack: float = 4.0) -> DataFrame:
    """Places for fields: runs of five underscores or more and box signs (doc_id, page, seq, str, x, y, width), with the label before them in the item or the nearest item to the left."""
    text = F.col("str").rlike("_{5,}")
    hit = items.where(text | F.col("str").rlike("[☐□▢❑]")).withColumn("kind", F.when(text, "text").otherwise("checkbox"))
    own = F.trim(F.regexp_extract("str", "^(.*?)(?:_{5,}|[☐□▢❑])", 1))
    left = items.where("not str rlike '_{5,}|[☐□▢❑]' and trim(str) <> ''").select("doc_id", "page", F.col("y").alias("_y"), (F.col("x") + F.col("width")).alias("_end"), F.col("str").alias("_s"), F.col("seq").alias("_q"))
    near = hit.select("doc_id", "page", "seq", "x", "y").join(left, ["doc_id", "page"]).where((F.abs(F.col("y") - F.col("_y")) <= slack) & F.col("_end").between(F.col("x") - reach, F.col("x")))
    best = near.groupBy("doc_id", "page", "seq").agg(F.min_by("_s", F.struct((F.col("x") - F.col("_end")).alias("d"), F.col("_q"))).alias("_near"))
    from ..functions.text import label_name

    return hit.join(best, ["doc_id", "page", "seq"], "left").select("doc_id", "page", "seq", "kind", "x", "y", label_name(F.coalesce(F.nullif(own, F.lit("")), F.col("_near"), F.lit("Field"))).alias("name"))
