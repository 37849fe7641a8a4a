"""Small records: how pages change and documents open, which standards they declare, how a crop is dragged, what copied comments say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of transitions, layouts, panels and fits, and of the fields that declare a standard.
TRANSITIONS = ("Split", "Blinds", "Box", "Wipe", "Dissolve", "Glitter", "Fly", "Push", "Cover", "Uncover", "Fade")
LAYOUTS = ("SinglePage", "OneColumn", "TwoColumnLeft", "TwoColumnRight", "TwoPageLeft", "TwoPageRight")
PANELS = ("UseNone", "UseOutlines", "UseThumbs", "UseOC", "UseAttachments")
FITS = ("Fit", "FitH", "XYZ")
PDFA, LEVEL, PDFUA, PDFX = "pdfaid:part", "pdfaid:conformance", "pdfuaid:part", "pdfxid:GTS_PDFXVersion"


def _known(value: Column, names: tuple[str, ...], other: Column) -> Column:
    return F.when(value.isin(*names), value).otherwise(other)


def transitions(pages: DataFrame) -> DataFrame:
    """(doc_id, page, style, duration, direction, dimension, motion, advance_after) of pages (style, d, di, dm, m, dur) with a known transition; what is missing or odd is the default."""
    rows = pages.where(F.col("style").isin(*TRANSITIONS))
    return rows.select(
        "doc_id", "page", "style", F.coalesce("d", F.lit(1.0)).alias("duration"), F.when(F.col("di").isin(0, 90, 180, 270), F.col("di").cast("int")).otherwise(0).alias("direction"),
        _known(F.col("dm"), ("V",), F.lit("H")).alias("dimension"), _known(F.col("m"), ("O",), F.lit("I")).alias("motion"), F.when(F.col("dur") >= 0, F.col("dur")).alias("advance_after"),
    )


def initial_view(documents: DataFrame) -> DataFrame:
    """(doc_id, layout, panel, page, fit, zoom, display_title, right_to_left) of documents (layout, panel, page_index from 0, fit, zoom as a factor, display_title, direction, pages)."""
    there = (F.col("page_index") >= 0) & (F.col("page_index") < F.col("pages"))
    return documents.select(
        "doc_id", _known(F.col("layout"), LAYOUTS, F.lit(LAYOUTS[0])).alias("layout"), _known(F.col("panel"), PANELS, F.lit(PANELS[0])).alias("panel"), F.when(there, F.col("page_index") + 1).otherwise(1).cast("int").alias("page"),
        _known(F.col("fit"), FITS, F.lit(FITS[0])).alias("fit"), F.when(F.col("zoom") > 0, F.col("zoom") * 100).otherwise(100.0).alias("zoom"), F.coalesce("display_title", F.lit(False)).alias("display_title"),
        F.coalesce(F.col("direction") == "R2L", F.lit(False)).alias("right_to_left"),
    )


def xmp_property(xmp: Column, name: str) -> Column:
    """A property of an XMP text, as an attribute or an element; null if it isn't there or is empty."""
    return F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(xmp, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit("")), F.regexp_extract(xmp, rf"<{name}\b[^>]*>([^<]*)</{name}>", 1))), F.lit(""))


def declared_standards(documents: DataFrame, intents: DataFrame) -> DataFrame:
    """(doc_id, pdfa, pdfua, pdfx, intents, profiles): the standards that documents (xmp, pdfx from the information dictionary) say they follow, with the number of their output intents (doc_id, has_profile) and of those with a colour profile."""
    xmp = F.col("xmp")
    per = intents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("intents"), F.count_if("has_profile").alias("profiles"))
    rows = documents.join(per, "doc_id", "left")
    part = lambda p: xmp_property(xmp, p)
    return rows.select(
        "doc_id", F.concat(F.lit("PDF/A-"), part(PDFA), F.lower(F.coalesce(part(LEVEL), F.lit("")))).alias("pdfa"), F.concat(F.lit("PDF/UA-"), part(PDFUA)).alias("pdfua"), F.coalesce(F.nullif("pdfx", F.lit("")), part(PDFX)).alias("pdfx"),
        F.coalesce("intents", F.lit(0)).alias("intents"), F.coalesce("profiles", F.lit(0)).alias("profiles"),
    )


def dragged(box: Column, handle: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A crop (struct x, y, width, height) after its handle was dragged: `move`, or sides by their letters (n, e, s, w). It stays within the picture and at least a pixel wide and high; places are rounded."""
    near = lambda v, low, high: F.greatest(low, F.least(high, F.floor(v + 0.5)))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    x, y, right, low = (c.cast("long") for c in (box["x"], box["y"], box["x"] + box["width"], box["y"] + box["height"]))
    moved = F.struct(near(x + dx, zero, width - (right - x)).alias("x"), near(y + dy, zero, height - (low - y)).alias("y"), (right - x).alias("width"), (low - y).alias("height"))
    left = F.when(handle.contains("w"), near(x + dx, zero, right - one)).otherwise(x)
    far = F.when(handle.contains("e"), near(right + dx, left + one, width)).otherwise(right)
    top = F.when(handle.contains("n"), near(y + dy, zero, low - one)).otherwise(y)
    end = F.when(handle.contains("s"), near(low + dy, top + one, height)).otherwise(low)
    return F.when(handle == "move", moved).otherwise(F.struct(left.alias("x"), top.alias("y"), (far - left).alias("width"), (end - top).alias("height")))


def clipboard_text(comments: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of copied comments (doc_id, seq, text) with blank lines between, and how many there are."""
    said = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), lambda t: t != "")
    per = comments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(said, "\n\n").alias("t"))
    label = F.concat(F.lit("("), "n", F.when(F.col("n") == 1, " comment)").otherwise(" comments)"))
    return per.select("doc_id", F.when(F.col("t") != "", F.concat("t", F.lit("\n\n"), label)).otherwise(label).alias("text"))


def paste_offsets(pastes: DataFrame, step: int = 18) -> DataFrame:
    """Adds offset to pastes (doc_id, page, seq): none for the first on a page, so many points more for each after it."""
    return pastes.withColumn("offset", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")) - 1) * step)
