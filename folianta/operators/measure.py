"""Widths of texts by a table of glyph widths: measured rectangles, lines that fit, and the shape of copied text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo

# Widths of the printable ASCII characters, from the space on, in thousandths of the size, of the common sans-serif standard font; without kerning.
SANS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Width of characters that a table doesn't have, and of all characters of a monospaced font.
OTHER, MONO = 556, 600


def sans(char: str) -> int:
    i = ord(char) - 32
    return SANS[i] if 0 <= i < len(SANS) else OTHER


def text_width(text: Column, other: int = OTHER) -> Column:
    """Width in thousandths of the size, by the sans-serif table."""
    table = F.array(*map(F.lit, SANS))
    each = lambda c: F.coalesce(F.get(table, F.when(c != "", F.ascii(c) - 32)), F.lit(other))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: n + each(c))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def range_rect(transform: Column, text: Column, width: Column, start: Column, end: Column, measure: Callable[[Column], Column] | None = text_width, height: Column | None = None) -> Column:
    """The box around characters start..end of a text item in any direction (its six-number transform): their measured share of the item's width with a third of a character around, from below
    the baseline to above the letters. Null for empty items. Without a measure, all characters are as wide."""
    m = lambda i: F.get(transform, F.lit(i))
    scale = lambda x, y: F.nullif(F.hypot(x, y), F.lit(0.0))
    along = F.coalesce(scale(m(0), m(1)), F.lit(1.0))
    tall = F.coalesce(scale(m(2), m(3)), F.nullif(height, F.lit(0.0)) if height is not None else F.lit(None), F.lit(10.0))
    chars = F.length(text)
    step = width / chars
    part = lambda n: (measure(F.substring(text, F.lit(1), n)) if measure else F.lit(0)).cast("long")
    sums = F.struct((measure(text) if measure else F.lit(0)).cast("long").alias("whole"), part(start).alias("start"), part(end).alias("end"))

    def box(w: Column) -> Column:
        offset = lambda n, sum_: F.when(w["whole"] > 0, sum_ / w["whole"] * width).otherwise(n * step)
        line = F.struct((offset(start, w["start"]) - 0.35 * step).alias("a"), (offset(end, w["end"]) + 0.35 * step).alias("b"), (m(0) / along).alias("ux"), (m(1) / along).alias("uy"), (-0.3 * tall).alias("low"), (1.1 * tall).alias("high"))
        return _once(line, corners)

    def corners(v: Column) -> Column:
        xs = [m(4) + v["ux"] * v[s] - v["uy"] * v[t] for s in ("a", "b") for t in ("low", "high")]
        ys = [m(5) + v["uy"] * v[s] + v["ux"] * v[t] for s in ("a", "b") for t in ("low", "high")]
        return geo.rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    return F.when((chars > 0) & (width > 0), _once(sums, box))


def wrap(text: str, width_of: Callable[[str], int], most: float) -> list[str]:
    """A paragraph's lines of at most ``most``: broken after spaces, which count for nothing at a line's end, and within words that are wider than a line; a text that ends in such a cut has an empty last line.

    Widths are summed once; each line's end is found by binary search in the sums at the ends of words, or of characters where a word doesn't fit.
    """
    n = len(text)
    sums = np.zeros(n + 1, np.int64)
    np.cumsum([width_of(c) for c in text], out=sums[1:])
    inked = np.zeros(n + 1, np.int64)
    inked[1:] = np.maximum.accumulate([0 if c.isspace() else i + 1 for i, c in enumerate(text)]) if n else 0
    ends = np.array([i + 1 for i, c in enumerate(text) if c == " "] + ([] if text.endswith(" ") else [n]), np.int64)
    word_sums, char_sums = sums[inked[ends]], sums[inked]
    out, start = [], 0
    while start < n:
        room = sums[start] + most
        k = int(np.searchsorted(word_sums, room, side="right"))
        stop = int(ends[k - 1]) if k else 0
        if stop > start:
            out.append(text[start:stop].rstrip())
        else:
            stop = max(start + 1, min(n, int(np.searchsorted(char_sums, room, side="right")) - 1))
            out += [text[start:stop]] if stop < n else [text[start:], ""]
        start = stop
    return out or [""]


def wrapped(paragraphs: DataFrame, size: float, most: float, mono: bool = False) -> DataFrame:
    """(doc_id, seq, nth, line) of paragraphs (doc_id, seq, text) in a font's size within a width."""
    schema = T.StructType([paragraphs.schema["doc_id"], paragraphs.schema["seq"], T.StructField("nth", T.IntegerType()), T.StructField("line", T.StringType())])
    units, width_of = most * 1000 / size, (lambda c: MONO) if mono else sans

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nth, lines = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                found = wrap(text or "", width_of, units)
                rows += [i] * len(found)
                nth += range(1, len(found) + 1)
                lines += found
            keys = b.select(["doc_id", "seq"]).take(pa.array(rows, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array(nth, pa.int32()), pa.array(lines, pa.string())], schema.names)

    return paragraphs.select("doc_id", "seq", "text").mapInArrow(lay, schema)


def text_pages(files: DataFrame, size: float = 11.0, width: float = 595.0, height: float = 842.0, margin: float = 56.0, mono: bool = False) -> DataFrame:
    """Texts (doc_id, text) laid out on pages: (doc_id, page, line, text, x, y). Line ends are unified, tabs are four spaces, form feeds begin a page; a page holds as many lines as fit at 1.25 times the size."""
    flat = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\t"), F.lit("    "))
    parts = files.select("doc_id", F.posexplode(F.split(flat, "\f", -1)).alias("part", "t"))
    lines = parts.select("doc_id", "part", F.posexplode(F.split("t", "\n", -1)).alias("n", "text"))
    fit = wrapped(lines.select("doc_id", F.struct("part", "n").alias("seq"), "text"), size, width - 2 * margin, mono)
    per_page = max(1, int((height - 2 * margin) // (size * 1.25)))
    order = Window.partitionBy("doc_id", "seq.part").orderBy("seq.n", "nth")
    placed = fit.withColumn("_k", F.row_number().over(order) - 1)
    pages = placed.groupBy("doc_id", F.col("seq.part").alias("part")).agg(F.floor(F.max("_k") / per_page).alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pages.select(F.col("doc_id").alias("_d"), F.col("part").alias("_part"), before.alias("_before"))
    rows = placed.join(starts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("seq.part") == F.col("_part")))
    line = F.col("_k") % per_page
    y = F.lit(height - margin - size) - line * (size * 1.25)
    return rows.select("doc_id", (F.col("_before") + F.floor(F.col("_k") / per_page) + 1).cast("int").alias("page"), (line + 1).cast("int").alias("line"), F.col("line").alias("text"), F.lit(margin).alias("x"), y.alias("y"))


def copied_lines(runs: DataFrame, slack: float = 0.6) -> DataFrame:
    """Adds ``line`` and ``line_top`` to a selection's runs (doc_id, seq, page, top, text, size, family): a run goes on with a line while it is on its page and its top near that of the line's first run. Rows are sorted and looked at once, with one line's first run in memory."""
    schema = T.StructType([*runs.schema.fields, T.StructField("line", T.LongType()), T.StructField("line_top", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page, first, line, begun = None, None, 0.0, 0, False
        for b in batches:
            numbers, tops = [], []
            for d, p, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page", "top")), strict=True):
                t = t or 0.0
                if not begun or d != doc:
                    doc, page, first, line, begun = d, p, t, 1, True
                elif p != page or abs(t - first) >= slack:
                    page, first, line = p, t, line + 1
                numbers.append(line)
                tops.append(first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(tops, pa.float64())], schema.names)

    return runs.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(fold, schema)


def copied_html(runs: DataFrame, reach: float = 1.6) -> DataFrame:
    """(doc_id, html): a selection's runs as lines and paragraphs with sizes and font families.

    A paragraph begins on another page, above the line before, and after more than 1.6 times the least pitch so far. A pitch that is too large is never the least, so the least of all
    earlier pitches is that of those within paragraphs, a running minimum.
    """
    of = copied_lines(runs)
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    points = F.regexp_replace((F.floor(F.col("size") * 10 + 0.5) / 10).cast("decimal(12,1)").cast("string"), r"\.0$", "")
    family = F.substring(F.regexp_replace("family", r"[^\w\s,'-]", ""), 1, 200)
    style = F.concat_ws(";", F.when(F.col("size") > 0, F.concat(F.lit("font-size:"), points, F.lit("pt"))), F.when(F.coalesce("family", F.lit("")) != "", F.concat(F.lit("font-family:"), family)))
    span = F.when(style != "", F.concat(F.lit('<span style="'), style, F.lit('">'), esc(F.col("text")), F.lit("</span>"))).otherwise(esc(F.col("text")))
    joined = lambda key, value, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), by)
    lines = of.groupBy("doc_id", "line").agg(F.first("page").alias("page"), F.first("line_top").alias("top"), joined("seq", span, "").alias("html"))
    order = Window.partitionBy("doc_id").orderBy("line")
    pitch = F.col("top") - F.lag("top").over(order)
    there = F.lag("page").over(order).eqNullSafe(F.col("page")) & (pitch >= 0) & (F.col("line") > 1)
    pitched = lines.withColumn("_pitch", F.when(there, pitch))
    least = F.min("_pitch").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("line") > 1) & (F.col("_pitch").isNull() | F.coalesce((F.col("_least") > 0) & (F.col("_pitch") > F.col("_least") * reach), F.lit(False)))
    numbered = pitched.withColumn("_least", least).withColumn("_p", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paragraphs = numbered.groupBy("doc_id", "_p").agg(F.concat(F.lit("<p>"), joined("line", F.col("html"), "<br>"), F.lit("</p>")).alias("html"))
    return paragraphs.groupBy("doc_id").agg(joined("_p", F.col("html"), "\n").alias("html"))
