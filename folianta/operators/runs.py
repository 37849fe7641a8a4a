"""Text runs that a page shows, from its drawing operators (doc_id, page, seq, op, nums, str).

Operators are dealt by page and sorted once, and each page is walked as its rows come by, with the graphics state, the stack of saved ones and one batch in memory: a page of any length is never collected.
Operators that change nothing don't travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .layout import half_points

# Names of the operators, the colour at first, and the rendering mode that shows nothing.
OPENS, CLOSES = ("save", "formBegin"), ("restore", "formEnd")
SHOWS = ("showText", "showSpacedText", "nextLineShowText", "nextLineSetSpacingShowText")
BLACK, INVISIBLE = "#000000", 3
PAGE = ("doc_id", "page")
TELLS = (*OPENS, *CLOSES, *SHOWS, "transform", "fill", "font", "render", "beginText", "textMatrix")
SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(a: tuple, b: tuple) -> tuple:
    """The matrix that does a first, then b."""
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple]]]:
    """Of each batch of sorted operators, which ones show a text, and the state they do so in: font, size, colour, and the matrix over that of the text."""
    page = stack = state = text = None
    for b in batches:
        doc, nums, words = (b.column(c).to_pylist() for c in ("doc_id", "nums", "str"))
        at, out = [], []
        for i, (key, op, n, s) in enumerate(zip(zip(doc, b.column("page").to_pylist(), strict=True), b.column("op").to_pylist(), nums, words, strict=True)):
            if key != page:
                page, stack, state, text = key, [], ("", 0.0, BLACK, 0, SAME), SAME
            font, size, colour, mode, matrix = state
            if op in SHOWS:
                if mode != INVISIBLE and font:
                    at.append(i)
                    out.append((font, size, colour, *_times(text, matrix)[2:]))
            elif op in CLOSES:
                state = stack.pop() if stack else state
            elif op in OPENS:
                stack.append(state)
                if op == "formBegin" and n is not None and len(n) == 6:
                    state = font, size, colour, mode, _times(n, matrix)
            elif op == "transform":
                if n is not None and len(n) == 6:
                    state = font, size, colour, mode, _times(n, matrix)
            elif op == "font":
                state = s or "", abs((n[0] if n else None) or 0.0), colour, mode, matrix
            elif op == "fill":
                state = font, size, colour if s is None else s, mode, matrix
            elif op == "render":
                state = font, size, colour, int((n[0] if n else None) or 0), matrix
            elif op == "beginText":
                text = SAME
            elif n is not None and len(n) == 6:
                text = tuple(n)
        yield b, at, out


def visible_runs(ops: DataFrame) -> DataFrame:
    """(doc_id, page, seq, str, font, size, colour, x, y): texts shown with a font, in a size above 0 and not in the invisible mode, with the size and place after all transforms."""
    states = [*(T.StructField(c, k) for c, k in (("font", T.StringType()), ("size", T.DoubleType()), ("colour", T.StringType()), ("_c", T.DoubleType()), ("_d", T.DoubleType()), ("x", T.DoubleType()), ("y", T.DoubleType())))]
    keys = ["doc_id", "page", "seq", "str"]
    schema = T.StructType([*(ops.schema[c] for c in keys), *states])
    kinds = [pa.string(), pa.float64(), pa.string(), *[pa.float64()] * 4]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, out in _shown(batches):
            if at:
                yield pa.RecordBatch.from_arrays([*b.select(keys).take(pa.array(at)).columns, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], schema.names)

    tells = ops.where(F.col("op").isin(*TELLS)).select(*PAGE, "seq", "op", F.col("nums").cast("array<double>").alias("nums"), "str")
    found = tells.repartition(*PAGE).sortWithinPartitions(*PAGE, "seq").mapInArrow(walk, schema)
    sized = found.withColumn("size", half_points(F.col("size") * F.hypot("_c", "_d")))
    seen = sized.where((F.length(F.trim(tx.collapse(F.coalesce("str", F.lit(""))))) > 0) & (F.col("size") > 0))
    return seen.select(*PAGE, "seq", "str", "font", "size", "colour", "x", "y")


def styles(runs: DataFrame, top: int = 12) -> DataFrame:
    """(doc_id, page, rank, font, size, colour, characters): a page's styles of visible runs, most used first, then as they first occur."""
    per = runs.groupBy(*PAGE, "font", "size", "colour").agg(F.sum(F.length("str")).alias("characters"), F.min("seq").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("characters"), "_first"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top).select(*PAGE, "rank", "font", "size", "colour", "characters")
