"""What pages draw: texts, images and forms, with forms expanded into what they draw themselves.

Drawings are rows of streams: items (doc_id, stream, seq, kind: text, image or form, ref: the image or the form's stream, matrix, x0, y0, x1, y1 before it, text); pages (doc_id, page, stream)
name the stream that they begin with. Both are dealt by document once; a task follows the forms of many documents level by level, a bounded number of drawings at a time, and multiplies matrices on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grouped

# Fixed value: levels of forms within forms that are followed.
FORM_DEPTH = 12


#: Drawings that a task places at a time, or one stream's.
AT_ONCE = 100_000


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    """Matrices as rows of six numbers; a missing one changes nothing."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.tile(np.array((1.0, 0, 0, 1, 0, 0)), (rows, 1))
    given = pc.is_valid(column).to_numpy(zero_copy_only=False)
    if (n[given] != 6).any():
        raise ValueError("a matrix has six numbers")
    out[given] = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, 6)
    return out


def placed(pages: DataFrame, items: DataFrame, depth: int = FORM_DEPTH) -> DataFrame:
    """(doc_id, page, path, kind, ref, text, box, matrix, cut): every drawing of every page, forms before what is in them.

    ``path`` has the numbers of the drawings from the page down, so paths sort as they are drawn. Forms more than ``depth`` levels down aren't opened, and ``cut`` marks documents that have
    such (as where a form draws itself); other documents are not touched by that. Forms without a stream stay as they are.
    """
    boxes = ("x0", "y0", "x1", "y1")
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        items.schema["doc_id"], pages.schema["page"], T.StructField("path", T.ArrayType(T.LongType())), *(T.StructField(c, T.StringType()) for c in ("kind", "ref", "text")),
        T.StructField("box", T.StructType([T.StructField(c, T.DoubleType()) for c in boxes])), T.StructField("matrix", doubles), T.StructField("cut", T.BooleanType()),
    ])

    def look(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, (_, starts) = b.num_rows, grouped.runs(b.column("doc_id"))
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        both = pa.concat_arrays([b.column("stream"), b.column("ref")])
        known = both.is_valid().to_numpy(zero_copy_only=False)
        code = pc.fill_null(both.dictionary_encode().indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.append(doc, doc) * (int(code.max()) + 1) + code
        begins = b.column("begins").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~begins & known[:n])
        own = own[np.argsort(key[own], kind="stable")]
        streams, first = np.unique(key[own], return_index=True)
        first = np.append(first, len(own))
        at = np.minimum(np.searchsorted(streams, key), max(len(streams) - 1, 0))
        at = np.where(known & (streams[at] == key), at, -1) if len(streams) else np.full(2 * n, -1)
        opens = np.where(pc.fill_null(pc.equal(b.column("kind"), "form"), False).to_numpy(zero_copy_only=False), at[n:], -1)

        def drawn(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What streams draw: which of them, and the row."""
            many = first[where + 1] - first[where]
            of = np.repeat(np.arange(len(where)), many)
            return of, own[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[where], many)]

        start = np.flatnonzero(begins & (at[:n] >= 0))
        level, cut = np.unique(at[start]), np.zeros(len(starts) - 1, bool)
        for d in range(depth + 1):
            forms = drawn(level)[1]
            forms = forms[opens[forms] >= 0]
            level = np.unique(opens[forms])
            if d == depth:
                cut[doc[forms]] = True
        numbers, seq = _numbers(b.column("matrix"), n), b.column("seq").to_numpy(zero_copy_only=False)
        x0, y0, x1, y1 = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in boxes)
        rest = [(start, at[start], np.tile(np.array((1.0, 0, 0, 1, 0, 0)), (len(start), 1)), np.zeros((len(start), 0), np.int64))]
        while rest:
            page, where, base, path = rest.pop()
            k = max(1, int(np.searchsorted(np.cumsum(first[where + 1] - first[where]), AT_ONCE, side="right")))
            if k < len(where):
                rest.append((page[k:], where[k:], base[k:], path[k:]))
                page, where, base, path = page[:k], where[:k], base[:k], path[:k]
            of, row = drawn(where)
            if not len(row):
                continue
            m, c = numbers[row].T, base[of].T
            m = np.array([m[0] * c[0] + m[1] * c[2], m[0] * c[1] + m[1] * c[3], m[2] * c[0] + m[3] * c[2], m[2] * c[1] + m[3] * c[3], m[4] * c[0] + m[5] * c[2] + c[4], m[4] * c[1] + m[5] * c[3] + c[5]])
            corners = [(x[row], y[row]) for x in (x0, x1) for y in (y0, y1)]
            xs, ys = (np.array([m[i] * x + m[i + 2] * y + m[i + 4] for x, y in corners]) for i in (0, 1))
            box = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in (xs.min(0), ys.min(0), xs.max(0), ys.max(0))], list(boxes))
            path = np.column_stack([path[of], seq[row].astype(np.int64)])
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
            took, pages_ = pa.array(row), pa.array(page[of])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(took), b.column("page").take(pages_), lists(path), *(b.column(c).take(took) for c in ("kind", "ref", "text")), box, lists(m.T), pa.array(cut[doc[row]])], schema.names)
            deeper = opens[row] >= 0
            if path.shape[1] <= depth and deeper.any():
                rest.append((page[of][deeper], opens[row][deeper], m.T[deeper], path[deeper]))

    nothing = lambda d, *names: d.select("*", *(F.lit(None).cast({"page": pages, "seq": items}.get(c, items).schema[c].dataType).alias(c) for c in names))
    mine = items.select("doc_id", F.col("stream").cast("string").alias("stream"), "seq", F.col("kind").cast("string").alias("kind"), F.col("ref").cast("string").alias("ref"), F.col("matrix").cast(doubles).alias("matrix"), *(F.col(c).cast("double").alias(c) for c in boxes), F.col("text").cast("string").alias("text"))
    firsts = nothing(pages.select("doc_id", "page", F.col("stream").cast("string").alias("stream")), "seq", "kind", "ref", "matrix", *boxes, "text").withColumn("begins", F.lit(True))
    rows = nothing(mine, "page").withColumn("begins", F.lit(False)).unionByName(firsts.withColumn("seq", F.lit(0).cast(items.schema["seq"].dataType)))
    return grouped.by_document(rows, look, schema)


def inventory(drawn: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, seq, kind, box, text, ref, pixel_width, pixel_height, shared) of what a page draws itself.

    Texts without characters are left out. ``images`` (doc_id, ref, width, height) gives sizes in pixels; an image is shared if it is on several pages, forms included, or twice on its own page.
    """
    pictures = drawn.where("kind = 'image' and ref is not null")
    use = pictures.groupBy("doc_id", "ref").agg((F.count_distinct("page") > 1).alias("_wide"))
    here = pictures.where(F.size("path") == 1).groupBy("doc_id", "page", "ref").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    top = drawn.where((F.size("path") == 1) & (F.col("kind") != "form") & ((F.col("kind") != "text") | (F.coalesce("text", F.lit("")) != "")))
    rows = top.join(use, ["doc_id", "ref"], "left").join(here, ["doc_id", "page", "ref"], "left").join(images.select("doc_id", "ref", F.col("width").alias("pixel_width"), F.col("height").alias("pixel_height")), ["doc_id", "ref"], "left")
    shared = (F.col("kind") == "image") & (F.coalesce("_wide", F.lit(False)) | F.coalesce("_twice", F.lit(False)))
    return rows.select("doc_id", "page", F.col("path")[0].alias("seq"), "kind", "box", "text", "ref", "pixel_width", "pixel_height", shared.alias("shared"))
