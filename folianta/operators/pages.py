"""Page algebra: selections, merging, splitting, mappings, imposition and numbering. Pages count from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected_pages(spec: Column, pages: Column) -> Column:
    """Sorted distinct pages of a comma list of pages and ranges (either way round), cut to 1..pages. Parts that are none are left out."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"\s", "")), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))

    def expand(p: Column) -> Column:
        a = F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
        b = F.coalesce(F.nullif(F.split_part(p, F.lit("-"), F.lit(2)), F.lit("")).cast("int"), a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), pages)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def check_selection(spec: str, pages: int, most: int = 100_000) -> list[int]:
    """The strict form: anything outside 1..pages, or that isn't a page or range, is an error."""
    if len(spec) > 10_000:
        raise ValueError("a selection has at most 10,000 characters")
    out: set[int] = set()
    for part in spec.split(","):
        ends = part.strip().split("-")
        if len(ends) > 2 or not all(e.strip().isdigit() for e in ends):
            raise ValueError(f"not a page or range: {part.strip()!r}")
        a, b = int(ends[0]), int(ends[-1])
        if not 1 <= a <= b <= pages or b - a >= most:
            raise ValueError(f"pages {part.strip()} aren't in 1 to {pages}")
        out.update(range(a, b + 1))
    return sorted(out)


def parity(pages: DataFrame, odd: bool = True) -> DataFrame:
    return pages.where(F.col("page") % 2 == (1 if odd else 0))


def invert(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.join(chosen.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def merge_documents(pages: DataFrame, order: DataFrame, target: str = "new_page") -> DataFrame:
    """Pages of documents one after the other, by ``order`` (doc_id, bundle, nth): adds the page in the bundle. Offsets come from one row a document."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).join(order, "doc_id")
    before = Window.partitionBy("bundle").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("doc_id", "bundle", "_start")
    return pages.join(starts, "doc_id").withColumn(target, (F.col("_start") + F.col("page")).cast("long")).drop("_start")


def split_fixed(pages: DataFrame, size: int) -> DataFrame:
    """Adds part (from 1) and page_in_part for parts of ``size`` pages."""
    if size < 1:
        raise ValueError("a part has a page at least")
    return pages.withColumn("part", (F.floor((F.col("page") - 1) / size) + 1).cast("int")).withColumn("page_in_part", ((F.col("page") - 1) % size + 1).cast("int"))


def split_at(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds part: a new one at each start page (doc_id, page), the pages before the first being part 0."""
    marked = pages.join(starts.select("doc_id", "page", F.lit(1).alias("_s")).distinct(), ["doc_id", "page"], "left")
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("part", F.coalesce(F.sum("_s").over(w), F.lit(0)).cast("int")).drop("_s")


def delete_mapping(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages that stay with their new numbers."""
    kept = invert(pages, gone)
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))


def insert_mapping(pages: DataFrame, blanks: DataFrame) -> DataFrame:
    """All pages after inserting blanks (doc_id, after, n): source_page is -1 for a blank."""
    new = blanks.select("doc_id", (F.col("after") + 0.5).alias("_at"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_k")).withColumn("source_page", F.lit(-1))
    old = pages.select("doc_id", F.col("page").cast("double").alias("_at"), F.lit(0).alias("_k"), F.col("page").alias("source_page"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "_k"))
    return old.unionByName(new).select("doc_id", place.alias("new_page"), "source_page")


def reverse_mapping(pages: DataFrame) -> DataFrame:
    return pages.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page"))))


def move_mapping(pages: DataFrame, chosen: DataFrame, before: Column | int) -> DataFrame:
    """New numbers when the chosen pages move, in their order, to stand before a page (beyond the last: at the end)."""
    at = F.lit(before) if isinstance(before, int) else before
    marked = pages.join(chosen.select("doc_id", "page", F.lit(1).alias("_c")), ["doc_id", "page"], "left")
    group = F.when(F.col("_c") == 1, 1).when(F.col("page") < at, 0).otherwise(2)
    return marked.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy(group, "page"))).drop("_c")


def n_up(pages: DataFrame, rows: int, columns: int) -> DataFrame:
    """Adds sheet, row and column (from 1) of each page on sheets of rows x columns."""
    i, per = F.col("page") - 1, rows * columns
    return pages.withColumn("sheet", (F.floor(i / per) + 1).cast("int")).withColumn("row", (F.floor((i % per) / columns) + 1).cast("int")).withColumn("column", (i % columns + 1).cast("int"))


def booklet(documents: DataFrame) -> DataFrame:
    """(doc_id, sheet, side, left_page, right_page) from (doc_id, pages): pages padded to a multiple of four; 0 is blank."""
    total = (F.ceil(F.col("pages") / 4) * 4).cast("int")
    sides = documents.where("pages > 0").select("doc_id", "pages", total.alias("_t"), F.explode(F.sequence(F.lit(0), (total / 2 - 1).cast("int"))).alias("k"))
    k, t = F.col("k").cast("int"), F.col("_t")
    front = k % 2 == 0
    left, right = F.when(front, t - k).otherwise(k + 1), F.when(front, k + 1).otherwise(t - k)
    real = lambda p: F.when(p <= F.col("pages"), p).otherwise(0).cast("int")
    return sides.select("doc_id", (F.floor(k / 2) + 1).cast("int").alias("sheet"), F.when(front, "front").otherwise("back").alias("side"), real(left).alias("left_page"), real(right).alias("right_page"))


def poster(sizes: DataFrame, scale: float, tile_width: float, tile_height: float, overlap: float, most: int = 500) -> DataFrame:
    """A row for each tile of a page (width, height) at a scale: row, column, x, y of its corner. Pages of more than ``most`` tiles are an error."""
    across = F.greatest(F.ceil((F.col("width") * scale - overlap) / (tile_width - overlap)), F.lit(1)).cast("int")
    down = F.greatest(F.ceil((F.col("height") * scale - overlap) / (tile_height - overlap)), F.lit(1)).cast("int")
    grid = sizes.withColumn("_a", F.when(across.cast("long") * down > most, F.raise_error(F.lit(f"more than {most} tiles"))).otherwise(across)).withColumn("_d", down)
    tiles = grid.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("_d")))).withColumn("column", F.explode(F.sequence(F.lit(1), F.col("_a"))))
    return tiles.withColumn("x", (F.col("column") - 1) * (tile_width - overlap)).withColumn("y", (F.col("row") - 1) * (tile_height - overlap)).drop("_a", "_d")


def bates(files: DataFrame, start: int, width: int, prefix: str = "", suffix: str = "", by: str = "bundle") -> DataFrame:
    """First and last number of each file (nth, pages, ok) of a run (``by``): numbers run on over the files that succeed; the others take none."""
    from ..functions.text import padded

    w = Window.partitionBy(by).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("ok"), F.col("pages")).otherwise(0)
    first = F.lit(start) + F.coalesce(F.sum(taken).over(w), F.lit(0))
    label = lambda n: F.concat(F.lit(prefix), padded(n, width), F.lit(suffix))
    rows = files.withColumn("_f", first).where(F.col("ok") & (F.col("pages") > 0))
    return rows.withColumn("first_label", label(F.col("_f"))).withColumn("last_label", label(F.col("_f") + F.col("pages") - 1)).drop("_f")


def label_ranges(ranges: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranges of labels (doc_id, start_page, ...) that begin on a page of their document (doc_id, pages), numbered in the order of their pages as nth."""
    there = ranges.join(documents.select("doc_id", F.col("pages").alias("_pages")), "doc_id").where(F.col("start_page") <= F.col("_pages")).drop("_pages")
    return there.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_page")))


def labels_as_of(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each page's label from the latest range that starts at or before it; plain numbers before the first. One sort a document, no join of pages with ranges."""
    from ..functions.text import page_label

    keep = F.struct("start_page", "style", "prefix", "first_number")
    marks = ranges.select("doc_id", F.col("start_page").alias("page"), F.lit(0).alias("_kind"), keep.alias("_r"))
    rows = pages.select("doc_id", "page", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"))
    w = Window.partitionBy("doc_id").orderBy("page", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_kind = 1")
    n = F.col("_r.first_number") + F.col("page") - F.col("_r.start_page")
    label = F.when(F.col("_r").isNull(), F.col("page").cast("string")).otherwise(page_label(F.col("_r.style"), F.col("_r.prefix"), n))
    return found.select("doc_id", "page", label.alias("label"))
