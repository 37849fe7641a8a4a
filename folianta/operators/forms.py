"""Form fields: merging, checks, import and geometry, over (file, seq, name, type, value, required, read_only)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a file and one column a field, in the order in which the fields first appear; missing ones are empty. The columns are few by nature of a form (500 at most are allowed)."""
    if names is None:
        seen = fields.groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq", "name").limit(501).collect()
        names = [r["name"] for r in seen]
    if len(names) > 500:
        raise ValueError("more than 500 fields")
    wide = fields.groupBy("file").pivot("name", names).agg(F.first("value"))
    return wide.na.fill("", names)


def missing_required(fields: DataFrame) -> DataFrame:
    """Required fields without a value: blank text, unticked boxes, empty lists."""
    return fields.where("required").where((F.coalesce(F.trim("value"), F.lit("")) == "") | ((F.col("type") == "checkbox") & (F.col("value") == "false")) | ((F.col("type") == "list") & (F.col("value") == "[]")))


def import_check(payload: DataFrame, fields: DataFrame) -> DataFrame:
    """Payload (file, name, type, value) with an error for unknown, read-only, wrong-typed or over-long entries (fields also has max_length)."""
    f = fields.select("file", "name", F.col("type").alias("_type"), "read_only", "max_length", F.lit(True).alias("_there"))
    error = F.when(F.col("_there").isNull(), "unknown field").when(F.col("read_only"), "read-only field").when(F.col("type") != F.col("_type"), "wrong type").when(F.length("value") > F.col("max_length"), "too long")
    return payload.join(f, ["file", "name"], "left").withColumn("error", error).drop("_type", "_there", "read_only", "max_length")


def excluded(all_fields: DataFrame, supported: DataFrame) -> DataFrame:
    return all_fields.join(supported.select("file", "name"), ["file", "name"], "left_anti")


def field_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, name, change): added, cleared or changed values between two revisions (doc_id, name, value)."""
    a = before.select("doc_id", "name", F.col("value").alias("a"), F.lit(True).alias("_a"))
    b = after.select("doc_id", "name", F.col("value").alias("b"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull() | ((F.coalesce("b", F.lit("")) == "") & (F.coalesce("a", F.lit("")) != "")), "cleared").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, ["doc_id", "name"], "full_outer").withColumn("change", change).where("change is not null").select("doc_id", "name", "change")


def free_candidates(candidates: DataFrame, widgets: DataFrame) -> DataFrame:
    """Candidate rectangles (doc_id, page, ..., x0, y0, x1, y1) that overlap no widget of their page; pages are joined by key, overlaps tested within."""
    w = widgets.select("doc_id", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    on = [candidates["doc_id"] == w["doc_id"], candidates["page"] == w["page"], candidates["x0"] < w["_x1"], w["_x0"] < candidates["x1"], candidates["y0"] < w["_y1"], w["_y0"] < candidates["y1"]]
    test = on[0]
    for o in on[1:]:
        test = test & o
    return candidates.join(w, test, "left_anti")


def nearest_label(widgets: DataFrame, items: DataFrame, reach: float = 200.0, slack: float = 6.0) -> DataFrame:
    """Each widget (doc_id, page, widget, x, y) with the text of the nearest item (x_end, y, seq, str) to its left on its line, within reach."""
    i = items.select("doc_id", "page", F.col("y").alias("_y"), "x_end", "seq", "str")
    near = widgets.join(i, ["doc_id", "page"]).where((F.abs(F.col("y") - F.col("_y")) <= slack) & F.col("x_end").between(F.col("x") - reach, F.col("x")))
    best = near.groupBy("doc_id", "page", "widget").agg(F.min_by("str", F.struct((F.col("x") - F.col("x_end")).alias("d"), F.col("seq"))).alias("label"))
    return widgets.select("doc_id", "page", "widget").join(best, ["doc_id", "page", "widget"], "left")


def nearby_label(widgets: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page, widget, label): for each widget (x0, y0, x1, y1) the text of the item (seq, str, x, y, width, size) that ends nearest to its left on its line, or else of the lowest one just above it, or nothing.

    Left: within 150 points, at most 2 of them inside, its middle within 0.6 of the larger of its size and the widget's height. Above: less than 24 points higher, over the widget. Of equally near ones the first counts, of those with one number too the one whose text sorts first.
    """
    i = items.where(F.trim("str") != "").select("doc_id", "page", "seq", "str", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("width")).alias("_end"), F.coalesce(F.nullif(F.abs("size"), F.lit(0.0)), F.lit(10.0)).alias("_size"))
    both = widgets.select("doc_id", "page", "widget", "x0", "y0", "x1", "y1").join(i, ["doc_id", "page"])
    middle = F.abs(F.col("_y") + F.col("_size") * 0.35 - (F.col("y0") + F.col("y1")) / 2) < F.greatest(F.col("_size"), F.col("y1") - F.col("y0")) * 0.6
    left = (F.col("_end") <= F.col("x0") + 2) & (F.col("x0") - F.col("_end") < 150) & middle
    above = (F.col("_y") > F.col("y1")) & (F.col("_y") - F.col("y1") < 24) & (F.col("_x") < F.col("x1")) & (F.col("_end") > F.col("x0") - 2)
    near = both.where(left | above).groupBy("doc_id", "page", "widget").agg(
        F.min_by("str", F.when(left, F.struct((-F.col("_end")).alias("d"), "seq", "str"))).alias("_left"), F.min_by("str", F.when(above, F.struct(F.col("_y").alias("d"), "seq", "str"))).alias("_above")
    )
    return widgets.select("doc_id", "page", "widget").join(near, ["doc_id", "page", "widget"], "left").select("doc_id", "page", "widget", F.coalesce("_left", "_above", F.lit("")).alias("label"))


def distribute(widgets: DataFrame) -> DataFrame:
    """New x of the widgets (group, nth, x, width) of a group: the outer ones stay, the gaps between are equal."""
    g = Window.partitionBy("group")
    before = g.orderBy("x", "nth").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(g)
    span = F.max_by(F.col("x") + F.col("width"), F.struct("x", "nth")).over(g) - F.min("x").over(g)
    gap = F.when(n > 1, (span - F.sum("width").over(g)) / (n - 1)).otherwise(0.0)
    rank = F.row_number().over(g.orderBy("x", "nth")) - 1
    return widgets.withColumn("new_x", F.min("x").over(g) + F.coalesce(F.sum("width").over(before), F.lit(0.0)) + rank * gap)


def grid(fields: DataFrame, rows: int, columns: int, gap: float, pattern: str = "{name}_{row}_{column}") -> DataFrame:
    """Copies of fields (name, x, y, width, height) on a grid with names from a pattern; at most 1,000 a field."""
    if not (1 <= rows <= 100 and 1 <= columns <= 100 and rows * columns <= 1000):
        raise ValueError("a grid has 1 to 100 rows and columns and at most 1,000 cells")
    cells = fields.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(rows)))).withColumn("column", F.explode(F.sequence(F.lit(1), F.lit(columns))))
    name = F.lit(pattern)
    for key in ("name", "row", "column"):
        name = F.replace(name, F.lit("{" + key + "}"), F.col(key).cast("string"))
    return cells.withColumn("cell_name", name).withColumn("x", F.col("x") + (F.col("column") - 1) * (F.col("width") + gap)).withColumn("y", F.col("y") - (F.col("row") - 1) * (F.col("height") + gap))


def tab_order(pages: DataFrame) -> DataFrame:
    """(doc_id, tab_order): the one order that all pages have (null counts as one), or `mixed`."""
    one = F.count_distinct(F.coalesce("tab_order", F.lit("")))
    return pages.groupBy("doc_id").agg(F.when(one > 1, "mixed").otherwise(F.first("tab_order")).alias("tab_order"))


def aligned(widgets: DataFrame) -> DataFrame:
    """Widgets (group, nth, x, y, width, height, operation) arranged by their group's first one, which stays: `left`, `right`, `top`, `bottom`, `center-horizontal`, `center-vertical`, `match-width`, `match-height` or `match-size`. Adds new_x, new_y, new_width, new_height, to hundredths."""
    first = lambda c: F.first(c).over(Window.partitionBy("group").orderBy("nth"))
    op, x, y, w, h = (F.col(c) for c in ("operation", "x", "y", "width", "height"))
    ax, ay, aw, ah = (first(c) for c in ("x", "y", "width", "height"))
    new = {
        "new_x": F.when(op == "left", ax).when(op == "right", ax + aw - w).when(op == "center-horizontal", ax + (aw - w) / 2).otherwise(x),
        "new_y": F.when(op == "top", ay).when(op == "bottom", ay + ah - h).when(op == "center-vertical", ay + (ah - h) / 2).otherwise(y),
        "new_width": F.when(op.isin("match-width", "match-size"), aw).otherwise(w),
        "new_height": F.when(op.isin("match-height", "match-size"), ah).otherwise(h),
    }
    return widgets.select("*", *((F.floor(c * 100 + 0.5) / 100).alias(n) for n, c in new.items()))


def merged_fields(fields: DataFrame) -> DataFrame:
    """Adds unique to the top fields of merged documents (bundle, source from 0, seq, name; no name is `field`): the name, or Source<n>_<name>_<k> with the first k that is free.

    A name is taken by an equal one and by one that is above or below it at a dot, in the order of sources and seq. Rows are sorted by bundle and looked at once, with one bundle's names in memory.
    """
    schema = T.StructType([*fields.schema.fields, T.StructField("unique", T.StringType())])

    def fold(batches):
        bundle, begun, names, above = None, False, set(), set()
        for b in batches:
            out = []
            for of, source, name in zip(*(b.column(c).to_pylist() for c in ("bundle", "source", "name")), strict=True):
                if not begun or of != bundle:
                    bundle, begun, names, above = of, True, set(), set()
                own = "field" if name is None else name
                unique, k = own, 0
                while unique in names or unique in above or any(unique[:i] in names for i, c in enumerate(unique) if c == "."):
                    k += 1
                    unique = f"Source{source + 1}_{own}_{k}"
                names.add(unique)
                above.update(unique[:i] for i, c in enumerate(unique) if c == ".")
                out.append(unique)
            yield b.append_column("unique", pa.array(out, pa.string()))

    return fields.repartition("bundle").sortWithinPartitions("bundle", "source", "seq").mapInArrow(fold, schema)
