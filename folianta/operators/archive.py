"""Archive rules: what in a document keeps it from being an archive file of a part (2 or 3) and a level (A, B or U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Fixed values of the standard: actions, named actions and annotations, flags, and where metadata repeats the document's information.
FORBIDDEN_ACTIONS = ("Launch", "Sound", "Movie", "ResetForm", "ImportData", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView", "JavaScript")
ALLOWED_NAMED = ("NextPage", "PrevPage", "FirstPage", "LastPage")
FORBIDDEN_ANNOTATIONS = ("3D", "Sound", "Screen", "Movie", "RichMedia")
PRINT, HIDING = 4, 1 | 2 | 32 | 256
PROPERTIES = {"Title": "dc:title", "Author": "dc:creator", "Subject": "dc:description", "Producer": "pdf:Producer", "Keywords": "pdf:Keywords", "Creator": "xmp:CreatorTool"}


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _broken(table: DataFrame, rules: list[tuple[str, bool, Column]]) -> DataFrame:
    """(doc_id, rule, fixable, example): the rules that each row of a table with an ``example`` breaks."""
    each = [F.when(p, F.struct(F.lit(name).alias("rule"), F.lit(fixable).alias("fixable"))) for name, fixable, p in rules]
    return table.select("doc_id", "example", F.explode(F.filter(F.array(*each), lambda r: r.isNotNull())).alias("r")).select("doc_id", "r.*", "example")


def of_documents(documents: DataFrame, part: int = 2, level: str = "B") -> DataFrame:
    """Rules on whole documents: version, has_id, xmp, xmp_part, xmp_level, info (a map), additional_actions, javascript, xfa, need_appearances, layers_bad, marked, structure, lang, intent (components, null: none), rgb, cmyk, gray."""
    d = documents.withColumn("example", F.lit(None).cast("string"))
    has, no_intent = F.col("xmp").isNotNull(), F.col("intent").isNull()
    rules = [
        ("version", True, ~F.startswith("version", F.lit("1."))),
        ("file-id", True, ~_flag("has_id")),
        ("metadata", True, ~has),
        ("identification", True, has & ~(F.col("xmp_part").eqNullSafe(str(part)) & F.upper("xmp_level").eqNullSafe(level))),
        ("additional-actions", True, _flag("additional_actions")),
        ("javascript", True, _flag("javascript")),
        ("xfa", True, _flag("xfa")),
        ("need-appearances", True, _flag("need_appearances")),
        ("layers", True, _flag("layers_bad")),
        ("output-intent-colour", False, ~no_intent & ((_flag("rgb") & (F.col("intent") != 3)) | (_flag("cmyk") & (F.col("intent") != 4)))),
        ("cmyk", False, no_intent & _flag("cmyk")),
        ("output-intent", False, no_intent & _flag("cmyk")),
        ("output-intent", True, no_intent & ~_flag("cmyk") & (_flag("rgb") | _flag("gray"))),
    ]
    if level == "A":
        rules += [("tagged", False, ~(_flag("marked") & _flag("structure"))), ("language", False, F.col("lang").isNull())]
    pairs = F.create_map(*[F.lit(x) for pair in PROPERTIES.items() for x in pair])
    info = documents.where(has).select("doc_id", "xmp", F.explode("info").alias("example", "value")).withColumn("_property", F.element_at(pairs, F.col("example")))
    differs = F.col("_property").isNotNull() & ~(F.contains("xmp", tx.escape_markup(F.trim("value"))) & F.contains("xmp", F.col("_property")))
    return _broken(d, rules).union(_broken(info, [("metadata-match", True, differs)]))


def of_annotations(annotations: DataFrame) -> DataFrame:
    """Rules on annotations: example, subtype, flags, states (keys of the appearance), width, height, additional_actions."""
    shown, flags = ~F.col("subtype").eqNullSafe("Popup"), F.coalesce(F.col("flags"), F.lit(0))
    has = lambda k: F.coalesce(F.array_contains("states", k), F.lit(False))
    return _broken(
        annotations,
        [
            ("annotation-types", False, F.col("subtype").isin(*FORBIDDEN_ANNOTATIONS)),
            ("annotation-flags", True, shown & ((flags.bitwiseAND(PRINT) == 0) | (flags.bitwiseAND(HIDING) != 0))),
            ("appearance-states", True, shown & (has("D") | has("R"))),
            ("annotation-appearance", False, shown & (F.col("width") != 0) & (F.col("height") != 0) & ~F.col("subtype").eqNullSafe("Link") & ~has("N")),
            ("additional-actions", True, _flag("additional_actions")),
        ],
    )


def of_actions(actions: DataFrame) -> DataFrame:
    """Rules on actions: kind, named."""
    named = (F.col("kind") == "Named") & ~F.coalesce(F.col("named"), F.lit("")).isin(*ALLOWED_NAMED)
    bad = actions.withColumn("example", F.when(F.col("kind") == "Named", F.concat_ws(" ", "kind", "named")).otherwise(F.col("kind")))
    return _broken(bad, [("actions", True, F.col("kind").isin(*FORBIDDEN_ACTIONS) | named)])


def of_streams(streams: DataFrame) -> DataFrame:
    """Rules on streams: subtype, filters, interpolate, keys (names in the dictionary)."""
    has = lambda *ks: F.coalesce(F.arrays_overlap("keys", F.array(*map(F.lit, ks))), F.lit(False))
    image, form = F.col("subtype").eqNullSafe("Image"), F.col("subtype").eqNullSafe("Form")
    return _broken(
        streams.withColumn("example", F.lit(None).cast("string")),
        [
            ("lzw", True, F.coalesce(F.array_contains("filters", "LZWDecode"), F.lit(False))),
            ("image-interpolation", True, image & _flag("interpolate")),
            ("image-alternates", True, image & has("Alternates", "OPI")),
            ("postscript", False, F.col("subtype").eqNullSafe("PS") | (form & has("Subtype2", "OPI", "PS"))),
        ],
    )


def of_fonts(fonts: DataFrame, level: str = "B") -> DataFrame:
    """Rules on fonts: example, subtype, embedded, to_unicode, symbolic, named_encoding."""
    rules = [("fonts-embedded", False, ~F.col("subtype").isin("Type0", "Type3") & ~_flag("embedded"))]
    if level != "B":
        unclear = F.col("subtype").isin("Type0", "Type3") | _flag("symbolic") | ~_flag("named_encoding")
        rules.append(("fonts-unicode", False, ~F.startswith("subtype", F.lit("CIDFont")) & ~_flag("to_unicode") & unclear))
    return _broken(fonts, rules)


def of_attachments(files: DataFrame, part: int = 2) -> DataFrame:
    """Rules on embedded files: example, archive (itself an archive file), relationship, mime, unicode_name, listed."""
    if part == 2:
        return _broken(files, [("embedded-files", False, ~_flag("archive"))])
    mime = F.coalesce(F.col("mime").rlike("^[^/]+/[^/]+$"), F.lit(False))
    return _broken(files, [("associated-files", True, ~(_flag("relationship") & mime & _flag("unicode_name") & _flag("listed")))])


def findings(*broken: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, rule, count, fixable, examples): broken rules put together, with up to ``most`` examples. A document without a row keeps all rules. Counts are summed before they are shuffled."""
    rows = reduce(DataFrame.union, broken)
    counts = rows.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("count"), F.bool_and("fixable").alias("fixable"))
    first = F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy("example"))
    few = rows.where("example is not null").select("doc_id", "rule", "example").distinct().withColumn("_n", first).where(F.col("_n") <= most)
    examples = few.groupBy("doc_id", "rule").agg(F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples"))
    return counts.join(examples, ["doc_id", "rule"], "left")
