"""Reports over what other operators found: fidelity of a smaller file, the first size that will do, redaction counts, contrast, accessibility as a page, form values as XFDF."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# The namespace of XFDF, its elements beside the fields, and the limits of form data.
XFDF = "http://ns.adobe.com/xfdf/"
BESIDE = ("fields", "f", "ids")
_ROOT, _FIELDS, _FIELD, _VALUE = (f"{{{XFDF}}}{t}" for t in ("xfdf", "fields", "field", "value"))
_BESIDE = [f"{{{XFDF}}}{t}" for t in BESIDE]
MOST_BYTES, MOST_FIELDS, MOST_LEVELS, LONGEST_NAME = 2_000_000, 10_000, 32, 1024


def fidelity(before: DataFrame, after: DataFrame, documents_before: DataFrame, documents_after: DataFrame) -> DataFrame:
    """(doc_id, check, passed, number): what of a document stayed the same in another version.

    Pages (doc_id, page, text, annotations, fonts, images) are compared side by side, documents (doc_id, fields, outlines, attachments) as a whole. ``number`` is the count after, for texts that of pages that differ.
    """
    parts = ("text", "annotations", "fonts", "images")
    a, b = (d.select("doc_id", "page", F.struct(*parts).alias(n)) for d, n in ((before, "a"), (after, "b")))
    pages = a.join(b, ["doc_id", "page"], "full").groupBy("doc_id").agg(
        F.count("a").alias("pages_a"),
        F.count("b").alias("pages_b"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a.text").eqNullSafe(F.col("b.text"))).alias("n_text"),
        *[F.sum(F.coalesce(f"b.{p}", F.lit(0))).cast("long").alias(f"n_{p}") for p in parts[1:]],
        *[F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))).alias(f"same_{p}") for p in parts],
    )
    wholes = ("fields", "outlines", "attachments")
    x, y = (d.select("doc_id", *[F.col(w).cast("long").alias(f"{n}_{w}") for w in wholes]) for d, n in ((documents_before, "a"), (documents_after, "b")))
    row = lambda name, passed, n: F.struct(F.lit(name).alias("check"), passed.alias("passed"), n.cast("long").alias("number"))
    checks = [row("pages", F.col("pages_a") == F.col("pages_b"), F.col("pages_b"))]
    checks += [row(p, F.col(f"same_{p}"), F.col(f"n_{p}")) for p in parts]
    checks += [row(w, F.col(f"a_{w}").eqNullSafe(F.col(f"b_{w}")), F.coalesce(f"b_{w}", F.lit(0))) for w in wholes]
    return pages.join(x.join(y, "doc_id", "full"), "doc_id").select("doc_id", F.inline(F.array(*checks)))


def small_enough(candidates: DataFrame, target: int) -> DataFrame:
    """(doc_id, nth, bytes): of candidates (doc_id, nth, bytes, source_bytes) in order, the first under the target, else the smallest, of equal ones the first. A source under the target takes the first candidate; a failed one has no bytes."""
    if target < 1024:
        raise ValueError("a target has 1,024 bytes at least")
    one = F.struct("nth", "bytes")
    fits = (F.col("bytes") < target) | ((F.col("source_bytes") < target) & (F.col("nth") == 1))
    smallest = F.min_by(one, F.struct(F.col("bytes").isNull(), "bytes", "nth"))
    best = F.coalesce(F.min_by(F.when(fits, one), F.when(fits, F.col("nth"))), smallest)
    return candidates.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.nth", "b.bytes")


def redaction_report(marks: DataFrame) -> DataFrame:
    """Counts of what a redaction took from each document: marks (doc_id, page, kind, hidden), kind being glyph, pixels, image, path, annotation, field or form. Hidden annotations count apart, and pages are those with marks that aren't hidden."""
    seen = ~F.coalesce("hidden", F.lit(False))
    kinds = {"glyphs": "glyph", "pixel_images": "pixels", "images": "image", "paths": "path", "annotations": "annotation", "form_fields": "field", "forms": "form"}
    counts = [F.count_if((F.col("kind") == k) & (seen if k == "annotation" else F.lit(True))).alias(n) for n, k in kinds.items()]
    return marks.groupBy("doc_id").agg(F.count_distinct(F.when(seen, F.col("page"))).alias("pages"), *counts, F.count_if((F.col("kind") == "annotation") & ~seen).alias("hidden_annotations"))


def contrast_range(histogram: DataFrame, by: str = "doc_id", cut: float = 0.01, levels: int = 256) -> DataFrame:
    """(by, low, high, stretches): the darkest and brightest levels of each histogram (by, bin, n) beyond which ``cut`` of all lie, and whether there is a range between them to stretch."""
    up = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = histogram.groupBy(by, "bin").agg(F.sum("n").alias("n")).withColumn("_below", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy(by)))
    edge = F.col("_all") * cut
    low = F.coalesce(F.min(F.when(F.col("_below") > edge, F.col("bin"))), F.lit(levels - 1))
    high = F.coalesce(F.max(F.when(F.col("_all") - F.col("_below") + F.col("n") > edge, F.col("bin"))), F.lit(0))
    return s.groupBy(by).agg(low.cast("int").alias("low"), high.cast("int").alias("high")).withColumn("stretches", F.col("high") > F.col("low"))


def accessibility_page(checks: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, html): checks (doc_id, nth, label, status, detail) as an escaped table under the document's title; no scripts, nothing from elsewhere."""
    esc = lambda c: tx.escape_markup(F.coalesce(c, F.lit("")))
    line = F.concat(F.lit("<tr><th>"), esc("label"), F.lit("</th><td>"), esc("status"), F.lit("</td><td>"), esc("detail"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("x")))), lambda s: s["x"]), "")
    rows = checks.groupBy("doc_id").agg(body.alias("rows"))
    title = F.coalesce(F.nullif(esc("title"), F.lit("")), F.lit("Accessibility"))
    return rows.join(titles, "doc_id", "left").select("doc_id", F.concat(F.lit('<!doctype html><html lang="en"><meta charset="utf-8"><title>'), title, F.lit("</title><body><table><tbody>"), "rows", F.lit("</tbody></table></body></html>")).alias("html"))


def form_xfdf(fields: DataFrame) -> DataFrame:
    """(doc_id, xml): values (doc_id, seq, name, values, read_only) as XFDF; read-only fields are left out."""
    each = F.array_join(F.transform("values", lambda v: F.concat(F.lit("<value>"), tx.escape_markup(v), F.lit("</value>"))), "")
    field = F.concat(F.lit('<field name="'), tx.escape_markup("name"), F.lit('">'), each, F.lit("</field>"))
    wanted = F.when(F.col("read_only"), F.lit(None)).otherwise(F.struct("seq", field.alias("x")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(wanted)), lambda s: s["x"]), "")
    return fields.groupBy("doc_id").agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="{XFDF}" xml:space="preserve"><fields>'), body, F.lit("</fields></xfdf>")).alias("xml"))


def _fields(body: str | None) -> tuple[list[tuple[str, list[str]]], str | None]:
    """The fields that hold values in an XFDF text, with their values, and the first (as texts sort) of what is wrong with it."""
    try:
        root = ElementTree.fromstring(body or "")
    except ElementTree.ParseError:
        return [], "not XML"
    leaves, wrong, n, rest = [], set(), 0, [(root, 1, None, None, ())]
    while rest:
        e, depth, over, part, names = rest.pop()
        tag = e.tag
        if depth == 1:
            if tag != _ROOT:
                wrong.add("not XFDF")
        elif depth == 2:
            part, n = tag, n + (tag == _FIELDS)
            if tag not in _BESIDE:
                wrong.add("more than form data")
        elif part == _FIELDS and tag == _FIELD:
            name = e.get("name")
            names = names if len(names) > MOST_LEVELS + 1 else (*names, name)
            if over not in (_FIELDS, _FIELD):
                wrong.add("only plain values")
            elif not 1 <= len(name or "") <= LONGEST_NAME:
                wrong.add("bad field name")
            elif len(names) > MOST_LEVELS + 1:
                wrong.add("fields are nested too deeply")
            nested = [k.tag == _FIELD for k in e]
            if not any(nested):
                leaves.append((".".join(x for x in names if x is not None), [k.text or "" for k in e if k.tag == _VALUE]))
            elif not all(nested):
                wrong.add("values and fields are mixed")
        elif part == _FIELDS and over == _FIELDS:
            wrong.add("not a field")
        elif part == _FIELDS and (over != _FIELD or tag != _VALUE):
            wrong.add("only plain values")
        rest += [(k, depth + 1, tag, part, names) for k in reversed(e)]
    if n != 1:
        wrong.add("not one element of fields")
    if len(leaves) > min(MOST_FIELDS, len({name for name, _ in leaves})):
        wrong.add("fields twice or too many")
    return leaves, min(wrong, default=None)


def xfdf_values(files: DataFrame) -> DataFrame:
    """(doc_id, name, values, error): the fields of XFDF texts (doc_id, body), nested names joined by dots. A text that breaks a rule gives one row with the error and no fields.

    Each text, of two million bytes at most, is read where it is; nothing is shuffled.
    """
    refused = (F.octet_length("body") > MOST_BYTES) | F.col("body").rlike("(?i)<!(DOCTYPE|ENTITY)")
    texts = files.select("doc_id", F.when(refused, None).otherwise(F.col("body")).alias("body"), F.coalesce(refused, F.lit(False)).alias("refused"))
    schema = T.StructType([files.schema["doc_id"], T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def read(batches):
        for batch in batches:
            at, names, values, errors = [], [], [], []
            for i, (body, no) in enumerate(zip(batch.column("body").to_pylist(), batch.column("refused").to_pylist(), strict=True)):
                leaves, error = ([], "not one element of fields") if no else _fields(body)
                for name, held in leaves if error is None else [(None, None)]:
                    at.append(i)
                    names.append(name)
                    values.append(held)
                    errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(errors, pa.string())], schema.names)

    return texts.mapInArrow(read, schema)
