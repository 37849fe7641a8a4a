"""Reports over structure and accessibility checks: statuses, what was found, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import structure, tagged

#: Tags of a document that are looked at; with more, or with deeper levels, a tree counts as incomplete.
MOST_TAGS = 20_000
#: Pages that are named one by one.
MOST_LISTED = 8


def structure_report(tags: DataFrame) -> DataFrame:
    """(doc_id, check, status, bad): the rules of :func:`structure.structure_checks` with their outcome, whether the tree could be inspected, and what only a person can judge.

    A tree is incomplete with tags without a role, more than 20,000 tags, too many levels or nodes in a cycle; then what no rule found broken is a warning instead of passed.
    """
    looked = tagged.looked_at(tags).withColumn("incomplete", F.col("bare") | F.col("broken") | (F.col("tags") > MOST_TAGS))
    row = lambda check, status, bad: F.struct(F.lit(check).alias("check"), status.alias("status"), bad.alias("bad"))
    rules = [row(r, F.when(F.col(f"`{r}`") > 0, "failed").when(F.col("incomplete"), "warning").otherwise("passed"), F.col(f"`{r}`")) for r in tagged.RULES]
    integrity = row("structure-integrity", F.when(F.col("incomplete"), "failed").otherwise("passed"), F.col("incomplete").cast("long"))
    return looked.select("doc_id", F.inline(F.array(*rules, integrity, row("table-regularity", F.lit("manual"), F.lit(0).cast("long")))))


def listed(pages: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """(doc_id, n, pages): how many pages (doc_id, page) there are, and the first ones in a line with the number of the others. Only those that are shown are gathered."""
    ranked = pages.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    per = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col("page")))).alias("_first"))
    line = F.array_join(F.transform("_first", lambda p: p.cast("string")), ", ")
    return per.select("doc_id", "n", F.when(F.col("n") > most, F.concat(line, F.lit(" and "), F.col("n") - most, F.lit(" more"))).otherwise(line).alias("pages"))


def accessibility_report(documents: DataFrame, pages: DataFrame, fields: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, check, status, detail): the twelve checks of :func:`structure.accessibility_checks`, with the pages, fields, links or values that they are about."""
    bare = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    status = structure.accessibility_checks(documents, pages, fields, links)
    named = lambda check, rows, text: rows.select("doc_id", F.lit(check).alias("check"), text.alias("_detail"))
    untitled = fields.where(bare("tooltip")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    to = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bare("description")).alias("bad"))
    found = named("text", listed(pages.where(bare("text")).select("doc_id", "page")), F.concat(F.lit("pages without text: "), F.col("pages")))
    found = found.unionByName(named("tab-order", listed(pages.where((F.col("annotations") > 0) & ~F.col("tabs").eqNullSafe(F.lit("S"))).select("doc_id", "page")), F.concat(F.lit("pages without a tab order: "), F.col("pages"))))
    found = found.unionByName(named("field-tooltips", untitled, F.concat(F.col("n"), F.lit(" without a tooltip, such as "), F.col("name"))))
    found = found.unionByName(named("link-text", to.where("bad > 0"), F.concat(F.col("bad"), F.lit(" of "), F.col("n"), F.lit(" without a description"))))
    found = found.unionByName(named("title", documents.where(~bare("title")), F.trim("title"))).unionByName(named("language", documents.where(~bare("lang")), F.trim("lang")))
    found = found.unionByName(named("figures", documents.where(F.col("tagged") & (F.col("figures_without") > 0)), F.concat(F.col("figures_without"), F.lit(" of "), F.col("figures"), F.lit(" without alternate text"))))
    return status.join(found, ["doc_id", "check"], "left").select("doc_id", "check", "status", F.coalesce("_detail", F.lit("")).alias("detail"))


def report_page(checks: DataFrame, titles: DataFrame, labels: dict[str, str], note: str) -> DataFrame:
    """(doc_id, html): checks (doc_id, nth, check, status, detail) as a page of its own: the document's title as heading, a note on what checks can't tell, and a table with a caption and heads for
    columns and rows. All text is escaped; nothing is fetched or run."""
    from ..functions import text as tx

    esc = lambda c: tx.escape_markup(F.coalesce(c, F.lit("")))
    label: Column = F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("check")], F.col("check")) if labels else F.col("check")
    line = F.concat(F.lit('<tr><th scope="row">'), esc(label), F.lit("</th><td>"), esc("status"), F.lit("</td><td>"), esc("detail"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("x")))), lambda s: s["x"]), "")
    rows = checks.groupBy("doc_id").agg(body.alias("_rows")).join(titles, "doc_id", "left")
    title = F.coalesce(F.nullif(F.trim(esc("title")), F.lit("")), F.lit("Untitled document"))
    policy = '<meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'">'
    head = F.concat(F.lit(f'<!doctype html><html lang="en"><head><meta charset="utf-8">{policy}<title>'), title, F.lit("</title></head><body><main><h1>"), title, F.lit("</h1><p>"), esc(F.lit(note)), F.lit("</p>"))
    table = F.concat(F.lit('<table><caption>Checks</caption><thead><tr><th scope="col">Check</th><th scope="col">Status</th><th scope="col">Details</th></tr></thead><tbody>'), "_rows", F.lit("</tbody></table></main></body></html>"))
    return rows.select("doc_id", F.concat(head, table).alias("html"))
