"""Audits over objects, links, glyphs, fills, tags and redactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import held_terms

#: Lists of terms up to this length are broadcast; beyond it they are joined by sorting.
MAX_TERMS = 100_000


def space_audit(objects: DataFrame) -> DataFrame:
    """(doc_id, category, objects, bytes): what an object was assigned to counts first, then its subtype and type; where there is a column ``has_title``, objects with a title belong to the bookmarks."""
    kind, sub = F.col("type"), F.col("subtype")
    titled = F.coalesce(F.col("has_title"), F.lit(False)) if "has_title" in objects.columns else F.lit(False)
    category = (
        F.when(F.col("assigned").isNotNull(), F.col("assigned"))
        .when(sub == "Image", "Images")
        .when(sub == "Form", "Graphics and forms")
        .when(kind.isin("Font", "FontDescriptor"), "Fonts")
        .when(kind == "Annot", "Comments and fields")
        .when(kind.isin("StructElem", "StructTreeRoot", "MCR", "OBJR"), "Structure tags")
        .when(kind == "Metadata", "Metadata")
        .when(kind.isin("EmbeddedFile", "Filespec"), "Attachments")
        .when(kind.isin("Outlines", "Action") | titled, "Bookmarks and links")
        .when(kind.isin("XRef", "ObjStm", "Pages", "Page", "Catalog"), "Document structure")
        .otherwise("Other")
    )
    return objects.groupBy("doc_id", category.alias("category")).agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))


def link_inventory(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts a document: total, web, internal, broken and other links (doc_id, uri, has_dest, target_page); a destination on no page is broken."""
    there = pages.select("doc_id", F.col("page").alias("target_page"), F.lit(True).alias("_ok")).distinct()
    rows = links.join(there, ["doc_id", "target_page"], "left")
    inner = F.col("has_dest")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~inner & F.col("uri").isNotNull()).alias("web"),
        F.count_if(inner & F.col("_ok").isNotNull()).alias("internal"),
        F.count_if(inner & F.col("_ok").isNull()).alias("broken"),
        F.count_if(~inner & F.col("uri").isNull()).alias("other"),
    )


def broken_bookmarks(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, id, has_dest, target_page) whose destination is on no page."""
    there = pages.select("doc_id", F.col("page").alias("target_page")).distinct()
    return bookmarks.where("has_dest").join(there, ["doc_id", "target_page"], "left_anti").select(*bookmarks.columns)


def without_broken(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """All bookmarks, with dead destinations cleared: titles and what hangs below them stay. Adds cleared."""
    there = pages.select("doc_id", F.col("page").alias("target_page"), F.lit(True).alias("_ok")).distinct()
    dead = F.col("has_dest") & F.col("_ok").isNull()
    rows = bookmarks.join(there, ["doc_id", "target_page"], "left").withColumn("cleared", F.coalesce(dead, F.lit(False)))
    fresh = {"has_dest": F.col("has_dest") & ~F.col("cleared"), "target_page": F.when(~F.col("cleared"), F.col("target_page"))}
    return rows.select(*(fresh.get(c, F.col(c)).alias(c) for c in bookmarks.columns), "cleared")


def without_links(links: DataFrame, pages: DataFrame, mode: str = "broken") -> DataFrame:
    """Links that stay: none for `all`; for `broken`, those whose destination is on a page."""
    if mode == "all":
        return links.limit(0)
    there = pages.select("doc_id", F.col("page").alias("target_page")).distinct()
    return links.where(~F.col("has_dest")).unionByName(links.where("has_dest").join(there, ["doc_id", "target_page"], "left_semi").select(*links.columns))


def exact_duplicates(streams: DataFrame, content: str, key: str) -> DataFrame:
    """(key, keeps): each stream with the first of those with equal content, by hash; only hashes and keys are shuffled."""
    hashed = streams.select(key, F.sha2(F.col(content), 256).alias("_h"))
    first = hashed.groupBy("_h").agg(F.min(key).alias("keeps"))
    return hashed.join(first, "_h").select(key, "keeps")


def cover_ups(glyphs: DataFrame, fills: DataFrame, slack: float = 0.5) -> DataFrame:
    """Filled rectangles that hide glyphs painted before them: (doc_id, page, fill, characters, sample of 60)."""
    f = fills.select("doc_id", "page", "fill", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], F.col("paint_order").alias("_o"))
    inside = (F.col("x0") >= F.col("_x0") - slack) & (F.col("x1") <= F.col("_x1") + slack) & (F.col("y0") >= F.col("_y0") - slack) & (F.col("y1") <= F.col("_y1") + slack)
    hidden = glyphs.join(f, ["doc_id", "page"]).where(inside & (F.col("paint_order") < F.col("_o")))
    first = F.array_sort(F.collect_list(F.struct("paint_order", "text")))
    return hidden.groupBy("doc_id", "page", "fill").agg(F.count(F.lit(1)).alias("characters"), F.substring(F.array_join(F.transform(first, lambda g: g["text"]), ""), 1, 60).alias("sample"))


def redaction_residual(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """What is still within redacted regions: (doc_id, page, region, residual)."""
    r = regions.select("doc_id", "page", "region", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1"))
    return glyphs.join(r, ["doc_id", "page"]).where(over).groupBy("doc_id", "page", "region").agg(F.count(F.lit(1)).alias("residual"))


def residual_terms(pages: DataFrame, terms: DataFrame, long_term: int = 8) -> DataFrame:
    """(term, pages): terms that pages still hold, white space collapsed; long ones also without any."""
    t = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    flat, bare = F.lower(F.regexp_replace("text", r"\s+", " ")), F.lower(F.regexp_replace("text", r"\s+", ""))
    rows = pages.select("doc_id", "page", flat.alias("flat"), bare.alias("bare"))
    long = t.where(F.length("term") >= long_term).select("term", F.regexp_replace("term", r"\s+", "").alias("_bare"))
    whole = held_terms(rows.select("doc_id", "page", "flat"), t, "flat").select("doc_id", "page", "term")
    packed = held_terms(rows.select("doc_id", "page", "bare"), long.select(F.col("_bare").alias("term")), "bare").select("doc_id", "page", F.col("term").alias("_bare"))
    both = whole.unionByName(packed.join(F.broadcast(long) if long.count() <= MAX_TERMS else long, "_bare").select("doc_id", "page", "term")).distinct()
    return both.groupBy("term").agg(F.count(F.lit(1)).alias("pages"))


def redact(pages: DataFrame, terms: list[str], mark: str = "█") -> DataFrame:
    """Pages with the terms masked, whatever their case; check the result with :func:`residual_terms`, which shares no code with this."""
    out = F.col("text")
    for t in terms:
        out = F.regexp_replace(out, "(?i)\\Q" + t.replace("\\E", "") + "\\E", mark * len(t))
    return pages.withColumn("text", out)


def heading_skips(headings: DataFrame) -> DataFrame:
    """(doc_id, skips): headings more than one level below the heading before."""
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("seq"))
    return headings.withColumn("_b", F.coalesce(before, F.lit(0))).groupBy("doc_id").agg(F.count_if(F.col("level") > F.col("_b") + 1).alias("skips"))


def untagged(operators: DataFrame) -> DataFrame:
    """(doc_id, page, untagged): painting operators (op: begin, end or paint) outside marked content."""
    step = F.when(F.col("op") == "begin", 1).when(F.col("op") == "end", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return operators.withColumn("_d", depth).groupBy("doc_id", "page").agg(F.count_if((F.col("op") == "paint") & (F.col("_d") <= 0)).alias("untagged"))


def first_images(images: DataFrame, least: int = 1) -> DataFrame:
    """Images (doc_id, page, seq, ref, width, height) once a document, where they are first seen; only then are small ones left out. Adds nth on the page."""
    first = F.row_number().over(Window.partitionBy("doc_id", "ref").orderBy("page", "seq"))
    kept = images.withColumn("_n", first).where("_n = 1").drop("_n").where((F.col("width") >= least) & (F.col("height") >= least))
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))


def accessibility(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, check, status, detail) of checks on title, language and text layer; details name the first eight pages."""
    bare = pages.where("trim(text) = ''").groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("p"))
    d = documents.join(bare, "doc_id", "left")
    listed = F.concat(F.array_join(F.slice("p", 1, 8), ", "), F.when(F.size("p") > 8, F.format_string(" and %d more", F.size("p") - 8)).otherwise(""))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), F.when(ok, "pass").otherwise("fail").alias("status"), detail.alias("detail"))
    checks = F.array(
        row("title", F.coalesce(F.trim("title"), F.lit("")) != "", F.coalesce("title", F.lit(""))),
        row("language", F.coalesce(F.col("lang"), F.lit("")).rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"), F.coalesce("lang", F.lit(""))),
        row("text", F.col("p").isNull(), F.coalesce(listed, F.lit(""))),
    )
    return d.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.*")


def rule_findings(objects: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(doc_id, rule, count, examples): archive rules as SQL predicates over the object table that say what breaks them; up to five examples."""
    hits = F.filter(F.array(*[F.when(F.expr(p), F.lit(name)) for name, p in rules.items()]), lambda r: r.isNotNull())
    w = Window.partitionBy("doc_id", "rule").orderBy("obj_id")
    rows = objects.select("doc_id", "obj_id", F.explode(hits).alias("rule")).withColumn("_n", F.row_number().over(w))
    return rows.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.col("obj_id")))), ",").alias("examples"))


def useful_compression(before, after, faithful, discards=None, version=None):
    """Whether a compressed file is worth keeping: faithful, and one percent and a kibibyte smaller, or changed on purpose."""
    saved = before - after
    enough = saved >= F.greatest(before * 0.01, F.lit(1024))
    wanted = [c for c in (discards, version) if c is not None]
    for c in wanted:
        enough = enough | c
    return faithful & enough
