"""Sources in exchange formats: comments, form data and bookmarks as JSON or XML text, with an error column instead of a crash (or a strict mode that raises)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables

COMMENT = "struct<format:string,version:int,pages:int,comments:array<struct<id:string,page:int,type:string,text:string,rect:array<double>>>>"
COMMENT_TYPES = ("Text", "FreeText", "Highlight", "Underline", "StrikeOut", "Square", "Circle", "Ink")
FORM = "struct<format:string,version:int,fields:array<struct<name:string,type:string,value:string>>>"
BOOKMARK = "struct<format:string,version:int,bookmarks:array<struct<id:string,parent:string,title:string,page:int>>>"


def comments(files: DataFrame, strict: bool = False) -> DataFrame:
    """Comments of files (doc_id, pages, body): doc_id, id, page, type, text, rect, error. A file that is no comment exchange gives one row with the error."""
    j = F.from_json("body", COMMENT)
    bad = F.when(j.isNull() | (~j["format"].eqNullSafe(F.lit("document-comments"))), "not a comment exchange").when(~j["version"].isin(1, 2), "unknown version").when(j["pages"] != F.col("pages"), "another document")
    rows = files.select("doc_id", "pages", bad.alias("file_error"), F.explode_outer(F.when(bad.isNull(), j["comments"])).alias("c"))
    twice = F.count(F.lit(1)).over(_per("doc_id", "c.id")) > 1
    error = F.coalesce(
        F.col("file_error"),
        F.when(F.col("c").isNull(), F.lit(None).cast("string")).when(~F.col("c.type").isin(*COMMENT_TYPES), "unknown type").when(~F.coalesce(F.col("c.page").between(1, F.col("pages")), F.lit(False)), "no such page").when(F.coalesce(F.size("c.rect"), F.lit(-1)) != 4, "bad rectangle").when(twice, "id used twice"),
    )
    out = rows.select("doc_id", "c.*", error.alias("error")).where(F.col("error").isNotNull() | F.col("id").isNotNull())
    return _strict(out) if strict else out


def form_values(files: DataFrame, strict: bool = False) -> DataFrame:
    """Field values of files (doc_id, body): doc_id, name, type, value, error."""
    j = F.from_json("body", FORM)
    bad = F.when(j.isNull() | (~j["format"].eqNullSafe(F.lit("form-data"))), "not form data").when(F.size(j["fields"]) > 10_000, "too many fields")
    rows = files.select("doc_id", bad.alias("file_error"), F.explode_outer(F.when(bad.isNull(), j["fields"])).alias("f"))
    twice = F.count(F.lit(1)).over(_per("doc_id", "f.name")) > 1
    error = F.coalesce(F.col("file_error"), F.when(F.length("f.name") > 1024, "name too long").when(F.length("f.value") > 65_536, "value too long").when(twice & F.col("f.name").isNotNull(), "name used twice"))
    out = rows.select("doc_id", "f.*", error.alias("error")).where(F.col("error").isNotNull() | F.col("name").isNotNull())
    return _strict(out) if strict else out


def bookmarks(files: DataFrame, strict: bool = False) -> DataFrame:
    """Bookmarks of files (doc_id, body) as an adjacency list: doc_id, id, parent, title, page, error."""
    j = F.from_json("body", BOOKMARK)
    bad = F.when(j.isNull() | (~j["format"].eqNullSafe(F.lit("bookmarks"))) | (~j["version"].eqNullSafe(F.lit(1))), "not bookmarks")
    rows = files.select("doc_id", bad.alias("file_error"), F.explode_outer(F.when(bad.isNull(), j["bookmarks"])).alias("b"))
    error = F.coalesce(F.col("file_error"), F.when(~F.coalesce(F.length("b.title").between(1, 1000), F.lit(False)) & F.col("b").isNotNull(), "bad title").when(F.col("b.page") < 1, "no such page"))
    out = rows.select("doc_id", "b.*", error.alias("error")).where(F.col("error").isNotNull() | F.col("id").isNotNull())
    return _strict(out) if strict else out


NESTED = "struct<format:string,version:int,bookmarks:array<string>>"
ENTRY = "struct<title:string,page:int,children:array<string>>"
#: Levels, bookmarks and bytes of a file.
MOST_NESTED, MOST_BOOKMARKS, MOST_JSON = 32, 10_000, 2_000_000


def bookmark_tree(files: DataFrame, most: int | None = MOST_BOOKMARKS, most_bytes: int | None = MOST_JSON) -> DataFrame:
    """Nested bookmarks of files (doc_id, body): doc_id, path (places from the top down, from 0), title, page, error.

    A level of children is taken apart at a time, each as the text that it is. A file that isn't bookmarks, is too large or nests too deep, and one with a bad title or page, gives one row with the
    error and no bookmarks. Files from elsewhere have at most ``most`` bookmarks and ``most_bytes``; None, for what one has written oneself, is no limit.
    """
    tables = Tables(files.sparkSession)
    j = F.from_json("body", NESTED)
    fits = F.octet_length("body") <= most_bytes if most_bytes is not None else F.lit(True)
    good = fits & j["format"].eqNullSafe(F.lit("bookmarks")) & j["version"].eqNullSafe(F.lit(1)) & j["bookmarks"].isNotNull()
    read = tables.keep(files.select("doc_id", F.monotonically_increasing_id().alias("_f"), F.when(F.coalesce(good, F.lit(False)), j["bookmarks"]).alias("_below")))
    wrong = read.where("_below is null").select("_f", F.lit("not bookmarks").alias("error"))
    at, out = read.where("_below is not null").select("doc_id", "_f", F.array().cast("array<int>").alias("path"), "_below"), None
    for level in range(MOST_NESTED + 2):
        each = at.select("doc_id", "_f", "path", F.posexplode("_below").alias("_n", "_x"))
        entry = F.from_json("_x", ENTRY)
        bad = ~F.coalesce(F.length(F.trim(entry["title"])).between(1, 1000) & (F.length(entry["title"]) <= 1000), F.lit(False))
        error = F.when(F.lit(level > MOST_NESTED), "nested too deep").when(bad, "bad title").when(entry["page"] < 1, "no such page")
        rows = tables.keep(each.select("doc_id", "_f", F.concat("path", F.array("_n")).alias("path"), entry["title"].alias("title"), entry["page"].alias("page"), entry["children"].alias("_below"), error.alias("error")))
        out = rows if out is None else out.unionByName(rows)
        at = rows.where("error is null and _below is not null")
        if level > MOST_NESTED or at.isEmpty():
            break
    faults = wrong.unionByName(out.where("error is not null").select("_f", "error"))
    if most is not None:
        faults = faults.unionByName(out.groupBy("_f").count().where(F.col("count") > most).select("_f", F.lit("too many bookmarks").alias("error")))
    first = faults.groupBy("_f").agg(F.min("error").alias("error"))
    broken = read.join(first, "_f").select("doc_id", F.lit(None).cast("array<int>").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), "error")
    return out.join(first, "_f", "left_anti").select("doc_id", "path", "title", "page", F.lit(None).cast("string").alias("error")).unionByName(broken)


def xfdf_marks(files: DataFrame) -> DataFrame:
    """Annotations of XFDF texts (doc_id, pages, body): tag, page (from 1), rect, contents. Texts with a document type or entities or of more than 10 MB are an error; pages out of range are skipped."""
    bad = F.col("body").rlike("(?i)<!(DOCTYPE|ENTITY)") | (F.length("body") > 10_000_000)
    safe = files.withColumn("body", F.when(bad, F.raise_error(F.lit("document types, entities and texts of more than 10 MB are refused"))).otherwise(F.col("body")))
    hits = safe.select("doc_id", "pages", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:text|highlight|underline|strikeout|freetext)\b[^>]*>"), F.lit(0))).alias("x"))
    part = lambda name: F.regexp_extract("x", rf'\b{name}="([^"]*)"', 1)
    rect = F.transform(F.split(part("rect"), ","), lambda v: F.trim(v).try_cast("double"))
    rows = hits.select("doc_id", "pages", F.regexp_extract("x", r"^<(\w+)", 1).alias("tag"), (part("page").try_cast("int") + 1).alias("page"), rect.alias("rect"), part("name").alias("name"))
    return rows.where((F.size("rect") == 4) & ~F.exists("rect", lambda v: v.isNull()) & F.col("page").between(1, F.col("pages"))).drop("pages")


def text_pages(files: DataFrame, width: int = 80, per_page: int = 50) -> DataFrame:
    """Plain texts (doc_id, text) as pages: line ends unified, tabs as four spaces, form feeds break pages, lines wrapped at words: doc_id, page, line, text."""
    flat = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\t"), F.lit("    "))
    parts = files.select("doc_id", F.posexplode(F.split(flat, "\f", -1)).alias("part", "t"))
    lines = parts.select("doc_id", "part", F.posexplode(F.split("t", "\n", -1)).alias("n", "s"))
    wrapped = F.regexp_extract_all(F.concat("s", F.lit(" ")), F.lit(rf"\S{{{width},}}?(?=\s)|.{{1,{width}}}(?=\s)|\S{{{width}}}"), F.lit(0))
    rows = lines.select("doc_id", "part", "n", F.posexplode(F.when(F.length("s") <= width, F.array("s")).otherwise(F.transform(wrapped, lambda x: F.trim(x)))).alias("k", "text"))
    nth = F.row_number().over(_per("doc_id", "part").orderBy("n", "k")) - 1
    numbered = rows.withColumn("_p", F.floor(nth / per_page)).withColumn("line", (nth % per_page + 1).cast("int"))
    page = F.dense_rank().over(_per("doc_id").orderBy("part", "_p"))
    return numbered.select("doc_id", page.alias("page"), "line", "text")


def _per(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _strict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("error")))
