"""Word and character counts of pages and documents, and error rates between texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import cut


def page_insights(items: DataFrame) -> DataFrame:
    """doc_id, page, words, characters, text_status. Words never span items."""
    each = items.select("doc_id", "page", tx.n_words(F.col("str")).alias("w"), tx.n_characters(F.col("str")).alias("c"))
    out = each.groupBy("doc_id", "page").agg(F.sum("w").cast("long").alias("words"), F.sum("c").cast("long").alias("characters"))
    return out.withColumn("text_status", F.when(F.col("characters") > 0, "text").otherwise("none"))


def document_insights(pages: DataFrame, per_page: DataFrame) -> DataFrame:
    """doc_id, pages, words, characters, textless_pages (how many) and first_textless."""
    rows = pages.select("doc_id", "page").join(per_page, ["doc_id", "page"], "left")
    bare = F.coalesce(F.col("characters"), F.lit(0)) == 0
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), F.count_if(bare).alias("textless_pages"), F.min(F.when(bare, F.col("page"))).alias("first_textless"))


def normal(text: Column) -> Column:
    return F.trim(F.lower(tx.collapse(text)))


def character_error(truth: Column, read: Column) -> Column:
    """Edit distance over characters by the truth's length."""
    return F.levenshtein(normal(truth), normal(read)) / F.greatest(F.length(normal(truth)), F.lit(1))


def word_error(truth: Column, read: Column) -> Column:
    """Edit distance over words by the truth's words: each distinct word becomes one character, for the built-in distance; more than 20,000 distinct ones are an error."""
    a, b = (F.filter(F.split(normal(c), " "), lambda w: w != "") for c in (truth, read))
    known = F.array_distinct(F.concat(a, b))
    known = F.when(F.size(known) > 20_000, F.raise_error(F.lit("more than 20,000 distinct words"))).otherwise(known)
    signs = F.lit("".join(chr(0x4E00 + i) for i in range(20_000)))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(signs, F.array_position(known, w).cast("int"), F.lit(1))), "")
    return F.levenshtein(coded(a), coded(b)) / F.greatest(F.size(a), F.lit(1))


def word_list(lines: DataFrame, most: int = 500, longest: int = 200) -> DataFrame:
    """Terms of a list (pos, line): trimmed, each once whatever its case, with the first spelling. An empty list, a term of more than ``longest`` characters and more than ``most`` terms are errors."""
    t = lines.select("pos", F.trim(F.regexp_replace("line", "^\\x{FEFF}|\r", "")).alias("term")).where("term <> ''")
    once = cut(t.groupBy(F.lower("term").alias("k")).agg(F.min("pos").alias("pos"), F.min_by("term", "pos").alias("term")))
    if once.isEmpty():
        raise ValueError("the list is empty")
    if not once.where(F.length("term") > longest).isEmpty():
        raise ValueError(f"a term has at most {longest} characters")
    if once.limit(most + 1).count() > most:
        raise ValueError(f"a list has at most {most} terms")
    return once.select("pos", "term")


def otsu(histogram: DataFrame, by: str = "doc_id") -> DataFrame:
    """The threshold of the largest between-class variance of each histogram (by, bin, n); the first of equal ones."""
    w = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    s = histogram.select(by, "bin", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    spread = F.when((F.col("n0") > 0) & (n1 > 0), F.col("n0").cast("double") * n1 * gap * gap).otherwise(0.0)
    return s.withColumn("v", F.round(spread, 3)).groupBy(by).agg(F.max_by("bin", F.struct(F.col("v"), -F.col("bin"))).alias("threshold"))
