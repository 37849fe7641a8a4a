"""Search: terms, patterns, addresses and passages over pages (doc_id, page, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

MAX_PATTERN, MAX_NESTING = 1024, 50
#: Terms up to this size are looked for in one pass.
TERM_BYTES = 8_000_000


def find_text(pages: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, match_marks: bool = False) -> DataFrame:
    """One row a match: doc_id, page, nth (from 1, on its page), start (from 0), match, snippet.

    Letters with and without marks are one unless ``match_marks``; matches do not overlap. Pages without a match leave before any place is worked out.
    """
    if not query:
        raise ValueError("an empty query matches nothing")
    norm = lambda c: c if match_marks else tx.fold_marks(c)
    fold = lambda c: c if case_sensitive else F.lower(c)
    plain = query if match_marks else query.translate(str.maketrans(tx.MARKED, tx.PLAIN))
    want = plain if case_sensitive else plain.lower()
    text = fold(norm(F.col("text")))
    pattern = tx.literal(want)
    if whole_word:
        pattern = (tx.EDGE_BEFORE if re.match(r"\w", want) else "") + pattern + (tx.EDGE_AFTER if re.search(r"\w$", want) else "")
    hits = pages.where(F.contains(text, F.lit(want))).select("*", F.posexplode(tx.match_starts(text, pattern)).alias("_nth", "_hit"))
    start, size = F.col("_hit.start"), F.length("_hit.text")
    return hits.select("doc_id", "page", (F.col("_nth") + 1).alias("nth"), start.alias("start"), F.substring("text", start + 1, size).alias("match"), tx.snippet(F.col("text"), start, size).alias("snippet"))


def first_results(matches: DataFrame, limit: int = 250) -> DataFrame:
    """The first matches in reading order, for display; their total number is not bounded by it."""
    return matches.orderBy("doc_id", "page", "nth").limit(limit)


def _lists(terms: DataFrame) -> list[list[str]]:
    """The distinct terms, in lists of about ``TERM_BYTES`` at most: one for any list that a person makes."""
    total = terms.agg(F.sum(F.octet_length("term") + 1)).first()[0] or 0
    n = -(-total // TERM_BYTES)
    lists = ([r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).orderBy("term").collect()] for i in range(n))
    return [words for words in lists if words]


def held_terms(items: DataFrame, terms: DataFrame, text: str, *more: str) -> DataFrame:
    """Item columns, term and hits (matches that don't overlap) of each item and term that it holds, as they are written. Further columns in ``more`` hold texts in which a term counts too, without being counted.

    Every item is read once for each list of terms, by one automaton of all terms in it; items and terms are never joined.
    """
    out = None
    for words in _lists(terms.select("term").where("term <> ''").distinct()):
        names, places = [*items.columns, "term", "hits"], [items.columns.index(c) for c in (text, *more)]

        def look(batches, words=words, names=names, places=places):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for i, w in enumerate(words):
                machine.add_word(w, (i, len(w)))
            machine.make_automaton()
            for b in batches:
                rows, terms_, hits = [], [], []
                for r, texts in enumerate(zip(*(b.column(i).to_pylist() for i in places), strict=True)):
                    count, after = {}, {}
                    for n, t in enumerate(texts):
                        for end, (i, size) in machine.iter(t) if t else ():
                            if n:
                                count.setdefault(i, 0)
                            elif end - size >= after.get(i, -1):
                                count[i], after[i] = count.get(i, 0) + 1, end
                    rows += [r] * len(count)
                    terms_ += [words[i] for i in count]
                    hits += count.values()
                if rows:
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(terms_, pa.string()), pa.array(hits, pa.int32())], names)

        kind = T.StructType([*items.schema.fields, T.StructField("term", T.StringType()), T.StructField("hits", T.IntegerType())])
        found = items.mapInArrow(look, kind)
        out = found if out is None else out.unionByName(found)
    return items.withColumn("term", F.lit("")).withColumn("hits", F.lit(0)).limit(0) if out is None else out


def find_terms(items: DataFrame, terms: DataFrame, text: str = "str") -> DataFrame:
    """Items that hold a term (table ``terms``: term), whatever its case: item columns, term, hits."""
    low = terms.select(F.lower("term").alias("term"))
    return held_terms(items.withColumn("_low", F.lower(F.col(text))), low, "_low").drop("_low")


def _nesting(pattern: str) -> int:
    """The deepest nesting of groups."""
    deep = now = 0
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]|[()]", pattern, re.S):
        now += {"(": 1, ")": -1}.get(token, 0)
        deep = max(deep, now)
    return deep


def check_pattern(pattern: str) -> str:
    """A pattern that takes time linear in any text, or an error: no look-around and no back-references, 1 to 1,024 bytes, groups at most 50 deep, bounded repeats of 1,000 at most, no empty match.

    Classes such as ``\\d``, ``\\w`` and ``\\b`` know ASCII only; ``\\pL`` and the like know all letters.
    """
    if not pattern.strip() or len(pattern.encode()) > MAX_PATTERN:
        raise ValueError(f"a pattern has 1 to {MAX_PATTERN} bytes and isn't blank")
    if _nesting(pattern) > MAX_NESTING:
        raise ValueError(f"groups are nested more than {MAX_NESTING} deep")
    try:
        empty = pc.match_substring_regex(pa.array([""]), f"(?:{pattern})")[0].as_py()
    except pa.ArrowInvalid as e:
        raise ValueError(f"not a pattern without look-around and back-references: {e}") from e
    if empty:
        raise ValueError("the pattern matches empty text")
    return pattern


def _unused(texts: pa.Array) -> tuple[str, str]:
    """Two characters that are in none of these texts."""
    used = set().union(*(set(t) for t in texts.to_pylist())) if len(texts) else set()
    free = (chr(c) for c in [*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900), *range(0xF0000, 0x110000)] if chr(c) not in used)
    return next(free), next(free)


def spans(texts: pa.Array, pattern: str) -> Iterator[tuple[int, int, int, str]]:
    """(row, number from 0, start, text) of the matches that don't overlap, leftmost first, found by Arrow's automaton: two marks are put around all matches in one pass."""
    rows = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False))
    held = texts.take(rows)
    left, right = _unused(held)
    marked = pc.replace_substring_regex(held, f"({pattern})", f"{left}\\1{right}")
    for row, text in zip(rows.to_pylist(), marked.to_pylist(), strict=True):
        before, *found = text.split(left)
        at = len(before)
        for n, piece in enumerate(found):
            match, _, gap = piece.partition(right)
            yield row, n, at, match
            at += len(match) + len(gap)


def find_pattern(pages: DataFrame, pattern: str, ignore_case: bool = False, accept=None) -> DataFrame:
    """doc_id, page, nth, start, text of each match of a pattern (see :func:`check_pattern`). ``accept`` maps the matched text to a boolean column.

    Patterns come from people, so they run by an automaton over Arrow batches and not by one that goes back and forth: no text and pattern take more than linear time or deep recursion.
    """
    p = f"(?{'i' if ignore_case else ''}:{check_pattern(pattern)})"
    schema = T.StructType([*(pages.schema[c] for c in ("doc_id", "page")), T.StructField("nth", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(spans(b.column("text"), p))
            if found:
                row, nth, start, text = zip(*found, strict=True)
                keys = b.select(["doc_id", "page"]).take(pa.array(row, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*keys, pa.array([n + 1 for n in nth], pa.int32()), pa.array(start, pa.int32()), pa.array(text, pa.string())], schema.names)

    rows = pages.select("doc_id", "page", "text").mapInArrow(look, schema)
    return rows if accept is None else rows.where(accept(F.col("text")))


def url_of(raw: Column) -> Column:
    """An address as found in prose, without the sentence's marks; a closing bracket stays where it closes one of its own."""
    t = F.regexp_replace(raw, r"[.,;:!?'\"\]]+$", "")
    lone = t.endswith(")") & (F.size(F.split(t, r"\(", -1)) < F.size(F.split(t, r"\)", -1)))
    t = F.when(lone, F.regexp_replace(F.regexp_replace(t, r"\)+$", ""), r"[.,;:!?'\"\]]+$", "")).otherwise(t)
    return F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)


def find_urls(pages: DataFrame) -> DataFrame:
    """doc_id, page, nth, url of each web address with a dot in its host."""
    hits = pages.where(F.contains(F.lower("text"), F.lit("http")) | F.contains(F.lower("text"), F.lit("www."))).select("doc_id", "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)(?:https?://|www\.)[^\s<>\"'`{}|\\^]+"), F.lit(0))).alias("_nth", "_raw"))
    return hits.select("doc_id", "page", (F.col("_nth") + 1).alias("nth"), url_of(F.col("_raw")).alias("url")).where(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).contains("."))


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower()) if len(w) >= 2))


def passages(pages: DataFrame, least: int = 60) -> DataFrame:
    """doc_id, page, seq, passage: sentences of a page put together until they have ``least`` characters."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    sentences = F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")
    start = F.struct(F.lit("").alias("open"), F.filter(F.array(F.lit("")), lambda x: F.lit(False)).alias("done"))

    def put(state: Column, s: Column) -> Column:
        grown = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        full = F.length(grown) >= least
        return F.struct(F.when(full, "").otherwise(grown).alias("open"), F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"))

    built = F.aggregate(sentences, start, put, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return pages.select("doc_id", "page", F.posexplode(built).alias("seq", "passage"))


def score_passages(passages_: DataFrame, query: str) -> DataFrame:
    """Passages with at least half of the query's terms: matched, score (ten a term found and one an occurrence), excerpt."""
    terms = query_terms(query)
    if not terms:
        return passages_.withColumn("matched", F.lit(0)).withColumn("score", F.lit(0)).withColumn("excerpt", F.lit("")).limit(0)
    low = F.lower("passage")
    counts = [F.size(F.split(low, tx.literal(t), -1)) - 1 for t in terms]
    matched = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    rows = passages_.withColumn("matched", matched).where(F.col("matched") >= (len(terms) + 1) // 2)
    return rows.withColumn("score", F.col("matched") * 10 + sum(counts, F.lit(0))).withColumn("excerpt", F.substring("passage", 1, 320))


def top_passages(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id", "page", "seq").limit(k)
