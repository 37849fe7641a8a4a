"""Mixing sources to target weights by capped water-filling.

Each source's target is ``least(cap, weight * level)`` words, where the cap is the maximum number of epochs
times the source's words and the level is the one at which the targets add up to the budget: sources that
reach their cap are clamped and what they leave is shared by the others in proportion to their weights. A
source's epochs are then dealt out as whole repetitions of each document plus one fractional repetition, which
goes to the first documents in a seeded hash order; the document at the edge is taken in part, so a source's words
come to its target to the word.

A source may hold any part of the rows: prefix sums run over hash ranges (``3`` hex digits: 4096 a source), and
only the rows of one source and range are ever ordered together. They are rows of an id's hash and a size, counted once and written; texts are never ordered or moved. The
mix itself needs one row a source, its *edge* in the hash order: rows before it take the fractional repetition, those after it don't.

Windows over sources without a partition see one row a source.

Cases: a null text has no words; a null source is a source of its own, after the others; documents without
words take nothing; repeated rows count each, and where several equal ones (id, source and size) lie at the edge, :func:`mix_rows` gives each the same part, rounded down; sources without words have a target
of 0; an empty table gives no rows; other columns are carried by :func:`mix_rows`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Rows of sources up to this size are broadcast; beyond it they are joined by sorting.
BROADCAST_BYTES = 32_000_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    Sorted by cap per weight, the level follows from the first source that does not reach its cap: prefix sums
    of caps before it and of the weights from it on.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("free", F.when((F.col("budget") - F.col("capped")) * F.col("weight") < F.col("cap").cast("double") * F.col("open"), F.struct("budget", "capped", "open")))
    s = s.withColumn("level", F.first("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * (F.col("level.budget") - F.col("level.capped")) / F.col("level.open"))
    return s.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _narrow(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """doc_id, source, size, the place _key in the source's seeded order, its _range, the source's name _source without nulls, and columns named."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"), named.alias("_source"), *more).withColumn("_range", F.substring("_key", 1, 3))


def _starts(rows: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """_source, _range, _start and _words of each range, with source_size, target, whole repetitions and the rest of the source."""
    ranges = rows.groupBy("_source", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("_words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    targets = targets.select(named.alias("_source"), "source_size", "target", whole.alias("whole")).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("source").join(targets, "_source")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row; texts are counted once, where they are read, not shuffled."""
    rows = stored(_narrow(docs, seed))
    within = Window.partitionBy("_source", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(_starts(rows, weights, share, max_epochs), ["_source", "_range"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_before")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def edges(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row a source: _source, whole, edge (_key and size of the row at which its rest ends) and part (the words which that row still gives)."""
    rows = stored(_narrow(docs, seed).select("source", "_source", "_range", "_key", "size").where("size > 0"))
    last = _starts(rows, weights, share, max_epochs).where("_start <= rest and rest < _start + _words").select("_source", "_range", "_start", "whole", "rest")
    same = rows.join(last, ["_source", "_range"]).groupBy("_source", "_key", "size").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("_start", "whole", "rest")))
    within = Window.partitionBy("_source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("_before", F.col("_start") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0)))
    at = placed.where("_before <= rest and rest < _before + n * size")
    return at.select("_source", "whole", F.struct("_key", "size").alias("edge"), F.expr("(rest - _before) div n").alias("part"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of the input's columns, one for each repetition, the last of them cut to the words that are still due.

    A row that takes 1.4 times its words comes once whole and once as its first two fifths; one that takes
    none goes. ``n_chars``, where there is one, follows the text. Rows stay where they are read: a source's row of :func:`edges` says what each of its documents takes.
    """
    ends = stored(edges(docs, weights, share, max_epochs, seed))
    names = ends.agg(F.coalesce(F.sum(F.octet_length("_source") + 100), F.lit(0))).first()[0]
    own = _narrow(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text"), seed, "row")
    dealt = own.join(F.broadcast(ends) if names <= BROADCAST_BYTES else ends, "_source")
    here = F.struct("_key", "size")
    extra = F.when(here < F.col("edge"), F.col("size")).when(here == F.col("edge"), F.col("part")).otherwise(F.lit(0))
    dealt = dealt.withColumn("taken", F.col("whole") * F.col("size") + extra).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = dealt.withColumn("nth", F.explode(F.sequence(F.lit(1), times))).withColumn("due", F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size")))
    text, short = F.col("row").getField("text"), F.col("due") < F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("due").cast("int")), " ")
    new = {"text": F.when(short, part).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length(part)).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return each.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
