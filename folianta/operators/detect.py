"""Sensitive data in text items: candidates of each kind, and the resolution of overlaps in the order of kinds.

Each kind's candidates are found and checked by expressions. An earlier kind wins where candidates overlap, which is decided candidate after candidate, so a fold over the item's own
candidates resolves it; an item's candidates are few, and items never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as tx

B, A = tx.EDGE_BEFORE, tx.EDGE_AFTER
KINDS = ("email", "ssn", "card", "iban", "date", "phone")
# The first letters of months.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _phone_ok(t: Column) -> Column:
    n = F.length(F.regexp_replace(t, "[^0-9]", ""))
    bracket = ~t.startswith("(") | t.rlike(r"^\([0-9]{2,4}\)")
    return bracket & ((t.startswith("+") & n.between(8, 15)) | (n.between(10, 11) & t.rlike("[ ().-]")))


#: A whole run of an address's first part with its @, and what may be its domain; each run is looked at once, so no text makes it recurse or go back.
_ADDRESS = r"(?<![A-Za-z0-9_.%+-])[A-Za-z0-9_.%+-]++@(?=([A-Za-z0-9_.-]*+))"


def _addresses(text: Column, rank: int) -> Column:
    """Addresses around each @: the domain ends with a letter or digit, its labels aren't empty, and the last one is two letters or more."""
    domains = F.transform(F.regexp_extract_all(text, F.lit(_ADDRESS), F.lit(1)), lambda d: F.rtrim(d, F.lit("_.-")))
    both = F.arrays_zip(tx.match_starts(text, _ADDRESS).alias("m"), domains.alias("d"))
    ok = lambda d: d.rlike("^[A-Za-z0-9.-]+$") & d.contains(".") & ~d.contains("..") & ~d.startswith(".") & F.substring_index(d, ".", -1).rlike("^[A-Za-z]{2,}$")
    whole = F.transform(F.filter(both, lambda x: ok(x["d"])), lambda x: F.struct(x["m"]["start"].cast("int").alias("start"), F.concat(x["m"]["text"], x["d"]).alias("text")))
    return F.transform(whole, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))


# Patterns of the kinds, in the order in which they win.
#: (kind, pattern, or None for addresses, test of the matched text, a cheap text that every match has, or None), in order of precedence.
RULES = (
    ("email", None, None, "@"),
    ("ssn", rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{A}", checks.ssn, "-"),
    ("card", rf"{B}[0-9](?:[ -]?[0-9]){{12,18}}{A}", checks.luhn, None),
    ("iban", rf"(?i){B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{A}", checks.iban, None),
    ("date", rf"{B}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{A}", lambda t: F.lit(True), "-"),
    ("date", rf"{B}[0-9]{{1,2}}([/.-])[0-9]{{1,2}}\1(?:[0-9]{{4}}|[0-9]{{2}}){A}", lambda t: F.lit(True), None),
    ("date", rf"(?i){B}[a-z]{{3,9}}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}{A}", lambda t: F.lower(t).rlike(f"^({MONTHS})"), None),
    ("date", rf"(?i){B}[0-9]{{1,2}} [a-z]{{3,9}}\.? [0-9]{{4}}{A}", lambda t: F.lower(t).rlike(f"^[0-9]+ ({MONTHS})"), None),
    ("phone", rf"(?:\+|\(|{B})[0-9][0-9 ().-]{{5,18}}[0-9]{A}", _phone_ok, None),
)


def _candidates(text: Column, i: int) -> Column:
    """Array of (rank, start, end, text) of a rule's accepted matches."""
    _, pattern, accept, needs = RULES[i]
    found = _addresses(text, i) if pattern is None else F.transform(F.filter(tx.match_starts(text, pattern), lambda m: accept(m["text"])), lambda m: F.struct(F.lit(i).alias("rank"), m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), m["text"].alias("text")))
    there = text.rlike(pattern) if needs is None else F.contains(text, F.lit(needs))
    return F.when(there, found).otherwise(F.filter(F.array(F.struct(F.lit(i).alias("rank"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))), lambda x: F.lit(False)))


def candidates(items: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Accepted matches of one kind before overlaps are resolved: the items' columns, start, match."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    each = F.flatten(F.array(*[_candidates(F.col(text), i) for i, r in enumerate(RULES) if r[0] == kind]))
    return items.withColumn("_m", F.explode(each)).withColumn("start", F.col("_m.start")).withColumn("match", F.col("_m.text")).drop("_m")


def _free(kept: Column, found: Column) -> Column:
    """What is kept and the matches of the next rule that overlap nothing that is kept, neither before them nor after them; both are in the order of starts."""
    event = lambda old: lambda m: F.struct(m["start"].alias("start"), F.lit(not old).alias("new"), m["end"].alias("end"), m["rank"].alias("rank"), m["text"].alias("text"))
    both = F.array_sort(F.concat(F.transform(kept, event(True)), F.transform(found, event(False))))
    none = F.lit(2**31 - 1)
    last = F.struct(none.alias("next"), F.struct(F.lit(0).alias("start"), F.lit(True).alias("new"), F.lit(0).alias("end"), F.lit(0).alias("rank"), F.lit("").alias("text")).alias("m"))
    ahead = F.reverse(tx.scan(F.reverse(both), last, lambda s, m: F.struct(F.when(m["new"], s["next"]).otherwise(m["start"]).alias("next"), m.alias("m"))))
    ok = lambda s, x: ~x["m"]["new"] | ((s["reach"] <= x["m"]["start"]) & (x["next"] >= x["m"]["end"]))
    first = F.struct(F.lit(0).alias("reach"), F.lit(False).alias("ok"), last["m"].alias("m"))
    seen = tx.scan(ahead, first, lambda s, x: F.struct(F.when(ok(s, x), F.greatest(s["reach"], x["m"]["end"])).otherwise(s["reach"]).alias("reach"), ok(s, x).alias("ok"), x["m"].alias("m")))
    return F.transform(F.filter(seen, lambda x: x["ok"]), lambda x: F.struct(x["m"]["rank"].alias("rank"), x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["text"].alias("text")))


def sensitive(items: DataFrame, kinds: tuple[str, ...] = KINDS, text: str = "text") -> DataFrame:
    """Matches without overlaps: the items' columns, kind, start, end, match."""
    each = F.array(*[_candidates(F.col(text), i) for i, r in enumerate(RULES) if r[0] in kinds])
    none = F.filter(F.element_at(each, 1), lambda m: F.lit(False))
    kept = F.aggregate(each, none, lambda kept, found: F.when(F.size(found) == 0, kept).otherwise(_free(kept, found)))
    names = F.array(*[F.lit(r[0]) for r in RULES])
    rows = items.where(F.col(text).rlike("[0-9@]")).withColumn("_m", F.explode(F.array_sort(kept)))
    return rows.withColumn("kind", F.element_at(names, F.col("_m.rank") + 1)).withColumn("start", F.col("_m.start")).withColumn("end", F.col("_m.end")).withColumn("match", F.col("_m.text")).drop("_m")


def mask(items: DataFrame, text: str = "text", mark: str = "█", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The items with each sensitive character replaced by a mark."""
    each = F.flatten(F.array(*[_candidates(F.col(text), i) for i, r in enumerate(RULES) if r[0] in kinds]))
    spans = F.array_sort(F.transform(each, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("from"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    cuts = tx.scan(spans, zero, lambda s, m: F.struct(s["end"].alias("from"), F.greatest(m["start"], s["end"]).alias("start"), F.greatest(m["end"], s["end"]).alias("end")))

    def put(cuts: Column) -> Column:
        parts = F.transform(cuts, lambda c: F.concat(F.substring(F.col(text), c["from"] + 1, c["start"] - c["from"]), F.repeat(F.lit(mark), c["end"] - c["start"])))
        rest = F.substring(F.col(text), F.coalesce(F.try_element_at(cuts, F.lit(-1))["end"], F.lit(0)) + 1, F.length(F.col(text)))
        return F.concat(F.array_join(parts, ""), rest)

    return items.withColumn(text, tx.let(cuts, put))
