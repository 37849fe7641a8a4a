"""Names of files, sheets, fonts, fields and languages, and dates in form fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names of form-field dates.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def safe_file_name(path: Column, fallback: str = "document") -> Column:
    """The last part of a path without leading dots."""
    t = F.trim(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"^\.+", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", fallback).otherwise(t)


# Words of fonts' names, as Java patterns.
MONO = r"(?i)mono|courier|consol|menlo|inconsolata|typewriter|fixedsys|\bcode\b"
SERIF = r"(?i)times|georgia|garamond|cambria|palatino|antiqua|minion|baskerville|caslon|bodoni|century|didot|charter|constantia|tiempos|merriweather|lora|playfair|serif"
BOLD, ITALIC = r"(?i)bold|black|heavy|semibold|demi|[-,]bd\b", r"(?i)italic|oblique|slanted|[-,]it\b"


def standard_font(name: Column) -> Column:
    """The standard style nearest to a font's name: its subset tag goes, then monospace, sans and serif words decide in this order; bold and italic add to it."""
    t = F.trim(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    family = F.when(t.rlike(MONO), "Courier").when(t.rlike("(?i)sans"), "Helvetica").when(t.rlike(SERIF), "Times").otherwise("Helvetica")
    bold, italic = t.rlike(BOLD), t.rlike(ITALIC)
    return F.concat(family, F.when(bold & italic, "-BoldItalic").when(bold, "-Bold").when(italic, "-Italic").otherwise(""))


def language_tag(tag: Column) -> Column:
    """Whether a tag has the shape of a language tag."""
    return F.coalesce(tag, F.lit("")).rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")


def not_covered(text: Column, covered: Column) -> Column:
    """The distinct characters of a text that aren't among the covered ones."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: (c != "") & ~F.contains(covered, c)))), "")


def script_runs(text: Column) -> Column:
    """Runs of a text with ^{raised} and _{lowered} parts: array of (kind, text). A part without its closing brace stays as it is."""
    hits = F.regexp_extract_all(text, F.lit(r"[\^_]\{[^{}]*\}|(?:(?![\^_]\{[^{}]*\})[\s\S])+"), F.lit(0))
    kind = lambda r: F.when(r.rlike(r"^\^\{[^{}]*\}$"), "super").when(r.rlike(r"^_\{[^{}]*\}$"), "sub").otherwise("plain")
    return F.transform(hits, lambda r: F.struct(kind(r).alias("kind"), F.when(kind(r) == "plain", r).otherwise(F.regexp_replace(r, r"^[\^_]\{|\}$", "")).alias("text")))


def field_date(date: Column, pattern: str) -> Column:
    """A date by a form field's pattern: yyyy, yy, mmmm, mmm, mm, m, dd and d are replaced, everything else stays."""
    import re

    parts = []
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    forms = {"yyyy": pad(F.year(date), 4), "yy": pad(F.year(date) % 100, 2), "mmmm": month, "mmm": F.substring(month, 1, 3), "mm": pad(F.month(date), 2), "m": F.month(date).cast("string"), "dd": pad(F.day(date), 2), "d": F.day(date).cast("string")}
    for token in re.findall(r"yyyy|yy|mmmm|mmm|mm|m|dd|d|.", pattern, re.S):
        parts.append(forms[token] if token in forms else F.lit(token))
    return F.concat(*parts)


def parse_field_date(text: Column, pattern: str) -> Column:
    """The date that a pattern reads from a text, or null; two-digit years are of this century and the calendar is checked."""
    import re

    tokens = re.findall(r"yyyy|yy|mmmm|mmm|mm|m|dd|d|.", pattern, re.S)
    shapes = {"yyyy": r"(\d{4})", "yy": r"(\d{2})", "mmmm": r"([A-Za-z]+)", "mmm": r"([A-Za-z]{3})", "mm": r"(\d{2})", "m": r"(\d{1,2})", "dd": r"(\d{2})", "d": r"(\d{1,2})"}
    shape = "^" + "".join(shapes.get(t) or re.escape(t) for t in tokens) + "$"
    groups = [t for t in tokens if t in shapes]
    part = {t[0]: (t, F.regexp_extract(F.trim(text), shape, i + 1)) for i, t in enumerate(groups)}
    if set(part) != {"y", "m", "d"}:
        raise ValueError("a pattern has a year, a month and a day")
    (yt, y), (mt, m), (_, d) = part["y"], part["m"], part["d"]
    year = y.try_cast("int") + (2000 if yt == "yy" else 0)
    names = F.array(*[F.lit(n.lower() if mt == "mmmm" else n[:3].lower()) for n in MONTHS])
    month = F.nullif(F.array_position(names, F.lower(m)).cast("int"), F.lit(0)) if mt in ("mmm", "mmmm") else m.try_cast("int")
    iso = F.format_string("%04d-%02d-%02d", year, month, d.try_cast("int"))
    return F.when(F.trim(text).rlike(shape), F.try_to_date(iso, "yyyy-MM-dd"))


def unique_names(rows: DataFrame, group: str, order: str, name: str, longest: int | None = None) -> DataFrame:
    """Adds unique: each name of a group in order, with the first free number where it is taken, whatever the case. A fold, since each name depends on those given before it."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for n in part.sort_values(order)[name]:
            k, got = 1, n if longest is None else n[:longest]
            while got.lower() in taken:
                k += 1
                tail = f" {k}"
                got = (n if longest is None else n[: longest - len(tail)]) + tail
            taken.add(got.lower())
            out.append(got)
        return part.sort_values(order).assign(unique=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(group).applyInPandas(fold, kinds + ", unique string")


def sheet_names(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Unique sheet names of at most 31 characters without reserved signs."""
    clean = F.trim(F.regexp_replace(name, r"[\[\]:*?/\\]", " "))
    return unique_names(rows.withColumn(name, F.when(clean == "", "Sheet").otherwise(clean)), group, order, name, 31)
