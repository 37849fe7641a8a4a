"""Column expressions over text: matches with places, snippets, counts, names and escapes. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as documents have it: Java's \s leaves out the no-break and other Unicode spaces.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Edges of words of ASCII letters, digits and underscore. Java's \b also counts letters beyond ASCII.
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Letters and their forms without marks.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def fold_marks(text: Column) -> Column:
    return F.translate(F.translate(text, MARKED, PLAIN), MARKED.upper().replace("Ÿ", ""), PLAIN.upper()[: len(MARKED) - 1])


def literal(term: str) -> str:
    """A pattern that matches a string as it is."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: A running fold first fills arrays of so many states, as an array that grows is copied with each element.
_SCAN = 64


def let(value: Column, use) -> Column:
    """What ``use`` makes of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, zero: Column, step) -> Column:
    """The state after each item of an array, ``zero`` being the one before the first."""

    def chunk(begin: Column, some: Column) -> Column:
        return F.aggregate(some, F.array(begin), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))

    def whole(x: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / _SCAN).cast("int")), lambda i: F.slice(x, i * _SCAN + 1, F.lit(_SCAN)))
        return F.aggregate(cuts, F.array(F.array(zero)), lambda done, some: F.concat(done, F.array(chunk(F.element_at(F.element_at(done, -1), -1), some))))

    return F.flatten(F.transform(let(items, whole), lambda states: F.slice(states, F.lit(2), F.lit(_SCAN))))


def match_starts(text: Column, pattern: str) -> Column:
    """Places (from 0) and texts of all matches, in one pass: the gaps between matches tell where each begins."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))
    zero = F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("text"))  # a type in which the text may be missing
    places = scan(pairs, zero, lambda last, x: F.struct((last["start"] + F.coalesce(F.length(last["text"]), F.lit(0)) + x["g"]).alias("start"), x["h"].alias("text")))
    return F.filter(places, lambda x: x["text"].isNotNull())


def snippet(text: Column, start: Column, size: Column) -> Column:
    """36 characters before a match and 52 after it, white space collapsed, with an ellipsis where text is left out."""
    a = F.greatest(F.lit(0), start - 36)
    b = F.least(F.length(text), start + size + 52)
    return F.concat(F.when(a > 0, "…").otherwise(""), collapse(F.substring(text, a + 1, b - a)), F.when(b < F.length(text), "…").otherwise(""))


def n_characters(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def number_like(text: Column) -> Column:
    """Digits with thousands commas, a fraction and accounting parentheses, both or none."""
    t = F.trim(text)
    body = r"-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?"
    return t.rlike(rf"^{body}$") | t.rlike(rf"^\({body}\)$")


def cell_kind(text: Column) -> Column:
    """`date` for a valid ISO date, `number`, or `text`."""
    t = F.trim(text)
    date = t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()
    return F.when(date, "date").when(number_like(text), "number").otherwise("text")


def cell_number(text: Column) -> Column:
    """A date's serial day from 1899-12-30, a number's value (parentheses make it negative), or null."""
    t = F.trim(text)
    value = F.regexp_replace(t, "[(),]", "").try_cast("double")
    return F.when(cell_kind(text) == "date", F.datediff(F.try_to_date(t, "yyyy-MM-dd"), F.lit("1899-12-30").cast("date")).cast("double")).when(cell_kind(text) == "number", F.when(t.startswith("("), -F.abs(value)).otherwise(value))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_field(text: Column) -> Column:
    """A field that no spreadsheet runs: formula-like text that is no number gets an apostrophe; quoted where it must be."""
    safe = F.when(text.rlike("^[=+\\-@\t\r]") & (cell_kind(text) != "number"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",\r\n]'), _quoted(safe)).otherwise(safe)


def csv_form_field(text: Column) -> Column:
    """The stricter rule for form values: guarded also after white space or at a control character, always quoted."""
    bare = F.regexp_replace(text, f"^{SPACE}+", "")
    risky = bare.rlike("^[=+\\-@]") | bare.rlike("^[\\x00-\\x1F]") | text.rlike("^[\t\r\n]")
    return _quoted(F.when(risky, F.concat(F.lit("'"), text)).otherwise(text))


def csv_search_field(text: Column) -> Column:
    """The rule for search results: also guarded where white space stands before a formula's mark."""
    return csv_field(F.when(text.rlike(f"^{SPACE}+[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text))


def escape_markdown(text: Column) -> Column:
    inline = F.regexp_replace(text, r"([\\`*_\[\]<>|~&!])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(inline, rf"^({SPACE}*)([#>+=-])", r"$1\\$2"), rf"^({SPACE}*\d+)([.)])", r"$1\\$2")


def escape_markup(text: Column) -> Column:
    """For HTML and XML; control characters that XML does not allow go."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a column from 0, up to ZZZ."""
    n = index.cast("int")
    one = lambda x: F.char(F.lit(65) + x)
    two = n - 26
    three = n - 702
    return (
        F.when(n < 26, one(n))
        .when(n < 702, F.concat(one(F.floor(two / 26).cast("int")), one(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(one(F.floor(three / 676).cast("int")), one(F.floor(F.pmod(three, F.lit(676)) / 26).cast("int")), one(F.pmod(three, F.lit(26)))))
    )


# Amounts and signs of Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    out, rest = F.lit(""), n.cast("int")
    for amount, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / amount).cast("int")))
        rest = F.pmod(rest, F.lit(amount))
    return out


def letters(n: Column) -> Column:
    """A to Z, then the letter twice, three times and so on."""
    k = n.cast("int") - 1
    return F.repeat(F.char(F.lit(65) + F.pmod(k, F.lit(26))), F.floor(k / 26).cast("int") + 1)


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    number = F.when(style == "decimal", n.cast("string")).when(style == "roman-upper", roman(n)).when(style == "roman-lower", F.lower(roman(n))).when(style == "letters-upper", letters(n)).when(style == "letters-lower", F.lower(letters(n))).otherwise("")
    return F.concat(prefix, number)


def padded(n: Column, width: Column | int) -> Column:
    """Zeros on the left up to a width; a longer number stays whole."""
    s = n.cast("string")
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(s) >= w, s).otherwise(F.lpad(s, w, F.lit("0")))


def safe_url(url: Column) -> Column:
    """The address if its scheme is http, https or mailto, with scheme and host in lower case and a path at least; a bare mail address as mailto; else null."""
    t = F.trim(url)
    part = lambda i: F.regexp_extract(t, r"^([A-Za-z]+://)([^\s/?#]+)(.*)$", i)
    web = F.concat(F.lower(part(1)), F.lower(part(2)), F.when(part(3).startswith("/"), part(3)).otherwise(F.concat(F.lit("/"), part(3))))
    return (
        F.when(F.lower(t).rlike("^(javascript|vbscript|data|file|about|blob):"), F.lit(None).cast("string"))
        .when(t.rlike(r"(?i)^https?://[^\s/?#]+"), web)
        .when(F.lower(t).rlike("^mailto:"), F.concat(F.lit("mailto:"), F.substring(t, 8, F.length(t))))
        .when(t.rlike(r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"), F.concat(F.lit("mailto:"), t))
    )


def attachment_name(name: Column) -> Column:
    """A file name without path, control and direction marks, dot runs, outer dots and reserved characters."""
    t = F.regexp_replace(name, "[\\x00-\\x1F\\x7F\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^.*[/\\]", ""), r"\.\.+", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"^\.+", ""), r"\.+$", "")
    t = F.regexp_replace(t, r'[/:*?"<>|\\]+', "_")
    return F.when(F.coalesce(t, F.lit("")) == "", "attachment.bin").otherwise(t)


def label_name(label: Column) -> Column:
    """A field's name from its label: no boxes, underscores, closing marks; at most 40 characters."""
    t = F.regexp_replace(F.regexp_replace(label, "[_☐□▢❑]+", " "), "[:*?. \t\n\r]+$", "")
    t = F.trim(F.regexp_replace(F.replace(t, F.lit("."), F.lit(" ")), SPACE + "+", " "))
    return F.trim(F.substring(t, 1, 40))


def pdf_date(value: Column) -> Column:
    """The instant of a PDF date (D:YYYYMMDDHHmmSS and a zone), or null if it is none."""
    t = F.regexp_replace(F.trim(value), "^D:", "")
    shape = t.rlike(r"^\d{4}(\d{2}){0,5}([Zz]|[+-]\d{2}'?(\d{2})?'?)?$")
    digits = F.regexp_extract(t, r"^(\d+)", 1)
    part = lambda i, other: F.coalesce(F.nullif(F.substring(digits, i, 2), F.lit("")), F.lit(other)).cast("int")
    at = F.try_make_timestamp(F.substring(digits, 1, 4).cast("int"), part(5, "1"), part(7, "1"), part(9, "0"), part(11, "0"), part(13, "0"))
    sign = F.when(t.rlike(r"^\d+-"), -1).otherwise(1)
    zone = lambda g: F.coalesce(F.nullif(F.regexp_extract(t, r"[+-](\d{2})'?(\d{2})?'?$", g), F.lit("")), F.lit("0")).cast("int")
    off = sign * (zone(1) * 60 + zone(2))
    good = shape & (part(9, "0") <= 23) & (part(11, "0") <= 59) & (part(13, "0") <= 59) & (zone(1) <= 23) & (zone(2) <= 59)
    return F.when(good, F.timestamp_add("MINUTE", -off, at))
