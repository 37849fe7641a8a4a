"""Queries over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as tx
from ..operators import detect, insights, search
from .registry import ORACLES, PAGES, WORDS, pages, query, table, words

_FOLD = "lower(translate(text, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'))"
_SNIP = """CASE WHEN greatest(0, start - 36) > 0 THEN '…' ELSE '' END
  || regexp_replace(substring(text, greatest(0, start - 36) + 1, least(length(text), start + 4 + 52) - greatest(0, start - 36)), '\\s+', ' ', 'g')
  || CASE WHEN least(length(text), start + 4 + 52) < length(text) THEN '…' ELSE '' END"""
_MATCHES = f"""WITH {PAGES}, split_ AS (SELECT doc_id, page, text, string_split({_FOLD}, 'tion') AS g FROM pages_),
m AS (SELECT doc_id, page, text, g, unnest(range(1, len(g)))::INT AS nth FROM split_ WHERE len(g) > 1),
s AS (SELECT doc_id, page, text, nth, (list_sum(list_transform(g[1:nth], lambda x: length(x))) + (nth - 1) * 4)::INT AS start FROM m)
"""


@query(_MATCHES + f"SELECT doc_id, page, nth, start, substring(text, start + 1, 4) AS match, {_SNIP} AS snippet FROM s")
def search_matches(spark, sf_dir):
    return search.find_text(pages(spark, sf_dir), "Tion")


@query(_MATCHES + "SELECT doc_id, count(*) AS matches, count(DISTINCT page) AS pages FROM s GROUP BY doc_id ORDER BY matches DESC, doc_id LIMIT 20")
def search_top_docs(spark, sf_dir):
    hits = search.find_text(pages(spark, sf_dir), "Tion")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("page").alias("pages")).orderBy(F.desc("matches"), "doc_id").limit(20)


@query(f"WITH {PAGES} SELECT doc_id, page, len(list_filter(string_split_regex({_FOLD}, '[^a-z0-9_]+'), lambda w: w = 'of')) AS n FROM pages_ WHERE regexp_matches({_FOLD}, '(^|[^a-z0-9_])of($|[^a-z0-9_])')")
def search_whole_word(spark, sf_dir):
    hits = search.find_text(pages(spark, sf_dir), "of", whole_word=True)
    return hits.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAGES} SELECT doc_id, page, {_SNIP.replace('start', 'least(100, length(text))')} AS snippet FROM pages_")
def snippet(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page", tx.snippet(F.col("text"), F.least(F.lit(100), F.length("text")), F.lit(4)).alias("snippet"))


@query(f"WITH {WORDS} SELECT doc_id, page, count(*)::BIGINT AS words, sum(length(str))::BIGINT AS characters, 'text' AS text_status FROM (SELECT * FROM words_) GROUP BY ALL")
def insights_page(spark, sf_dir):
    return insights.page_insights(words(spark, sf_dir))


@query(f"""WITH {WORDS}, per AS (SELECT doc_id, page, count(*) AS words, sum(length(str)) AS characters FROM words_ GROUP BY ALL)
SELECT p.doc_id, count(*) AS pages, coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(characters), 0)::BIGINT AS characters,
       count(*) FILTER (coalesce(characters, 0) = 0) AS textless_pages, (min(p.page) FILTER (coalesce(characters, 0) = 0))::INT AS first_textless
FROM pages_ p LEFT JOIN per USING (doc_id, page) GROUP BY p.doc_id""")
def insights_doc(spark, sf_dir):
    return insights.document_insights(pages(spark, sf_dir), insights.page_insights(words(spark, sf_dir)))


_TERMS = "terms AS (SELECT DISTINCT lower(regexp_extract(text, '^[^ ]+')) AS term FROM benchmark WHERE text IS NOT NULL)"


@query(f"""WITH {PAGES}, {_TERMS} SELECT term, count(*) AS pages, sum(len(string_split(lower(text), term)) - 1)::BIGINT AS hits
FROM pages_ JOIN terms ON contains(lower(text), term) WHERE term <> '' GROUP BY term""")
def term_hits(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "^[^ ]+", 0).alias("term"))
    return search.find_terms(pages(spark, sf_dir), terms, "text").groupBy("term").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").cast("long").alias("hits"))


@query(f"""WITH {PAGES}, h AS (SELECT doc_id, page, regexp_extract_all(text, '[A-Z][a-z]+, [a-z]+') AS m FROM pages_)
SELECT doc_id, page, unnest(range(1, len(m) + 1))::INT AS nth, unnest(m) AS text FROM h""")
def regex_hits(spark, sf_dir):
    return search.find_pattern(pages(spark, sf_dir), "[A-Z][a-z]+, [a-z]+").select("doc_id", "page", "nth", "text")


def _found(kind):
    return lambda spark, sf_dir: detect.candidates(pages(spark, sf_dir), kind).select("doc_id", "page", "match")


def _hits(test, *patterns):
    every = " UNION ALL ".join(f"SELECT doc_id, page, {i} AS rule, unnest(regexp_extract_all(text, '{p}')) AS match FROM pages_" for i, p in enumerate(patterns))
    return f"WITH {PAGES}, h AS ({every}) SELECT doc_id, page, match FROM h WHERE {test}"


_DIGITS = "list_transform(string_split(regexp_replace(match, '[ -]', '', 'g'), ''), lambda c: c::INT)"
_LUHN = f"""(SELECT sum(CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END END) % 10 = 0 FROM (SELECT unnest(list_reverse({_DIGITS})) AS d, unnest(range(1, len({_DIGITS}) + 1)) AS i))"""
_IBAN = """list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(substring(upper(replace(match, ' ', '')), 5) || substring(upper(replace(match, ' ', '')), 1, 4), ''), lambda c: c <> ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT)),
  lambda r, d: (CASE WHEN d >= 10 THEN r * 100 + d ELSE r * 10 + d END) % 97) = 1"""
_AT = """list_filter(list_transform(range(2, len(string_split(text, '@')) + 1), lambda i: regexp_extract(string_split(text, '@')[i - 1], '[A-Za-z0-9_.%+-]+$') || '@' || regexp_replace(regexp_extract(string_split(text, '@')[i], '^[A-Za-z0-9_.-]*'), '[^A-Za-z0-9]+$', '')),
  lambda x: regexp_full_match(x, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))"""
_DAY = "|".join(f"[0-9]{{1,2}}{m}[0-9]{{1,2}}{m}(?:[0-9]{{4}}|[0-9]{{2}})" for m in ("/", "\\.", "-"))
_N = "length(regexp_replace(match, '[^0-9]', '', 'g'))"
for _kind, _sql in {
    "email": f"WITH {PAGES} SELECT doc_id, page, unnest({_AT}) AS match FROM pages_",
    "ssn": _hits("match[1:3] NOT IN ('000', '666') AND match[1:1] <> '9' AND match[5:6] <> '00' AND match[8:11] <> '0000'", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b"),
    "card": _hits(_LUHN, "\\b[0-9](?:[ -]?[0-9]){12,18}\\b"),
    "iban": _hits(f"CASE WHEN regexp_full_match(upper(replace(match, ' ', '')), '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN {_IBAN} ELSE false END", "(?i)\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b"),
    "date": _hits(f"rule < 2 OR (rule = 2 AND regexp_matches(lower(match), '^({detect.MONTHS})')) OR (rule = 3 AND regexp_matches(lower(match), '^[0-9]+ ({detect.MONTHS})'))", "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b", f"\\b(?:{_DAY})\\b", "(?i)\\b[a-z]{3,9}\\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\\b", "(?i)\\b[0-9]{1,2} [a-z]{3,9}\\.? [0-9]{4}\\b"),
    "phone": _hits(f"(match[1:1] <> '(' OR regexp_matches(match, '^\\([0-9]{{2,4}}\\)')) AND ((match[1:1] = '+' AND {_N} BETWEEN 8 AND 15) OR ({_N} BETWEEN 10 AND 11 AND regexp_matches(match, '[ ().-]')))", "(?:\\+|\\(|\\b)[0-9][0-9 ().-]{5,18}[0-9]\\b"),
}.items():
    _f = _found(_kind)
    _f.__name__ = f"pii_{_kind}"
    query(_sql)(_f)


_MADE = """pages_ AS (SELECT c_custkey AS doc_id, 1 AS page, 'no ' || (100 + c_custkey % 890) || '-' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || '-' || lpad((c_custkey * 7 % 9000)::VARCHAR, 4, '0') || ', DE' || lpad(((CASE WHEN c_custkey % 3 > 0 THEN 98 ELSE 97 END - (b % 97 * 1000000 + 131400) % 97))::VARCHAR, 2, '0')
  || CASE WHEN c_custkey % 2 = 0 THEN ' ' || (b::VARCHAR)[1:4] || ' ' || (b::VARCHAR)[5:8] || ' ' || (b::VARCHAR)[9:12] || ' ' || (b::VARCHAR)[13:16] || ' ' || (b::VARCHAR)[17:18] ELSE b::VARCHAR END || '; 4' || lpad((c_custkey * 31)::VARCHAR, 15, '0') AS text FROM (SELECT c_custkey, 370400440532013000 + c_custkey * 7919 AS b FROM customer))"""


def _made(spark, sf_dir):
    """A social security number, a bank account with right or wrong check digits and a card number for each customer."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k, (F.lit(370400440532013000) + k * 7919).alias("b"))
    digits = F.when(k % 3 > 0, 98).otherwise(97) - (F.col("b") % 97 * 1000000 + 131400) % 97
    s = F.col("b").cast("string")
    spaced = F.concat(F.lit(" "), F.concat_ws(" ", *(F.substring(s, i, 4) for i in (1, 5, 9, 13)), F.substring(s, 17, 2)))
    text = F.concat(F.lit("no "), (100 + k % 890).cast("string"), F.lit("-"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("-"), F.lpad((k * 7 % 9000).cast("string"), 4, "0"), F.lit(", DE"), F.lpad(digits.cast("string"), 2, "0"), F.when(k % 2 == 0, spaced).otherwise(s), F.lit("; 4"), F.lpad((k * 31).cast("string"), 15, "0"))
    return t.select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))


for _kind in ("ssn", "iban", "card"):

    def _f(spark, sf_dir, kind=_kind):
        return detect.candidates(_made(spark, sf_dir), kind).select("doc_id", "page", "match")

    _f.__name__ = f"pii_made_{_kind}"
    query(ORACLES[f"pii_{_kind}"].replace(PAGES, _MADE))(_f)


@query()
def pii_resolved(spark, sf_dir):
    return detect.sensitive(pages(spark, sf_dir)).select("doc_id", "page", "kind", "start", "end", "match")


@query()
def pii_candidates(spark, sf_dir):
    """Each kind's matches in whole texts, before overlaps are resolved. Java's look-arounds have no form in DuckDB."""
    p = pages(spark, sf_dir)
    return reduce(DataFrame.unionByName, (detect.candidates(p, k).select("doc_id", "page", F.lit(k).alias("kind"), "start", "match") for k in detect.KINDS))


@query()
def pii_masked(spark, sf_dir):
    return detect.mask(pages(spark, sf_dir)).select("doc_id", "page", "text")


@query(f"""WITH {PAGES}, m AS (SELECT doc_id, page, text, list_reverse(list_sort(list_transform(list_distinct({_AT}), lambda x: {{'n': length(x), 'x': x}}))) AS m FROM pages_)
SELECT doc_id, page, list_reduce(list_prepend(text, list_transform(m, lambda y: y.x)), lambda t, x: replace(t, x, repeat('█', length(x)))) AS text FROM m""")
def pii_mask(spark, sf_dir):
    return detect.mask(pages(spark, sf_dir), kinds=("email",)).select("doc_id", "page", "text")


@query(r"""WITH h AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?i)\b(?:https?://|www\.)[^\s<>"''`{}|\\^]+')) AS raw FROM pages),
t AS (SELECT doc_id, regexp_replace(raw, '[.,;:!?''"\]]+$', '') AS url FROM h),
u AS (SELECT doc_id, CASE WHEN lower(url) LIKE 'www.%' THEN 'https://' || url ELSE url END AS url FROM t)
SELECT doc_id, url, count(*) AS n FROM u WHERE contains(regexp_extract(url, '^https?://([^/?#]+)', 1), '.') GROUP BY ALL""")
def url_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.col("html").alias("text"))
    return search.find_urls(rows).groupBy("doc_id", "url").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT item_id AS pos, trim(regexp_extract(text, '^[^ ]+')) AS term FROM benchmark), o AS (SELECT lower(term) AS k, min(pos) AS pos, arg_min(term, pos) AS term FROM t WHERE term <> '' GROUP BY 1)
SELECT pos, term FROM o""")
def word_list(spark, sf_dir):
    return insights.word_list(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.regexp_extract("text", "^[^ ]+", 0).alias("line")), most=1_000_000)


@query()
def passages(spark, sf_dir):
    return search.top_passages(search.score_passages(search.passages(pages(spark, sf_dir)), "the tion of ing"))


@query(f"""WITH {PAGES}, f AS (SELECT doc_id, page, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM pages_),
c AS (SELECT doc_id, page, len(string_split(t, 'the')) - 1 AS a, len(string_split(t, 'tion')) - 1 AS b, len(string_split(t, 'ing')) - 1 AS c FROM f)
SELECT doc_id, page, ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) AS matched, (((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) * 10 + a + b + c)::INT AS score
FROM c WHERE ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) >= 2""")
def passage_score(spark, sf_dir):
    whole = pages(spark, sf_dir).withColumn("passage", F.regexp_replace("text", r"\s+", " "))
    return search.score_passages(whole, "the tion ing").select("doc_id", "page", "matched", "score")


_PAIRS = """WITH p AS (SELECT a.page_id AS id, a.url AS truth, b.url AS read FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)"""


def _pairs(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("truth"))
    b = table(spark, sf_dir, "pages").select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("read"))
    return a.join(b, "page_id").withColumnRenamed("page_id", "id")


@query(_PAIRS + " SELECT id, round(levenshtein(lower(truth), lower(read)) / greatest(length(truth), 1), 6) AS cer FROM p")
def cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(insights.character_error(F.col("truth"), F.col("read")), 6).alias("cer"))


@query(_PAIRS + r""", t AS (SELECT id, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(truth, '[/._-]', ' ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> '') AS a, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(read, '[/._-]', ' ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> '') AS b FROM p),
k AS (SELECT *, list_distinct(a || b) AS known FROM t), c AS (SELECT id, len(a) AS n, array_to_string(list_transform(a, lambda w: chr((33 + list_position(known, w))::INT)), '') AS x, array_to_string(list_transform(b, lambda w: chr((33 + list_position(known, w))::INT)), '') AS y FROM k)
SELECT id, round(levenshtein(x, y) / greatest(n, 1), 6) AS wer FROM c""")
def wer(spark, sf_dir):
    slashed = _pairs(spark, sf_dir).select("id", F.regexp_replace("truth", "[/._-]", " ").alias("truth"), F.regexp_replace("read", "[/._-]", " ").alias("read"))
    return slashed.select("id", F.round(insights.word_error(F.col("truth"), F.col("read")), 6).alias("wer"))


@query("""WITH h AS (SELECT l_linenumber AS doc_id, (l_quantity * 5)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT doc_id, bin, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY doc_id) AS n, sum(n * bin) OVER (PARTITION BY doc_id) AS s FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY bin)),
v AS (SELECT doc_id, bin, CASE WHEN n > n0 THEN round(n0::DOUBLE * (n - n0) * (s0::DOUBLE / n0 - (s - s0)::DOUBLE / (n - n0)) * (s0::DOUBLE / n0 - (s - s0)::DOUBLE / (n - n0)), 3) ELSE 0 END AS v FROM s)
SELECT doc_id, arg_max(bin, (v, -bin)) AS threshold FROM v GROUP BY doc_id""")
def otsu(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("doc_id"), (F.col("l_quantity") * 5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return insights.otsu(h)


_COMMON = ", ".join(f"'{w}'" for w in checks.COMMON)


@query(f"""WITH p AS (SELECT c_custkey, c_name || '!' || c_mktsegment AS t FROM customer), c AS (SELECT *, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])) AS codes FROM p),
b AS (SELECT c_custkey, t, 1.0 + list_sum(list_transform(range(2, len(codes) + 1), lambda i: CASE WHEN abs(codes[i] - codes[i - 1]) <= 1 THEN 0.25 ELSE 1.0 END)) AS n,
  (CASE WHEN regexp_matches(t, '[a-z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(t, '[0-9]') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '[^0-9a-zA-Z]') THEN 33 ELSE 0 END) AS pool,
  list_filter([{_COMMON}], lambda w: contains(lower(t), w)) AS words FROM c),
s AS (SELECT c_custkey, greatest(0, floor(n::DOUBLE * log2(pool::DOUBLE) - coalesce(length(words[1]) * 3, 0) + 0.5))::INT AS bits FROM b)
SELECT c_custkey, bits, CASE WHEN bits < 28 THEN 'Very weak' WHEN bits < 36 THEN 'Weak' WHEN bits < 60 THEN 'Fair' WHEN bits < 80 THEN 'Good' ELSE 'Strong' END AS label FROM s""")
def password_strength(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("!"), F.col("c_mktsegment")).alias("password"), "c_custkey")
    return t.withColumn("bits", checks.password_bits(F.col("password"))).select("c_custkey", "bits", checks.password_label(F.col("bits")).alias("label"))
