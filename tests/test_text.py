import datetime as dt
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folianta.functions import checks
from folianta.functions import text as tx
from folianta.operators import detect, insights, search


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def page(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")


def test_find_text_counts_places_and_snippets(spark):
    p = page(spark, "River river rivers. End", "no match", "RÍVER")
    rows = search.find_text(p, "river").orderBy("page", "nth").collect()
    assert [(r.page, r.nth, r.start, r.match) for r in rows] == [(1, 1, 0, "River"), (1, 2, 6, "river"), (1, 3, 12, "river"), (3, 1, 0, "RÍVER")]
    assert search.find_text(p, "river", case_sensitive=True, whole_word=True).count() == 1
    assert search.find_text(p, "river", match_marks=True).count() == 3
    with pytest.raises(ValueError):
        search.find_text(p, "")


def test_snippet_marks_what_it_leaves_out(spark):
    t = "a" * 40 + " NEEDLE " + "b" * 60
    got = one(spark, tx.snippet(F.col("t"), F.lit(41), F.lit(6)), t=t)
    assert got == "…" + "a" * 35 + " NEEDLE " + "b" * 51 + "…"
    assert one(spark, tx.snippet(F.col("t"), F.lit(0), F.lit(1)), t="x  y") == "x y"


def test_words_and_characters(spark):
    assert one(spark, tx.n_words(F.col("t")), t=" two words ") == 2
    assert one(spark, tx.n_characters(F.col("t")), t=" a b 😀") == 3


@pytest.mark.parametrize("pattern", ["", "  ", "(?=a)b", r"(a)\1", "a*", "x?", "(?:)", "(", "x" * 1025, r"(?:\pL{1000}){1000}", "(" * 60 + "a" + ")" * 60])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        search.check_pattern(pattern)


def test_pattern_places(spark):
    rows = search.find_pattern(page(spark, "Ref AB-1234 and CD-5678."), r"[A-Z]{2}-\d{4}").collect()
    assert [(r.start, r.text) for r in rows] == [(4, "AB-1234"), (16, "CD-5678")]


@pytest.mark.parametrize(("pattern", "tail", "found"), [("(a|aa)+$", "!", 0), ("((a+))+$", "!", 0), ("(a+)+$", "", 1), ("(?:[a-z]|[0-9])+", "", 1)])
def test_no_pattern_takes_more_than_linear_time(spark, pattern, tail, found):
    began = time.time()
    assert search.find_pattern(page(spark, "a" * 60_000 + tail), pattern).count() == found
    assert time.time() - began < 5


def test_spans_equal_a_plain_matcher():
    rng = random.Random(7)
    for _ in range(400):
        part = lambda: rng.choice(["a", "b", "ab", "[ab]", ".", "é", "(?:a|b)", "(a)", "b?", "a+", "a*?b", "x{1,2}"])
        pattern = "".join(part() for _ in range(rng.randint(1, 4)))
        pattern = rng.choice([pattern, f"{pattern}|{part()}", f"^{pattern}", f"{pattern}$", f"(?:{pattern})+"])
        try:
            search.check_pattern(pattern)
        except ValueError:
            continue
        texts = ["".join(rng.choices("abxé \ufdd0😀", k=rng.randint(0, 12))) for _ in range(5)]
        want = [(i, n, m.start(), m.group()) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(pattern, t))]
        assert list(search.spans(pa.array([*texts, None]), pattern)) == want, pattern


def addresses(text):
    """What lies around each @, by hand."""
    out = []
    for at in [i for i, c in enumerate(text) if c == "@"]:
        local = re.search(r"[A-Za-z0-9_.%+-]*\Z", text[:at]).group()
        domain = re.sub(r"[^A-Za-z0-9]+\Z", "", re.match(r"[A-Za-z0-9_.-]*", text[at + 1 :]).group())
        if local and re.fullmatch(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", domain):
            out.append((at - len(local), local + "@" + domain))
    return out


def test_addresses(spark):
    rng = random.Random(3)
    texts = ["jane.doe+x@example.co.uk. user@localhost and @handle and a@b", "a@b.com.c@d.org x@a.com1 y@a_b.org z@.org w@a..org v@a.org-", "é@x.org <m@x.org>;n@x-y.org..."]
    texts += ["".join(rng.choices(["a", "b.", "@", "@", ".co", "_", "-", "1", " ", "é"], k=40)) for _ in range(60)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")
    got = sorted((r.doc_id, r.start, r.match) for r in detect.candidates(df, "email").collect())
    assert got == sorted((i, s, m) for i, t in enumerate(texts) for s, m in addresses(t)) and len(got) > 10


@pytest.mark.parametrize("text", ["x@" + "a." * 20_000, "x@" + "a." * 20_000 + "org", "a" * 60_000 + "@", "@a" * 5_000, "1 " * 30_000, "A1" * 30_000, "(" * 50_000, "1-" * 30_000])
def test_no_text_ends_an_executor(spark, text):
    began = time.time()
    one = page(spark, text)
    assert len(detect.mask(one).first().text) == len(text)
    detect.sensitive(one).collect()
    assert time.time() - began < 12


def test_many_matches_take_little_longer_than_one(spark):
    took = []
    for n in (1, 1, 12_000):
        began = time.time()
        assert page(spark, "1/1/11 " * n).select(F.size(tx.match_starts(F.col("text"), "1/1/11"))).first()[0] == n
        took.append(time.time() - began)
    assert took[2] < 4 * took[1]


def test_overlaps_are_resolved_in_order_of_kinds(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "@c.org", "4111 1111 1111 1111", "123-45-6789", "2024-01-02", "1/2/2024", "Jan 5, 2020", "+1 415 555 0100", "GB82WEST12345698765432", " ", "-", "1-", "é", "."]
    df = spark.createDataFrame([(i, 1, "".join(rng.choices(bits, k=80))) for i in range(30)], "doc_id int, page int, text string")
    each = [df.select("doc_id", F.explode(detect._candidates(F.col("text"), i)).alias("m")).collect() for i in range(len(detect.RULES))]
    kept = {i: [] for i in range(30)}
    for rule in each:
        for doc, m in sorted((r.doc_id, tuple(r.m)) for r in rule):
            if all(k[2] <= m[1] or m[2] <= k[1] for k in kept[doc]):
                kept[doc].append(m)
    got = sorted((r.doc_id, r.start, r.end, r.kind, r.match) for r in detect.sensitive(df).collect())
    assert got == sorted((i, m[1], m[2], detect.RULES[m[0]][0], m[3]) for i, ms in kept.items() for m in ms) and len(got) < sum(map(len, each))


def test_urls(spark):
    rows = search.find_urls(page(spark, "See https://a.org/x_(y). or (www.b.net/z), http://nodot")).orderBy("nth").collect()
    assert [r.url for r in rows] == ["https://a.org/x_(y)", "https://www.b.net/z"]


def test_passages_rank_by_terms(spark):
    p = page(spark, "Cats sleep all day long in the warm sun near the old kitchen window.", "Dogs bark. The cats and dogs play with cats in the garden all day long, it seems.", "Nothing here at all to be found by anyone who looks for things.")
    top = search.top_passages(search.score_passages(search.passages(p), "cats dogs")).collect()
    assert [(r.page, r.matched, r.score) for r in top][0] == (2, 2, 24)
    assert {r.page for r in top} == {1, 2}


def test_sensitive_kinds_and_overlaps(spark):
    text = "mail a.b@c.org, ssn 123-45-6789, card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32, on 2026-03-04 or March 4, 2026 or 3/4/2026, call +44 20 7946 0958 or (555) 010-1234"
    rows = detect.sensitive(page(spark, text)).orderBy("start").collect()
    assert [r.kind for r in rows] == ["email", "ssn", "card", "iban", "date", "date", "date", "phone", "phone"]
    assert all(r.match == text[r.start : r.end] for r in rows)
    for look_alike in ("000-12-3456", "4111 1111 1111 1112 3", "GB82 WEST 1234 5698 7654 33", "a@b", "12345"):
        assert {r.kind for r in detect.sensitive(page(spark, look_alike)).collect()} <= {"phone"}
    assert detect.mask(page(spark, "x a@b.org y")).first().text == "x ███████ y"


def test_queries_read_whole_texts(spark, tmp_path):
    import re

    from folianta.plans import catalog

    texts = ["Write to a.b@c.org, or\ncall +44 20 7946 0958. Born 2026-03-04.", "card 4111 1111 1111 1111 and\niban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789", "x" * 3000 + " z@y.net", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kinds = {0: {"email", "phone", "date"}, 1: {"card", "iban", "ssn"}, 2: {"email"}}
    found = catalog.QUERIES["pii_resolved"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kind) for r in found} == {(d, k) for d, ks in kinds.items() for k in ks}
    lines = {(d, n + 1): line for d, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))}
    assert all(r.match == lines[r.doc_id, r.page][r.start : r.end] for r in found)
    email = r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    rows = catalog.QUERIES["pii_candidates"](spark, str(tmp_path)).where("kind = 'email'").collect()
    assert sorted((r.doc_id, r.page, r.start, r.match) for r in rows) == sorted((d, n, m.start(), m.group()) for (d, n), line in lines.items() for m in re.finditer(email, line))
    want = {k: list(v) for k, v in lines.items()}
    for r in found:
        want[r.doc_id, r.page][r.start : r.end] = "█" * (r.end - r.start)
    masked = {(r.doc_id, r.page): r.text for r in catalog.QUERIES["pii_masked"](spark, str(tmp_path)).collect()}
    assert masked == {k: "".join(v) for k, v in want.items()}


def test_checks(spark):
    assert one(spark, checks.luhn(F.lit("4111 1111-1111 1111"))) and not one(spark, checks.luhn(F.lit("4111111111111112")))
    assert one(spark, checks.iban(F.lit("GB82 WEST 1234 5698 7654 32"))) and not one(spark, checks.iban(F.lit("GB82WEST12345698765433")))
    assert not one(spark, checks.ssn(F.lit("666-12-3456")))
    assert one(spark, checks.password_label(checks.password_bits(F.lit("password")))) == "Very weak"
    assert one(spark, checks.password_label(checks.password_bits(F.lit("Xk7#mQ9$vLp2!wRt")))) == "Strong"


def test_labels_and_numbers(spark):
    assert one(spark, tx.roman(F.lit(1994))) == "MCMXCIV"
    assert [one(spark, tx.letters(F.lit(n))) for n in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]
    assert [one(spark, tx.column_letters(F.lit(n))) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, tx.padded(F.lit(1234567), 6)) == "1234567" and one(spark, tx.padded(F.lit(7), 3)) == "007"


def test_cells_and_csv_guards(spark):
    assert one(spark, tx.cell_kind(F.lit("2024-02-30"))) == "text" and one(spark, tx.cell_number(F.lit("2024-01-01"))) == 45292
    assert one(spark, tx.cell_number(F.lit("(1,234.5)"))) == -1234.5
    assert one(spark, tx.csv_field(F.lit("=1+1"))) == "'=1+1" and one(spark, tx.csv_field(F.lit("-5"))) == "-5"
    assert one(spark, tx.csv_field(F.lit('a"b'))) == '"a""b"'
    assert one(spark, tx.csv_form_field(F.lit("  =x"))) == "\"'  =x\"" and one(spark, tx.csv_search_field(F.lit("  =x"))) == "'  =x"


def test_escapes_and_names(spark):
    assert one(spark, tx.escape_markdown(F.lit("# a*b"))) == r"\# a\*b" and one(spark, tx.escape_markdown(F.lit("1. x"))) == r"1\. x"
    assert one(spark, tx.attachment_name(F.lit("../a:b‮.pdf."))) == "a_b.pdf" and one(spark, tx.attachment_name(F.lit(""))) == "attachment.bin"
    assert one(spark, tx.label_name(F.lit("Full  name____: "))) == "Full name"
    assert one(spark, tx.safe_url(F.lit("JavaScript:x"))) is None and one(spark, tx.safe_url(F.lit("a@b.org"))) == "mailto:a@b.org"


@pytest.mark.parametrize(("value", "want"), [("D:20240229120000Z", dt.datetime(2024, 2, 29, 12)), ("D:20240101000000+02'00'", dt.datetime(2023, 12, 31, 22)), ("2024", dt.datetime(2024, 1, 1)), ("D:20230229", None), ("soon", None)])
def test_pdf_dates(spark, value, want):
    assert one(spark, tx.pdf_date(F.lit(value))) == want


def test_error_rates_and_word_list(spark):
    assert one(spark, insights.character_error(F.lit("abcd"), F.lit("abxd"))) == 0.25
    assert one(spark, insights.word_error(F.lit("the cat sat down"), F.lit("the dog sat"))) == 0.5
    lines = spark.createDataFrame([(0, "﻿Alpha"), (1, " beta\r"), (2, "ALPHA"), (3, "")], "pos int, line string")
    assert [r.term for r in insights.word_list(lines).orderBy("pos").collect()] == ["Alpha", "beta"]
    for bad, text in ((["x" * 201], "200 characters"), ([str(i) for i in range(501)], "500 terms"), (["", " "], "empty")):
        with pytest.raises(ValueError, match=text):
            insights.word_list(spark.createDataFrame(list(enumerate(bad)), "pos int, line string"))


def test_otsu_splits_two_humps(spark):
    h = spark.createDataFrame([(1, b, n) for b, n in ((10, 50), (12, 50), (200, 40), (210, 40))], "doc_id long, bin int, n long")
    assert insights.otsu(h).first().threshold == 12
