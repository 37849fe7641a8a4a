"""Reports and form data as XFDF."""

import pytest

from folianta.operators import reports


def xfdf(inner, beside=""):
    return f'<xfdf xmlns="{reports.XFDF}">{beside}<fields>{inner}</fields></xfdf>'


def test_nested_fields_have_dotted_names(spark):
    body = xfdf('<field name="a"><field name="b"><value>1</value><value/></field><field name="c"/></field><field name="d"><value>x &amp; y</value></field>', '<f href="x"/>')
    got = reports.xfdf_values(spark.createDataFrame([(1, body)], "doc_id long, body string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a.b", ["1", ""], None), (1, "a.c", [], None), (1, "d", ["x & y"], None)]


@pytest.mark.parametrize(
    "body",
    [
        None,
        "",
        "<a/>",
        "<!DOCTYPE x>" + xfdf(""),
        xfdf("", "<annots/>"),
        xfdf("<field/>"),
        xfdf('<field name="a"/><field name="a"/>'),
        xfdf('<field name="a"><value>1</value><field name="b"/></field>'),
        xfdf('<field name="a"><value><b/></value></field>'),
        xfdf('<field name="a">' * 40 + "</field>" * 40),
        xfdf('<field name="' + "a" * 1025 + '"/>'),
        f'<xfdf xmlns="{reports.XFDF}"/>',
    ],
)
def test_bad_forms_are_an_error(spark, body):
    got = reports.xfdf_values(spark.createDataFrame([(1, body)], "doc_id long, body string")).collect()
    assert len(got) == 1 and got[0].error and got[0].name is None


def test_small_enough(spark):
    rows = [(1, 1, 5000, 9000), (1, 2, 1900, 9000), (1, 3, 100, 9000), (2, 1, None, 9000), (2, 2, 3000, 9000), (2, 3, 3000, 9000), (3, 1, 4000, 1000), (3, 2, 10, 1000), (4, 1, None, 9000)]
    got = reports.small_enough(spark.createDataFrame(rows, "doc_id int, nth int, bytes long, source_bytes long"), 2000).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1900), (2, 2, 3000), (3, 1, 4000), (4, 1, None)]
    with pytest.raises(ValueError):
        reports.small_enough(got, 1000)


def test_contrast_range(spark):
    rows = [(1, 0, 1), (1, 10, 99), (1, 200, 99), (1, 255, 1), (2, 7, 5)]
    got = reports.contrast_range(spark.createDataFrame(rows, "doc_id int, bin int, n long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 10, 200, True), (2, 7, 7, False)]


def test_forms_are_read_where_they_are(spark):
    """No table between and no shuffle, also with texts that break rules beside others."""
    bodies = [xfdf('<field name="a"><value>1</value></field>'), "<a", xfdf(""), xfdf("", "<annots/><fields/>"), xfdf("<x><y/></x>"), xfdf('<field name="a"><field name="b"><x/></field></field><field name="c"/>')]
    found = reports.xfdf_values(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string").coalesce(1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "tables-" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(0, "a", ["1"], None), (1, None, None, "not XML"), (3, None, None, "more than form data"), (4, None, None, "not a field"), (5, None, None, "only plain values")]
