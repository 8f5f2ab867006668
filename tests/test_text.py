"""URL, name, whitespace, search and JSON columns."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from voxtally.functions import text as tx
from voxtally.operators.catalog import title_contains

FEW = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
URLISH = st.text(alphabet="abcABC019./:-_?=# \twhtps'é", max_size=30)


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def plain_host(url):
    host = url.lower().strip()
    for prefix in ("http://", "https://", "www."):
        host = host.replace(prefix, "")
    return host.partition("/")[0].strip()


@pytest.mark.parametrize(
    "url, host",
    [
        ("HTTPS://www.A.com/x?y", "a.com"),
        (" http://a.com ", "a.com"),
        ("a.com?x=1", "a.com?x=1"),
        ("awww.b.com", "ab.com"),
        ("\th-m.com\n", "h-m.com"),
        ("", ""),
    ],
)
def test_clean_company_url(spark, url, host):
    assert apply(spark, [url], tx.clean_company_url) == [host]


@FEW
@given(st.lists(URLISH, min_size=1, max_size=40))
def test_clean_company_url_property(spark, urls):
    assert apply(spark, urls, tx.clean_company_url) == [plain_host(u) for u in urls]


@FEW
@given(st.lists(URLISH, min_size=1, max_size=40))
def test_company_name_property(spark, urls):
    want = [plain_host(u).split(".")[0].replace("-", " ").title() for u in urls]
    assert apply(spark, urls, tx.company_name) == want


def test_title_case(spark):
    got = apply(spark, ["3com", "o'neil", "h m", "çok iyi", "中a"], tx.title_case)
    assert got == ["3Com", "O'Neil", "H M", "Çok Iyi", "中A"]


@FEW
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　ab", max_size=12), min_size=1, max_size=40))
def test_strip_is_python_strip(spark, values):
    assert apply(spark, values, tx.strip_ws) == [v.strip() for v in values]


def found(spark, titles, query, **kw):
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    return sorted(r.title for r in title_contains(df, query, **kw).collect())


def test_search_is_literal_and_ignores_case(spark):
    titles = ["100% Wool", "100 Wool", "CAFÉ set", r"a\b"]
    assert found(spark, titles, "0% w") == ["100% Wool"]
    assert found(spark, titles, "café") == ["CAFÉ set"]
    assert found(spark, titles, r"a\b") == [r"a\b"]
    assert found(spark, titles, "w") == []


def test_search_with_wildcards(spark):
    titles = ["100% Wool", "100 Wool", r"a\b", "azb"]
    assert found(spark, titles, "0%w", wildcards=True) == ["100 Wool", "100% Wool"]
    assert found(spark, titles, "a_b", wildcards=True) == [r"a\b", "azb"]
    assert found(spark, titles, r"a\b", wildcards=True) == [r"a\b"]


def test_terms(spark):
    got = apply(spark, ["Café good, GOOD bad5word été élève", "", None], tx.terms)
    assert got == [["café", "good", "bad", "word", "été", "élève"], [], None]
    long = apply(spark, ["Café good, GOOD bad5word été élève"], lambda c: tx.terms(c, 4))
    assert long == [["café", "good", "word", "élève"]]


def test_json_string(spark):
    assert apply(spark, ['say "hi"', "é", None], tx.json_string)[2] is None
    got = apply(spark, ['say "hi"', "é"], tx.json_string)
    assert [json.loads(v) for v in got] == ['say "hi"', "é"]
