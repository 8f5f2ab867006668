"""HTML extraction, page rule and review gate."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxtally.operators import pages as pg

CLASS = "styles_reviewContent__44s_M"


def box(text, cls=CLASS):
    return f'<div class="{cls}">{text}</div>'


@pytest.mark.parametrize(
    "html, want",
    [
        (box(" two <b>bold</b>\n words "), ["two bold\n words"]),
        (box("x", f"big {CLASS} red"), ["x"]),
        (box("x", f"{CLASS}2"), []),
        (box("a" + box("b") + "c"), ["abc", "b"]),
        (box("R&amp;D &lt;3 caf&eacute; &#65;"), ["R&D <3 café A"]),
        (box("a<script>var x = '</div>';</script><style>p{}</style><!-- no -->b"), ["ab"]),
        (box("a<template>hidden</template>b"), ["ab"]),
        (box(""), [""]),
        (f'<div class="{CLASS}">open <p>still', ["open still"]),
        (f'<section><div class="{CLASS}">in<p>p</section>out', ["inp"]),
        (box("a</span>b<br>c<img src='x'/>d"), ["abcd"]),
        (box("<div/>a") + box("b"), ["a", "b"]),
        (f"<DIV CLASS='{CLASS}'>x</DIV>", ["x"]),
        (box("a<![CDATA[ raw ]]>b"), ["a raw b"]),
        (box("a<ruby>b<rp>(</rp><rt>hidden</rt></ruby>"), ["ab"]),
        (box("a<![if x]>b") + box("c<!foo>d"), ["ab", "cd"]),
        ("<p>nothing</p>", []),
        ("", []),
    ],
)
def test_blocks(html, want):
    assert pg.page_blocks(html, "div", CLASS, None) == want


def test_attribute_or_null():
    html = '<a class="x" href="/1">1</a><a class="x">2</a><a href="/3">3</a>'
    assert pg.page_blocks(html, "a", "x", "href") == ["/1", None]
    assert pg.page_blocks(html, "a", None, "href") == ["/1", None, "/3"]


def test_text_of_a_script_is_its_own():
    html = f'<script class="{CLASS}">let x = 1;</script>'
    assert pg.page_blocks(html, "script", CLASS, None) == ["let x = 1;"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>![]-/?&;#'\"=adivscriptCDATA ", max_size=60))
def test_any_text_is_read_without_error(html):
    pg.page_blocks(box("x") + html, "div", CLASS, None)


PIECES = st.sampled_from(
    [f'<div class="{CLASS}">', "<div>", "</div>", "<p>", "</p>", "text &amp; ", "<br>", "<script>", "</script>", "<!-- ", " -->"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_never_more_blocks_than_opening_tags(pieces):
    html = "".join(pieces)
    assert len(pg.page_blocks(html, "div", CLASS, None)) <= html.count(f'<div class="{CLASS}">')


def test_extraction_job(spark, rows):
    pages = spark.createDataFrame(
        [
            (1, box("a") + box("b")), (2, "<p>none</p>"), (3, None),
            (4, '<div class="styles_reviewContent__44s_&#77;">coded</div>'),
        ],
        "page_id long, html string",
    )
    assert rows(pg.extract_blocks(pages), "page_id", "pos", "text") == [
        (1, 0, "a"), (1, 1, "b"), (4, 0, "coded"),
    ]
    links = pages.withColumn("html", F.lit("<a href='x'>1</a><a>2</a>"))
    assert links.count() * 2 == pg.extract_attr(links, "href", "a", None).count()


@pytest.fixture
def pages(spark):
    many = "".join(box(f"r{i}") for i in range(25))
    data = [
        ("full.com", 1, 200, many), ("full.com", 2, 200, many), ("full.com", 5, 200, many),
        ("short.com", 1, 200, many), ("short.com", 2, 200, many.replace(box("r0"), "", 1)),
        ("down.com", 1, 404, many), ("down.com", 2, 200, many),
        ("stop.com", 1, 200, many), ("stop.com", 2, 200, many), ("stop.com", 3, 500, many),
        ("stop.com", 4, 200, many),
        ("gap.com", 1, 200, box("only")), ("gap.com", 3, 200, many),
        ("empty.com", 1, 200, "<p>no</p>"), ("late.com", 2, 200, many),
    ]
    return spark.createDataFrame(data, "company string, page_no int, status_code int, html string")


def test_pages_before_the_first_failed_or_missing(pages, rows):
    got = dict(rows(pg.page_limits(pages), "company", "pages_read"))
    assert got == {
        "full.com": 2, "short.com": 2, "down.com": 0, "stop.com": 2, "gap.com": 1,
        "empty.com": 1, "late.com": 0,
    }
    kept = rows(pg.keep_page_prefix(pages), "company", "page_no")
    assert ("stop.com", 4) not in kept and ("full.com", 5) not in kept and len(kept) == 8


def test_gate_outcomes(pages, spark):
    reviews = pg.company_reviews(pages)
    asked = pages.select("company").union(spark.createDataFrame([("never.com",)], "company string"))
    gate = pg.min_review_gate(asked, reviews, pg.page_limits(pages))
    got = {r.company: (r.reviews_count, r.outcome) for r in gate.collect()}
    assert got == {
        "full.com": (50, "ok"), "short.com": (49, "insufficient"), "down.com": (0, "fetch_failed"),
        "stop.com": (50, "ok"), "gap.com": (1, "insufficient"), "empty.com": (0, "no_reviews"),
        "late.com": (0, "fetch_failed"), "never.com": (0, "fetch_failed"),
    }
    text = {r.company: r.message for r in gate.collect()}
    assert text["full.com"] is None
    assert text["short.com"].startswith("Found 49 reviews, but 50 are required.")
    assert text["down.com"].endswith("Status code: 404")
    passed = pg.passing_reviews(reviews, gate)
    assert {r.company for r in passed.collect()} == {"full.com", "stop.com"}


def test_copies_of_a_page_count_once(spark, rows):
    """A third of all rows are copies of one page; a page is good when any copy is."""
    page = box("a") + box("b")
    data = [("hot.com", 1, 200, page)] * 300 + [("hot.com", 2, 200, box("c"))] * 2
    data += [(f"c{i}.com", 1, 200, page) for i in range(600)]
    data += [("bad.com", 1, 200, page), ("bad.com", 2, 200, page), ("bad.com", 2, 503, page)]
    pages = spark.createDataFrame(
        data, "company string, page_no int, status_code int, html string"
    )
    got = pg.company_reviews(pages)
    assert rows(got.where("company = 'hot.com'"), "page_no", "pos", "text") == [
        (1, 0, "a"), (1, 1, "b"), (2, 0, "c"),
    ]
    assert got.where("company = 'bad.com'").count() == 4
    assert got.count() == 3 + 4 + 1200
    gate = pg.min_review_gate(pages, got, pg.page_limits(pages), 3)
    assert gate.where("outcome = 'ok'").count() == 2


def test_company_check(spark):
    urls = [("https://www.a.com/x",), ("apple",), ("",), (None,), ("http://",)]
    df = pg.validate_companies(spark.createDataFrame(urls, "company_url string"))
    got = [(r.company, r.reject_reason) for r in df.collect()]
    assert got == [
        ("a.com", None), ("apple", "Invalid company URL format"), ("", "No company URL provided"),
        (None, "No company URL provided"), ("", "Invalid company URL format"),
    ]


def test_all_pages_up_to_the_first_failed_are_read(spark):
    data = [("long.com", i, 200 if i != 9 else 404, box(f"r{i}")) for i in range(1, 12)]
    pages = spark.createDataFrame(data, "company string, page_no int, status_code int, html string")
    assert pg.company_reviews(pages).count() == 8
    assert pg.company_reviews(pages, max_pages=3).count() == 3
    assert pg.page_limits(pages).first().pages_read == 8


def test_reading_goes_on_after_a_bad_declaration():
    html = box("a") + "<![x[ y]]>" + box("b")
    assert pg.page_blocks(html, "div", CLASS, None) == ["a", "b"]
