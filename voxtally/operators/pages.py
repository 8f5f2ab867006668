"""Saved review pages to company reviews."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.functions.status import (
    FETCH_FAILED, INSUFFICIENT, NO_REVIEWS, OK, outcome_message, url_reject_reason,
)
from voxtally.functions.text import clean_company_url
from voxtally.session import materialize

# Ship this module's functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_REVIEWS = 50
# Fixed value: class of the element that holds one review.
REVIEW_CLASS = "styles_reviewContent__44s_M"

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose text is their own and no part of the text around them.
_OWN_TEXT = frozenset("script style template rt rp".split())


class _Blocks(HTMLParser):
    """Collects text and attributes of the wanted elements of one page.

    An end tag closes the nearest open element of its name and all inside it; an
    end tag without one is ignored. What stays open ends with the page.
    """

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag, css_class
        self.found: list[tuple[list[str], dict]] = []
        self.stack: list[tuple[str, list[str] | None]] = []
        self.open_parts: list[list[str]] = []
        self.owners: list[str | None] = [None]
        self.read_from = tag if tag in _OWN_TEXT else None

    def _wanted(self, tag: str, attrs: dict) -> bool:
        if tag != self.tag:
            return False
        if self.css_class is None:
            return True
        value = attrs.get("class") or ""
        return self.css_class in value.split() or self.css_class == value

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        parts = None
        if self._wanted(tag, known):
            parts = []
            self.found.append((parts, known))
        if tag in _VOID:
            return
        self.stack.append((tag, parts))
        if parts is not None:
            self.open_parts.append(parts)
        if tag in _OWN_TEXT:
            self.owners.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.stack):
            return
        while True:
            name, parts = self.stack.pop()
            if parts is not None:
                self.open_parts.pop()
            if name in _OWN_TEXT:
                self.owners.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self.owners[-1] == self.read_from:
            for parts in self.open_parts:
                parts.append(data)

    def unknown_decl(self, data):
        if data[:6].upper() == "CDATA[":
            self.handle_data(data[6:])


def page_blocks(html: str, tag: str, css_class: str | None, attr: str | None) -> list[str | None]:
    """Stripped text, or one attribute, of every wanted element in document order."""
    parser = _Blocks(tag, css_class)
    # Declarations the parser gives up on are taken out; the rest of the page is read.
    parser.feed(re.sub(r"<!\[(?!CDATA\[)[^>]*>?", "", html, flags=re.I))
    parser.close()
    if attr:
        return [attrs.get(attr) for _, attrs in parser.found]
    return ["".join(parts).strip() for parts, _ in parser.found]


def _may_hold(html: Column, css_class: str | None) -> Column:
    """False only for pages that cannot hold the class, which then skip the Python step."""
    if css_class is None:
        return html.isNotNull()
    encoded = html.rlike(r"""(?i)class\s*=\s*("[^"]*&|'[^']*&|[^\s"'>]*&)""")
    return html.contains(css_class) | encoded


def _extract(
    pages: DataFrame, tag: str, css_class: str | None, attr: str | None, keys: tuple[str, ...],
    out: str,
) -> DataFrame:
    narrow = pages.where(_may_hold(F.col("html"), css_class)).select(*keys, "html")
    fields = [narrow.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_blocks(h, tag, css_class, attr) for h in batch["html"]]
            rows = batch[list(keys)].assign(**{out: found})
            rows["pos"] = [list(range(len(f))) for f in found]
            rows = rows[[len(f) > 0 for f in found]].explode([out, "pos"])
            yield rows.assign(pos=rows["pos"].astype("int64"))

    return narrow.mapInPandas(run, f"{schema}, `{out}` string, `pos` bigint")


def extract_blocks(
    pages: DataFrame,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """One row per element: ``keys``, ``text`` and ``pos`` (0-based, document order).

    Nested matches give a row each; script, style, template and comment text is
    left out. Filter pages before this step: predicates do not pass through it.
    """
    return _extract(pages, tag.lower(), css_class, None, keys, "text")


def extract_attr(
    pages: DataFrame,
    attr: str,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """As ``extract_blocks``, with an attribute instead of text; null where it is missing."""
    return _extract(pages, tag.lower(), css_class, attr.lower(), keys, "value")


def _numbered(pages: DataFrame, max_pages: int | None) -> DataFrame:
    no = F.col("page_no")
    return pages.where(no >= 1 if max_pages is None else no.between(1, max_pages))


def page_limits(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Number of pages read per company before the first failed or missing one.

    A page saved more than once is good when any copy is. All pages count, or the first
    ``max_pages``. Copies fold in each task before the shuffle, and only page numbers travel.
    Also keeps the status code of page 1, which the outcome message shows.
    """
    no, status = F.col("page_no"), F.col("status_code")
    good = F.coalesce(F.max(status == 200), F.lit(False))
    once = _numbered(pages, max_pages).groupBy("company", no.cast("bigint").alias("page_no")).agg(
        good.alias("good"), F.max(F.when(status != 200, status)).alias("failed")
    )
    # The nth good page bears the number n just as long as none before it failed or is missing.
    place = F.row_number().over(Window.partitionBy("company").orderBy(~F.col("good"), "page_no"))
    code = F.when(F.col("good"), F.lit(200)).otherwise(F.col("failed"))
    return (
        once.withColumn("place", place)
        .groupBy("company")
        .agg(
            F.max(F.when(F.col("page_no") == 1, code)).alias("first_status"),
            F.count_if(F.col("good") & (F.col("place") == F.col("page_no"))).cast("int").alias("pages_read"),
        )
    )


def keep_page_prefix(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Good pages that come before the first failed or missing page of their company."""
    limits = page_limits(pages, max_pages).select("company", "pages_read")
    return (
        _numbered(pages, max_pages).where(F.col("status_code") == 200)
        .join(limits, "company")
        .where(F.col("page_no") <= F.col("pages_read"))
        .drop("pages_read")
    )


def min_review_gate(
    companies: DataFrame,
    reviews: DataFrame,
    limits: DataFrame | None = None,
    n: int = MIN_REVIEWS,
) -> DataFrame:
    """Outcome per company of the list: fetch_failed, no_reviews, insufficient or ok.

    ``limits`` (from ``page_limits``) tells whether page 1 was read; without it
    every company counts as fetched. Companies without a review appear too.
    """
    counts = reviews.groupBy("company").agg(F.count("*").alias("reviews_count"))
    base = companies.select("company").distinct().join(counts, "company", "left")
    if limits is None:
        base = base.withColumns({"pages_read": F.lit(1), "first_status": F.lit(200)})
    else:
        base = base.join(limits, "company", "left")
    found = F.coalesce(F.col("reviews_count"), F.lit(0)).cast("bigint")
    outcome = (
        F.when(F.coalesce(F.col("pages_read"), F.lit(0)) < 1, FETCH_FAILED)
        .when(found == 0, NO_REVIEWS)
        .when(found < n, INSUFFICIENT)
        .otherwise(OK)
    )
    return base.select(
        "company",
        found.alias("reviews_count"),
        outcome.alias("outcome"),
        outcome_message(
            outcome, found, F.lit(n).cast("bigint"), F.col("first_status")
        ).alias("message"),
    )


def validate_companies(df: DataFrame, url: str = "company_url") -> DataFrame:
    """The cleaned company of each request and, where it is refused, the reason."""
    cleaned = clean_company_url(F.col(url))
    return df.withColumn("company", cleaned).withColumn(
        "reject_reason", url_reject_reason(F.col(url), F.col("company"))
    )


def company_reviews(
    pages: DataFrame,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    max_pages: int | None = None,
) -> DataFrame:
    """Reviews of every company: ``company, page_no, pos, text``.

    The page rule comes first, on page numbers and hashes alone; parsing costs many times what
    moving a page does, so only pages that count are parsed. Of different texts saved for
    one page the one with the smallest hash counts; equal copies fold to one.
    """
    marked = _numbered(pages, max_pages).where(F.col("status_code") == 200).withColumn("copy", F.xxhash64("html"))
    chosen = keep_page_prefix(pages.withColumn("copy", F.xxhash64("html")).drop("html"), max_pages)
    # Written, so that Catalyst knows its size: pages are joined where they lie while it is small.
    chosen = materialize(chosen.groupBy("company", "page_no").agg(F.min("copy").alias("copy")), "chosen-pages")
    kept = marked.where(_may_hold(F.col("html"), css_class)).join(chosen, ["company", "page_no", "copy"], "left_semi")
    found = extract_blocks(kept, tag, css_class, keys=("company", "page_no", "copy"))
    return found.groupBy("company", "page_no", "pos").agg(F.first("text").alias("text"))


def passing_reviews(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Reviews of the companies whose outcome is ``ok``."""
    passed = outcomes.where(F.col("outcome") == OK).select("company")
    return reviews.join(passed, "company", "left_semi")
