"""Catalogue lookups and reviews per product."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtally.operators import catalog
from voxtally.operators import reviews as rv

DAY = datetime(2023, 1, 1)


@pytest.fixture
def meta(spark):
    return spark.createDataFrame(
        [
            ("P1", "Ring", 10, 1.5), ("P2", "Ring", 90, None), ("P3", "Ring", 90, 3.0),
            ("P4", "ringer", 40, 2.0), ("P2", "Ring box", 5, 2.0), ("P5", "Bolt", None, 2.0),
        ],
        "parent_asin string, title string, rating_number long, price double",
    ).withColumns(
        {"main_category": F.lit("Toys"), "average_rating": F.lit(4.0), "features": F.lit("[]")}
    )


@pytest.fixture
def reviews(spark):
    data = [
        (1, 5.0, "a", "P2", 3), (2, 1.0, "b", "P2", None), (3, 3.0, "c", "P2", 3),
        (4, 3.0, None, "P2", 9), (5, 3.0, "e", "P4", 1), (6, 3.0, "f", "P9", 1),
    ]
    return spark.createDataFrame(
        data, "id long, rating double, text string, parent_asin string, helpful_vote long"
    ).withColumn("timestamp", F.lit(DAY))


def test_suggestions(meta):
    got = [tuple(r) for r in catalog.suggest_titles(meta, "RING").collect()]
    assert got == [("Ring", 90), ("ringer", 40), ("Ring box", 5)]
    assert catalog.suggest_titles(meta, "r").count() == 0
    assert len(catalog.suggest_titles(meta, "ring", k=2).collect()) == 2


def test_title_stands_for_most_rated_then_smallest_key(meta, rows):
    assert catalog.title_to_parent(meta, "Ring").first()[0] == "P2"
    assert catalog.title_to_parent(meta, "none").count() == 0
    assert dict(rows(catalog.titles_to_parent(meta))) == {
        "Ring": "P2", "ringer": "P4", "Ring box": "P2", "Bolt": "P5",
    }


def test_card(meta):
    assert catalog.product_card(meta, "Ring").first().price == "$None"
    assert catalog.product_card(meta, "ringer").first().price == "$2.0"


def test_join_multiplies_unless_asked_not_to(reviews, meta):
    assert rv.reviews_with_metadata(reviews, meta).count() == 2 * 4 + 1
    assert rv.reviews_with_metadata(reviews, meta, dedup=True).count() == 5


def test_top_reviews_follow_the_join(reviews, meta):
    got = [r.text for r in rv.top_reviews(reviews, meta, "Ring", 5).collect()]
    assert got == [None, None, "a", "a", "c"]
    assert rv.top_reviews(reviews, meta, "no such title").count() == 0


def test_numbering_puts_unvoted_last_and_breaks_ties_by_id(reviews, rows):
    got = rv.number_reviews(reviews.where("parent_asin = 'P2'"), k=10)
    assert [(r.review_no, r.id) for r in got.orderBy("review_no").collect()] == [
        (1, 4), (2, 1), (3, 3), (4, 2),
    ]
    assert got.where("review_no <= 2").count() == rv.number_reviews(
        reviews.where("parent_asin = 'P2'"), k=2
    ).count()


def test_numbered_text_skips_missing_text(reviews, rows):
    got = dict(rows(rv.reviews_text_numbered(reviews)))
    assert got["P2"] == "Review 1: a\nReview 2: c\nReview 3: b"


def test_plain_text_and_bundle_follow_page_order(spark):
    df = spark.createDataFrame(
        [("c", 2, 0, "z"), ("c", 1, 10, "y"), ("c", 1, 9, "x"), ("c", 2, 1, None)],
        "company string, page_no int, pos long, text string",
    )
    assert rv.reviews_text_plain(df).first().reviews_text == "Review: x\nReview: y\nReview: z"
    bundle = rv.company_review_bundle(df).first()
    assert (bundle.reviews, bundle.reviews_count) == (["x", "y", "z", None], 4)


def test_hot_product_is_cut_before_the_shuffle(spark):
    """One product holds a third of 60,000 rows; each task passes on at most k of them."""
    df = spark.range(60000, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string"))
        .alias("parent_asin"),
        (F.col("id") % 977).alias("helpful_vote"), F.lit("t").alias("text"),
    )
    got = rv.top_reviews_per_product(df, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    best = sorted(((i % 977, -i) for i in range(0, 60000, 3)), reverse=True)[:50]
    assert [(r.helpful_vote, -r.id) for r in got.where("parent_asin = 'hot'").orderBy("review_no").collect()] == best


def test_best_reviews_of_a_product_listed_twice(spark, meta, reviews):
    """The limit comes before the join, and doubled rows still fill it in order."""
    got = [(r.rating, r.text) for r in rv.top_reviews(reviews, meta, "Ring", 3).collect()]
    assert got == [(3.0, None), (3.0, None), (5.0, "a")]
    assert len(rv.top_reviews(reviews, meta, "Ring", 50).collect()) == 8
    text = rv.top_reviews(reviews, meta, "Ring", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.rindex("GlobalLimit 3")


def test_bundle_counts_reviews_past_the_prompt(spark):
    data = [("a.com", p, 0, f"t{p}") for p in range(1, 8)] + [("b.com", 6, 0, "late")]
    df = spark.createDataFrame(data, "company string, page_no int, pos long, text string")
    got = {r.company: (r.reviews, r.reviews_count) for r in rv.company_review_bundle(df).collect()}
    assert got == {"a.com": (["t1", "t2", "t3", "t4"], 7), "b.com": ([], 1)}
    whole = {r.company: len(r.reviews) for r in rv.company_review_bundle(df, max_pages=None).collect()}
    assert whole == {"a.com": 7, "b.com": 1}
    assert rv.reviews_text_plain(df, max_pages=None).where("company = 'b.com'").first().reviews_text == "Review: late"
