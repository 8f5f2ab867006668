"""Product catalogue: search, lookup, product cards and the demo subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.text import contains_text
from voxtally.functions.times import in_year
from voxtally.operators.skew import salted_join

# The product a title stands for: most rated first, then smallest product key.
BEST_PRODUCT = (F.desc_nulls_last, "rating_number"), (F.asc, "parent_asin")


def _best_product_order() -> list[Column]:
    return [direction(name) for direction, name in BEST_PRODUCT]


def title_contains(
    df: DataFrame, query: str, wildcards: bool = False, column: str = "title"
) -> DataFrame:
    """Rows whose title contains the query; under two characters nothing matches."""
    if len(query) < 2:
        return df.where(F.lit(False))
    return df.where(contains_text(F.col(column), query, wildcards))


def distinct_titles(metadata: DataFrame) -> DataFrame:
    """Each title once, with the largest ``rating_number`` among its products."""
    return metadata.groupBy("title").agg(F.max("rating_number").alias("rating_number"))


def suggest_titles(
    metadata: DataFrame, query: str, k: int = 10, wildcards: bool = False
) -> DataFrame:
    """Search suggestions, most rated first."""
    found = distinct_titles(title_contains(metadata, query, wildcards))
    return found.orderBy(F.desc_nulls_last("rating_number"), F.asc("title")).limit(k)


def first_row(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in a stated order."""
    return df.orderBy(*order).limit(1)


def lookup_title(
    metadata: DataFrame, title: str, columns: tuple[str, ...] | None = ("title", "features")
) -> DataFrame:
    """The one product a title stands for; all columns with ``columns=None``."""
    row = first_row(metadata.where(F.col("title") == title), *_best_product_order())
    return row.select(*columns) if columns else row


def product_card(metadata: DataFrame, title: str) -> DataFrame:
    """Header card of one product."""
    return as_card(lookup_title(metadata, title, None))


def as_card(metadata: DataFrame) -> DataFrame:
    """Card fields for every product; a missing price prints as ``$None``."""
    price = F.coalesce(F.col("price").cast("string"), F.lit("None"))
    return metadata.select(
        "title", "main_category", "average_rating", "rating_number",
        F.concat(F.lit("$"), price).alias("price"),
    )


def titles_to_parent(metadata: DataFrame, *also: str) -> DataFrame:
    """The product key of every title at once, by the same rule as ``lookup_title``.

    ``also`` names further columns of that product. A pre-aggregating ``min_by``,
    so a title shared by very many rows is folded before the shuffle.
    """
    votes = F.coalesce(F.col("rating_number"), F.lit(-1))
    best = F.min_by(F.struct("parent_asin", *also), F.struct(-votes, F.col("parent_asin"), *also))
    return metadata.groupBy("title").agg(best.alias("best")).select("title", "best.*")


def title_to_parent(metadata: DataFrame, title: str) -> DataFrame:
    """One title to one product key; no row when the title is unknown."""
    return lookup_title(metadata, title, ("parent_asin",))


def demo_products(reviews: DataFrame, min_reviews: int = 100, year: int = 2023) -> DataFrame:
    """Products with strictly more than ``min_reviews`` reviews in the year."""
    return (
        reviews.where(in_year(F.col("timestamp"), year))
        .groupBy("parent_asin")
        .agg(F.count("*").alias("review_count"))
        .where(F.col("review_count") > min_reviews)
    )


def demo_subset(
    reviews: DataFrame, metadata: DataFrame, min_reviews: int = 100, year: int = 2023
) -> tuple[DataFrame, DataFrame]:
    """Reviews and metadata of the busy products, both by left-semi join.

    The busiest product may hold a third of all reviews; the counts tell which ones to cut.
    """
    busy = demo_products(reviews, min_reviews, year)
    in_scope = reviews.where(in_year(F.col("timestamp"), year))
    spread = F.struct(*(c for c in ("id", "text", "timestamp") if c in reviews.columns))
    return (
        salted_join(in_scope, busy, ["parent_asin"], "left_semi", spread, "review_count"),
        metadata.join(busy, "parent_asin", "left_semi"),
    )
