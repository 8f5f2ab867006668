"""Reviews per product: joins, most helpful reviews, numbered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.operators.catalog import title_to_parent
from voxtally.operators.skew import salted_join

TOP_REVIEWS = 50
PROMPT_PAGES = 4
PRODUCT_COLUMNS = ("main_category", "average_rating", "rating_number", "price")


def review_order(df: DataFrame) -> list[Column]:
    """Most helpful first, nulls last; ties by newest, then id, then text."""
    order = [F.desc_nulls_last("helpful_vote")]
    if "timestamp" in df.columns:
        order.append(F.desc_nulls_last("timestamp"))
    return [*order, F.asc("id"), F.asc("text")]


def reviews_with_metadata(
    reviews: DataFrame, metadata: DataFrame, dedup: bool = False
) -> DataFrame:
    """Reviews with the columns of their product.

    A product listed twice doubles its reviews, as an inner join does. No side is
    hinted: Catalyst broadcasts metadata only when its measured size allows, and
    adaptive execution splits a hot product's partition otherwise. With
    ``dedup=True`` a review is kept once, without product columns; only keys are
    needed then, each once, and hot products are cut in parts.
    """
    if dedup:
        keys = metadata.select("parent_asin").distinct()
        return salted_join(reviews, keys, ["parent_asin"], "left_semi", F.col("id"))
    products = metadata.select(
        "parent_asin",
        F.col("title").alias("product_title"),
        *(c for c in PRODUCT_COLUMNS if c in metadata.columns),
    )
    return reviews.join(products, "parent_asin")


def top_reviews(
    reviews: DataFrame, metadata: DataFrame, title: str, k: int = TOP_REVIEWS
) -> DataFrame:
    """The most helpful reviews of the product a title stands for.

    The product key is a scalar subquery, so the reviews scan gets it as an
    ordinary equality filter. Each task hands on ``k`` reviews: only the best are joined,
    which a product listed more than once doubles.
    """
    key = title_to_parent(metadata, title).scalar()
    mine = reviews.where(F.col("parent_asin") == key).orderBy(*review_order(reviews)).limit(k)
    listed = metadata.select("parent_asin").where(F.col("parent_asin") == key)
    return (
        mine.join(listed, "parent_asin")
        .orderBy(*review_order(reviews))
        .limit(k)
        .select("rating", "text", "timestamp")
    )


def number_reviews(
    reviews: DataFrame, key: str = "parent_asin", k: int = TOP_REVIEWS, name: str = "review_no"
) -> DataFrame:
    """Position 1 to ``k`` of each review within its key, in helpful order.

    The bound on the position is part of the plan: each task drops everything
    past ``k`` rows of a key before the shuffle, so no key can fill a task.
    """
    w = Window.partitionBy(key).orderBy(*review_order(reviews))
    return reviews.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_reviews_per_product(
    reviews: DataFrame, k: int = TOP_REVIEWS, key: str = "parent_asin"
) -> DataFrame:
    """The ``k`` most helpful reviews of every product in one job."""
    return number_reviews(reviews, key, k)


def _join_lines(order: Column, line: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def reviews_text_numbered(
    reviews: DataFrame, key: str = "parent_asin", k: int = TOP_REVIEWS
) -> DataFrame:
    """``Review i: text`` lines per key, most helpful first. At most ``k`` lines a key.

    Reviews without text are left out before numbering.
    """
    ranked = number_reviews(reviews.where(F.col("text").isNotNull()), key, k)
    no = F.col("review_no")
    line = F.concat(F.lit("Review "), no.cast("string"), F.lit(": "), F.col("text"))
    return ranked.groupBy(key).agg(_join_lines(no, line).alias("reviews_text"))


def _in_prompt(max_pages: int | None) -> Column:
    return F.lit(True) if max_pages is None else F.col("page_no") <= max_pages


def reviews_text_plain(
    reviews: DataFrame, key: str = "company", max_pages: int | None = PROMPT_PAGES
) -> DataFrame:
    """``Review: text`` lines per company, in page order, from its first ``max_pages`` pages.

    The bound is that of a prompt, None for no bound; mining and the gate read all pages.
    """
    line = F.concat(F.lit("Review: "), F.col("text"))
    return (
        reviews.where(F.col("text").isNotNull() & _in_prompt(max_pages))
        .groupBy(key)
        .agg(_join_lines(F.struct("page_no", "pos"), line).alias("reviews_text"))
    )


def company_review_bundle(
    reviews: DataFrame, key: str = "company", max_pages: int | None = PROMPT_PAGES
) -> DataFrame:
    """List of reviews, bounded as above, and the count of all reviews, per company."""
    shown = F.when(_in_prompt(max_pages), F.struct("page_no", "pos", "text"))
    rows = F.array_sort(F.collect_list(shown))
    return reviews.groupBy(key).agg(
        F.transform(rows, lambda r: r["text"]).alias("reviews"),
        F.count("*").alias("reviews_count"),
    )
