"""Trends, keywords, price feedback and competitor gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxtally.functions.text import MIN_LETTERS, terms
from voxtally.operators.skew import salted_join
from voxtally.session import materialize


def rating_trend(reviews: DataFrame) -> DataFrame:
    """Mean rating per product and month, and the change from its month before.

    The window runs over months already folded, a few hundred rows a product.
    """
    monthly = (
        reviews.groupBy("parent_asin", F.date_trunc("month", "timestamp").cast("date").alias("month"))
        .agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("review_count"))
    )
    w = Window.partitionBy("parent_asin").orderBy("month")
    before = F.lag("avg_rating").over(w)
    return monthly.withColumn("change", F.col("avg_rating") - before)


def review_keywords(
    reviews: DataFrame, k: int = 10, min_length: int = MIN_LETTERS
) -> DataFrame:
    """Terms that mark a subject: reviews with the term times log(subjects / subjects with it)."""
    tf = (
        reviews.select("subject", F.explode(terms(F.col("text"), min_length)).alias("term"))
        .groupBy("subject", "term")
        .agg(F.count("*").alias("tf"))
    )
    # Reading ``tf`` here keeps this branch equal to the other, so the texts are
    # exploded and shuffled once.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    total = reviews.agg(F.count_distinct("subject")).scalar()
    # A common term has a row for nearly every subject: ``df`` of them, which tells the terms to cut.
    counted = df.withColumn("rows", F.col("df"))
    scored = salted_join(tf, counted, ["term"], "inner", F.col("subject"), "rows").withColumn(
        "score", F.round(F.col("tf") * F.log(total / F.col("df")), 4)
    )
    w = Window.partitionBy("subject").orderBy(F.desc("score"), F.asc("term"))
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("subject", "rank", "term", "tf", "df", "score")
    )


def price_bands(metadata: DataFrame, bands: int = 4) -> DataFrame:
    """Equal-count price band of each product within its category; equal prices share one.

    Exact, without sorting a category in one task: prices are counted per whole
    unit and per cent first, and the position of a price is the sum of both
    running counts. Each window therefore sees distinct prices, not products.
    """
    priced = metadata.where(F.col("price").isNotNull()).withColumn(
        "cents", F.round(F.col("price") * 100).cast("bigint")
    ).withColumn("unit", F.floor(F.col("cents") / 100))
    fine = priced.groupBy("main_category", "unit", "cents").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("main_category", "unit").agg(F.sum("n").alias("unit_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_unit = Window.partitionBy("main_category").orderBy("unit")
    by_cent = Window.partitionBy("main_category", "unit").orderBy("cents")
    coarse = coarse.select(
        "main_category",
        "unit",
        F.coalesce(F.sum("unit_n").over(before(by_unit)), F.lit(0)).alias("below_unit"),
        F.sum("unit_n").over(Window.partitionBy("main_category")).alias("total"),
    )
    fine = fine.withColumn("below", F.coalesce(F.sum("n").over(before(by_cent)), F.lit(0)))
    position = F.col("below_unit") + F.col("below")
    band = F.floor(position * bands / F.col("total")).cast("int") + 1
    bounds = fine.join(coarse, ["main_category", "unit"]).select(
        "main_category", "cents", band.alias("band")
    )
    return priced.drop("unit").join(bounds, ["main_category", "cents"]).drop("cents")


def price_feedback(
    reviews: DataFrame,
    metadata: DataFrame,
    bands: int = 4,
    price_words: tuple[str, ...] = ("price", "cheap", "expensive", "cost", "value", "money"),
) -> DataFrame:
    """Per category and price band: products, reviews, mean rating, share naming the price.

    Reviews are folded per product before they meet the bands.
    """
    words = F.lower(F.col("text")).rlike(r"\b(" + "|".join(price_words) + r")\b")
    per_product = reviews.groupBy("parent_asin").agg(
        F.count("*").alias("n"), F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rated"), F.count_if(words).alias("named"),
    )
    return (
        price_bands(metadata, bands)
        .join(per_product, "parent_asin")
        .groupBy("main_category", "band")
        .agg(
            F.count("*").alias("product_count"),
            F.sum("n").alias("review_count"),
            (F.sum("rating_sum") / F.sum("rated")).alias("avg_rating"),
            (F.sum("named") / F.sum("n")).alias("price_share"),
        )
    )


def competitor_gap(reviews: DataFrame, metadata: DataFrame) -> DataFrame:
    """Own mean rating against the mean of all other products of the category.

    Category totals come from an aggregate joined back, since a window would hold
    a whole category in one task; the join cuts large categories for the same reason.
    """
    per_product = reviews.groupBy("parent_asin").agg(
        F.sum("rating").alias("own_sum"), F.count("rating").alias("own_n")
    )
    # One narrow row per product, which totals, weights and the join all read.
    rated = materialize(metadata.select("parent_asin", "main_category").join(per_product, "parent_asin"), "product-ratings")
    totals = rated.groupBy("main_category").agg(
        F.sum("own_sum").alias("all_sum"), F.sum("own_n").alias("all_n"), F.count("*").alias("products")
    )
    own = F.try_divide(F.col("own_sum"), F.col("own_n"))
    others = F.try_divide(F.col("all_sum") - F.col("own_sum"), F.col("all_n") - F.col("own_n"))
    return salted_join(rated, totals, ["main_category"], "inner", F.col("parent_asin"), "products").select(
        "parent_asin", "main_category", own.alias("own_rating"), others.alias("other_rating"),
        (own - others).alias("gap"),
    )
