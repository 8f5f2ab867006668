"""The load: raw tables to stored ones, with every row accounted for in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from voxtally.operators.clean import (
    LOADED, METADATA_OUTCOMES, MIN_RATINGS, OTHER_YEAR, REVIEW_OUTCOMES, UNPOPULAR, load_metadata, load_reviews,
    metadata_outcome, review_outcome,
)
from voxtally.session import shared_folder
from voxtally.sources.readers import split_user_reviews, user_review_rows
from voxtally.sources.writers import (
    store_metadata, store_reviews, with_review_id, write_metadata, write_reviews,
)

#: Outcomes of rows that are in order and not wanted: counted, not kept.
LEFT_OUT = (OTHER_YEAR, UNPOPULAR)


def stage_rows(raw: DataFrame, outcome: Column, outcomes: Sequence[str], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Reads the raw rows once: (stored rows with their ``outcome``, rows per outcome).

    Rows lie in a folder per outcome below the shared folder; those left out are counted
    while they pass. The counts come with that one job, and the stored table is written
    from the staged rows, so that its sort does not read the raw files again.
    """
    counts = Observation(f"{name} rows")
    tagged = raw.withColumn("outcome", outcome)
    seen = tagged.observe(counts, *(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))
    folder = shared_folder(raw.sparkSession, f"{name}-load")
    seen.where(~F.col("outcome").isin(*LEFT_OUT)).write.partitionBy("outcome").parquet(folder)
    return raw.sparkSession.read.schema(tagged.schema).parquet(folder), dict(counts.get)


def write_rejects(rows: DataFrame, name: str, path: str) -> None:
    """Appends rejected rows: table_name, bad_reason, and the row as JSON text."""
    bad = rows.where(F.col("outcome") != LOADED)
    kept = [c for c in rows.columns if c != "outcome"]
    text = bad.select(F.lit(name).alias("table_name"), F.col("outcome").alias("bad_reason"), F.to_json(F.struct(*kept)).alias("raw"))
    text.write.mode("append").partitionBy("table_name").parquet(path)


def _report(spark: SparkSession, counts: Mapping[str, Mapping[str, int]]) -> DataFrame:
    rows = [(t, o, int(n)) for t, found in counts.items() for o, n in found.items() if n or o == LOADED]
    return spark.createDataFrame(rows, "table_name string, outcome string, row_count bigint")


def _load(
    raw_reviews: DataFrame, raw_metadata: DataFrame, write, rejects_path: str | None, year: int | None, min_ratings: int, unit: str
) -> DataFrame:
    reviews, review_counts = stage_rows(raw_reviews, review_outcome(raw_reviews, year, unit), REVIEW_OUTCOMES, "reviews")
    products, product_counts = stage_rows(
        raw_metadata, metadata_outcome(raw_metadata, min_ratings), METADATA_OUTCOMES, "metadata"
    )
    loaded = F.col("outcome") == LOADED
    write(
        with_review_id(load_reviews(reviews.where(loaded), year, unit)),
        load_metadata(products.where(loaded), min_ratings),
    )
    if rejects_path:
        write_rejects(reviews, "reviews", rejects_path)
        write_rejects(products, "metadata", rejects_path)
    return _report(raw_reviews.sparkSession, {"reviews": review_counts, "metadata": product_counts})


def load_tables(
    raw_reviews: DataFrame, raw_metadata: DataFrame, reviews_path: str, metadata_path: str,
    year: int | None = 2023, min_ratings: int = MIN_RATINGS, unit: str = "s", rejects_path: str | None = None,
) -> DataFrame:
    """Raw category tables to the two stored tables; what became of all rows comes back.

    The report has table_name, outcome and row_count; its counts add up to the rows read.
    Rows that cannot be loaded go to ``rejects_path`` with their reason.
    """

    def write(reviews: DataFrame, products: DataFrame) -> None:
        write_reviews(reviews, reviews_path)
        write_metadata(products, metadata_path)

    return _load(raw_reviews, raw_metadata, write, rejects_path, year, min_ratings, unit)


def load_catalogue(
    raw_reviews: DataFrame, raw_metadata: DataFrame, database: str,
    year: int | None = 2023, min_ratings: int = MIN_RATINGS, unit: str = "s", rejects_path: str | None = None,
) -> DataFrame:
    """The same into the tables of ``ensure_tables``; a load that runs again changes nothing."""

    def write(reviews: DataFrame, products: DataFrame) -> None:
        store_reviews(reviews, database)
        store_metadata(products, database)

    return _load(raw_reviews, raw_metadata, write, rejects_path, year, min_ratings, unit)


def load_user_reviews(
    spark: SparkSession, path: str, mapping: Mapping[str, str], reviews_path: str, rejects_path: str,
    fmt: str = "csv", unit: str = "s", multi_line: bool = False,
) -> DataFrame:
    """A user's own file to the stored reviews, all years; lines that cannot be loaded to ``rejects_path``.

    The report is that of ``load_tables``: loaded and rejected rows are the lines of the file.
    """
    rows = user_review_rows(spark, path, mapping, fmt, multi_line=multi_line)
    outcome = F.coalesce("bad_reason", review_outcome(rows.drop("bad_reason"), None, unit))
    staged, counts = stage_rows(rows, outcome, ("bad_value", *REVIEW_OUTCOMES), "user-reviews")
    good, _ = split_user_reviews(staged.where(F.col("outcome") == LOADED))
    write_reviews(with_review_id(load_reviews(good, None, unit)), reviews_path)
    write_rejects(staged, "user_reviews", rejects_path)
    return _report(spark, {"user_reviews": counts})
