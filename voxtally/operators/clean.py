"""Cleaning and filtering of raw reviews and product metadata (no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxtally.functions.text import json_string, json_text
from voxtally.functions.times import epoch_in_year, epoch_to_ts, valid_epoch
from voxtally.sources.readers import CORRUPT

REVIEW_FIELDS = ("rating", "title", "text", "asin", "parent_asin", "timestamp", "helpful_vote")
METADATA_FIELDS = (
    "main_category", "title", "average_rating", "rating_number", "features",
    "description", "price", "parent_asin", "categories", "details",
)
NESTED_FIELDS = ("features", "description", "categories", "details")
MIN_RATINGS = 50


def project_reviews(df: DataFrame) -> DataFrame:
    return df.select(*REVIEW_FIELDS)


def project_metadata(df: DataFrame) -> DataFrame:
    return df.select(*METADATA_FIELDS)


def popular_metadata(df: DataFrame, min_ratings: int = MIN_RATINGS) -> DataFrame:
    """Products with strictly more than ``min_ratings`` ratings."""
    return df.where(F.col("rating_number") > min_ratings)


def nested_to_json(df: DataFrame, columns: tuple[str, ...] = NESTED_FIELDS) -> DataFrame:
    """Nested columns as JSON text; a column that is plain text becomes a JSON string."""
    return df.withColumns(
        {
            name: json_string(F.col(name))
            if isinstance(df.schema[name].dataType, T.StringType)
            else json_text(F.col(name))
            for name in columns
        }
    )


def json_to_nested(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The way back: ``types`` gives the nested type of each JSON column."""
    return df.withColumns({name: F.from_json(name, kind) for name, kind in types.items()})


def review_problem(df: DataFrame, epoch: str = "timestamp", unit: str = "s") -> Column:
    """Why a raw review cannot be loaded, or null."""
    ts = F.col(epoch)
    reason = F.when(ts.isNull(), "null_timestamp").when(
        ~valid_epoch(ts, unit), "timestamp_out_of_range"
    )
    return _unless_corrupt(df, reason)


def metadata_problem(df: DataFrame) -> Column:
    """Why a raw metadata row cannot be loaded, or null."""
    return _unless_corrupt(df, F.when(F.col("rating_number").isNull(), "null_rating_number"))


def _unless_corrupt(df: DataFrame, reason: Column) -> Column:
    if CORRUPT not in df.columns:
        return reason
    return F.when(F.col(CORRUPT).isNotNull(), "corrupt_record").otherwise(reason)


# What became of a row in a load.
LOADED, OTHER_YEAR, UNPOPULAR = "loaded", "other_year", "unpopular"
REVIEW_OUTCOMES = (LOADED, OTHER_YEAR, "null_timestamp", "timestamp_out_of_range", "corrupt_record")
METADATA_OUTCOMES = (LOADED, UNPOPULAR, "null_rating_number", "corrupt_record")


def review_outcome(df: DataFrame, year: int | None = 2023, unit: str = "s") -> Column:
    """What a load does with a raw review: ``loaded``, ``other_year`` or the reason it is rejected."""
    kept = F.lit(LOADED)
    if year is not None:
        kept = F.when(epoch_in_year(F.col("timestamp"), year, unit), LOADED).otherwise(OTHER_YEAR)
    return F.coalesce(review_problem(df, unit=unit), kept)


def metadata_outcome(df: DataFrame, min_ratings: int = MIN_RATINGS) -> Column:
    """What a load does with a raw metadata row: ``loaded``, ``unpopular`` or the reason it is rejected."""
    kept = F.when(F.col("rating_number") > min_ratings, LOADED).otherwise(UNPOPULAR)
    return F.coalesce(metadata_problem(df), kept)


def tag_bad_rows(df: DataFrame, problem: Column) -> DataFrame:
    return df.withColumn("bad_reason", problem)


def split_bad_rows(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``bad_reason``). Together they are all of ``df``."""
    tagged = tag_bad_rows(df, problem)
    good = tagged.where(F.col("bad_reason").isNull()).drop("bad_reason")
    return good, tagged.where(F.col("bad_reason").isNotNull())


def bad_row_counts(df: DataFrame, problem: Column) -> DataFrame:
    """Rows per reason, good ones under ``ok``, so that nothing is dropped unseen."""
    return (
        df.select(F.coalesce(problem, F.lit("ok")).alias("bad_reason"))
        .groupBy("bad_reason")
        .agg(F.count("*").alias("row_count"))
    )


def real_affinity(c: Column) -> Column:
    """Number in a text column as double; text that is no number gives null."""
    return c.cast("string").try_cast("double")


def integer_affinity(c: Column) -> Column:
    """Whole number in a text column; ``3.0`` reads as 3."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def coerce_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring the columns that ``schema`` names to its types without failing on bad text."""
    rules = {T.DoubleType: real_affinity, T.LongType: integer_affinity}
    casts = {
        f.name: rules[type(f.dataType)](F.col(f.name))
        for f in schema
        if f.name in df.columns and type(f.dataType) in rules
    }
    return reduce(lambda d, kv: d.withColumn(*kv), casts.items(), df)


def load_reviews(df: DataFrame, year: int | None = 2023, unit: str = "s") -> DataFrame:
    """Raw reviews to the stored shape: valid epochs of one year, typed timestamp.

    Both conditions are written on the raw epoch column, so they reach the scan.
    """
    epoch = F.col("timestamp")
    keep = valid_epoch(epoch, unit)
    if year is not None:
        keep = keep & epoch_in_year(epoch, year, unit)
    return project_reviews(df.where(keep).withColumn("timestamp", epoch_to_ts(epoch, unit)))


def load_metadata(df: DataFrame, min_ratings: int = MIN_RATINGS) -> DataFrame:
    """Raw metadata to the stored shape: popular products, nested fields as JSON text."""
    rows = nested_to_json(project_metadata(popular_metadata(df, min_ratings)))
    return rows.withColumn("price", real_affinity(F.col("price")))
