"""Writers for the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtally.operators.skew import cut_heavy
from voxtally.schemas import METADATA_SCHEMA, REVIEWS_SCHEMA
from voxtally.session import setting


def with_review_id(df: DataFrame) -> DataFrame:
    """Surrogate key from the row itself: a rerun gives the same ids.

    Rows equal in every column share an id. Dense numbers would need all rows in
    one partition, so they are not offered.
    """
    return df.withColumn("id", F.xxhash64(*(c for c in df.columns if c != "id")))


def _shape(df: DataFrame, schema) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def write_reviews(
    df: DataFrame, path: str, mode: str = "append", files_per_load: int | None = None
) -> None:
    """Append reviews, partitioned by year and laid out by product.

    Rows are range-partitioned on (year, product, id), so a file covers a narrow
    run of products and a product lookup skips most row groups. The id in the
    range key lets one very large product spread over many tasks.
    """
    rows = _shape(df, REVIEWS_SCHEMA).withColumn("year", F.year("timestamp"))
    keys = ("year", "parent_asin", "id")
    rows = rows.repartitionByRange(*([files_per_load] if files_per_load else []), *keys)
    rows.sortWithinPartitions(*keys).write.mode(mode).partitionBy("year").parquet(path)


def store_reviews(df: DataFrame, database: str) -> None:
    """Reviews into the table of ``ensure_tables``; years that ``df`` has replace those stored.

    So a load that runs again gives the same table. Rows are dealt by bucket, for one file a
    bucket and year; a product that holds more than a task's share is dealt to several
    tasks, which write files of their own to its bucket.
    """
    rows = _shape(df, REVIEWS_SCHEMA).withColumn("year", F.year("timestamp"))
    keys = ("year", "parent_asin", "id")
    buckets = _buckets(df, f"`{database}`.reviews")
    # The bucket Spark gives a row, so that a task has whole buckets.
    bucket = F.pmod(F.hash("parent_asin"), F.lit(buckets))
    dealt = cut_heavy(rows, ["parent_asin"], F.col("id")).repartition(buckets, bucket, "_part").drop("_part")
    with setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        dealt.sortWithinPartitions(*keys).write.insertInto(f"`{database}`.reviews", overwrite=True)


def store_metadata(df: DataFrame, database: str) -> None:
    """Product metadata into the table of ``ensure_tables``, in place of what it holds."""
    rows = _shape(df, METADATA_SCHEMA)
    dealt = rows.repartition(_buckets(df, f"`{database}`.metadata"), "parent_asin")
    dealt.write.insertInto(f"`{database}`.metadata", overwrite=True)


def _buckets(df: DataFrame, table: str) -> int:
    facts = {r.col_name: r.data_type for r in df.sparkSession.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return int(facts["Num Buckets"])


def write_metadata(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append product metadata; no shuffle, one file per task."""
    _shape(df, METADATA_SCHEMA).write.mode(mode).parquet(path)
