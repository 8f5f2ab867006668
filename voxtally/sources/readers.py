"""Readers. Every one passes an explicit schema, so no file is read to infer it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxtally.functions.text import clean_company_url
from voxtally.schemas import PAGES_SCHEMA, RAW_REVIEW_SCHEMA

CORRUPT = "_corrupt_record"
# Fixed value: where the review site keeps the pages of one company.
REVIEW_PAGE_URL = "https://www.trustpilot.com/review/%s?page=%d"
MAX_PAGES = 4


def scan_category(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Raw rows of one category.

    JSON lines that do not parse are kept, with their text in ``_corrupt_record``.
    """
    reader = spark.read.format(fmt)
    if fmt == "json":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).load(path if isinstance(path, str) else list(path))


def scan_categories(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Several categories in one scan, each row tagged with the file it came from."""
    return scan_category(spark, paths, schema, fmt).withColumn(
        "source_path", F.col("_metadata.file_path")
    )


def union_categories(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union of category tables; a column one of them lacks is null there."""
    tagged = [df.withColumn("category", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_review_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved review pages, one row per company and page, the company as a clean host."""
    return clean_pages(spark.read.format(fmt).schema(PAGES_SCHEMA).load(path))


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("company", clean_company_url(F.col("company")))


def _cast(c: Column, kind: T.DataType) -> Column:
    text = c.cast("string")
    if isinstance(kind, T.LongType):
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return text.try_cast(kind)


def _user_file(
    spark: SparkSession, path: str, mapping: Mapping[str, str], fmt: str, multi_line: bool, columns: Sequence[str] | None
) -> DataFrame:
    """The file's columns as text, and lines that do not parse whole in ``_corrupt_record``."""
    reader = spark.read.format(fmt)
    if fmt not in ("csv", "json"):
        return reader.load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    if fmt == "csv":
        reader = reader.option("header", "true").option("escape", '"').option("multiLine", multi_line)
        # The names alone, from the first line: nothing is read to infer types.
        columns = columns or reader.load(path).columns
        # Names are compared in every file; a line of too few or too many fields is corrupt.
        reader = reader.option("enforceSchema", "false").option("columnPruning", "false")
    else:
        columns = columns or list(dict.fromkeys(mapping.values()))
        reader = reader.option("multiLine", multi_line)
    missing = sorted(set(mapping.values()) - set(columns))
    if missing:
        raise ValueError(f"the file has no column {', '.join(missing)}")
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(kinds).load(path)


def user_review_rows(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str],
    fmt: str = "csv",
    schema: T.StructType = RAW_REVIEW_SCHEMA,
    multi_line: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every line of a user's file: our columns, ``bad_reason``, ``bad_columns`` and ``raw``.

    ``mapping`` gives the file's name for each of our columns. A line that does not parse is
    a ``corrupt_record``; a value that is none of its column's type is a ``bad_value``, and
    ``bad_columns`` names the columns. ``raw`` holds the text of such a line. Files are cut
    into tasks of any size; with ``multi_line`` a value may hold line breaks, and then each
    file is one task. ``columns`` spares reading the header of a CSV file.
    """
    df = _user_file(spark, path, mapping, fmt, multi_line, columns)
    given = {f.name: F.col(f"`{mapping[f.name]}`") for f in schema if f.name in mapping}
    ours = {f.name: _cast(given[f.name], f.dataType) if f.name in given else F.lit(None).cast(f.dataType) for f in schema}
    failed = F.array_compact(
        F.array(*(F.when(given[n].isNotNull() & ours[n].isNull(), F.lit(n)) for n in given))
    ).cast("array<string>")
    reason = F.when(F.col(CORRUPT).isNotNull(), "corrupt_record").when(F.size(failed) > 0, "bad_value")
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != CORRUPT)))
    return df.select(
        *(c.alias(name) for name, c in ours.items()),
        reason.alias("bad_reason"),
        F.when(reason == "bad_value", failed).alias("bad_columns"),
        F.when(reason.isNotNull(), F.coalesce(F.col(CORRUPT), line)).alias("raw"),
    )


def split_user_reviews(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows in our columns, rejected lines): together all lines of ``user_review_rows``."""
    tags = ("bad_reason", "bad_columns", "raw")
    return rows.where(F.col("bad_reason").isNull()).drop(*tags), rows.where(F.col("bad_reason").isNotNull()).select(*tags)


def read_user_reviews(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str],
    fmt: str = "csv",
    schema: T.StructType = RAW_REVIEW_SCHEMA,
    multi_line: bool = False,
) -> DataFrame:
    """A user's own review file, null where a value is none of its column's type.

    Lines that do not parse are left out; ``user_review_rows`` has them with a reason.
    """
    rows = user_review_rows(spark, path, mapping, fmt, schema, multi_line)
    kept = F.coalesce(F.col("bad_reason") != "corrupt_record", F.lit(True))
    return rows.where(kept).select(*schema.names)


def company_page_urls(
    companies: DataFrame, max_pages: int = MAX_PAGES, url_format: str = REVIEW_PAGE_URL
) -> DataFrame:
    """The page addresses of every company, pages 1 to ``max_pages``."""
    return companies.select(
        "company", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page_no")
    ).withColumn("page_url", F.format_string(url_format, "company", "page_no"))


def load_audit(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, one row each."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)
