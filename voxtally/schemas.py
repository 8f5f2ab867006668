"""Table layouts: raw input, stored tables, saved pages and the task log."""

from pyspark.sql import SparkSession, types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
_WORDS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_REVIEW_SCHEMA = _struct(
    rating=_D, title=_S, text=_S, asin=_S, parent_asin=_S, timestamp=_L, helpful_vote=_L
)

RAW_METADATA_SCHEMA = _struct(
    main_category=_S, title=_S, average_rating=_D, rating_number=_L, features=_WORDS,
    description=_WORDS, price=_S, parent_asin=_S, categories=_WORDS,
    details=T.MapType(_S, _S),
)

REVIEWS_SCHEMA = _struct(
    id=_L, rating=_D, title=_S, text=_S, asin=_S, parent_asin=_S,
    timestamp=T.TimestampType(), helpful_vote=_L,
)

METADATA_SCHEMA = _struct(
    asin=_S, main_category=_S, title=_S, average_rating=_D, rating_number=_L,
    features=_S, description=_S, price=_D, parent_asin=_S, categories=_S, details=_S,
)

PAGES_SCHEMA = _struct(company=_S, page_no=_I, status_code=_I, html=_S)

TASK_LOG_SCHEMA = _struct(
    task_id=_S, subject=_S, status=_S, error=_S, ts=T.TimestampType(), error_code=_S
)

# The log of the analysis flows: what was asked for, and the answers by position.
ANALYSIS_LOG_SCHEMA = _struct(
    task_id=_S, kind=_S, subject=_S, status=_S, error=_S, ts=T.TimestampType(), error_code=_S, outputs=_WORDS
)


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


#: Buckets of the stored tables; both have the same number, so that they join without a shuffle.
BUCKETS = 32


def ensure_tables(
    spark: SparkSession, database: str = "default", location: str | None = None, buckets: int = BUCKETS
) -> None:
    """Create the two stored tables where they are absent, in a database at ``location``.

    Reviews are partitioned by year, the column every load and every trend query
    restricts. Both tables are bucketed by product, the key of their join and of the
    ranks per product: those read stored rows where they lie. Choose ``buckets`` by the
    size of a year, some hundred MB to a bucket.
    """
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")
    clustered = f"CLUSTERED BY (parent_asin) INTO {buckets} BUCKETS"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{database}`.reviews "
        f"({_columns(REVIEWS_SCHEMA)}, `year` int) USING parquet PARTITIONED BY (`year`) {clustered}"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{database}`.metadata "
        f"({_columns(METADATA_SCHEMA)}) USING parquet {clustered}"
    )
