"""Continuous loading of raw reviews and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def scan_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of ``path`` as a stream, a bounded number of them per batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def ingest_stream(
    raw: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Loads whatever has arrived and stops.

    The same ``load`` function serves batch and stream. The Parquet sink commits
    each batch once, so a restart adds no row twice.
    """
    writer = load(raw).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(availableNow=True).start(out)


def quarantine_stream(
    raw: DataFrame, problem: Column, good_out: str, bad_out: str, checkpoint: str
) -> StreamingQuery:
    """Good and bad rows to two places from one read of the stream.

    Each batch overwrites its own folder, so a batch that runs again replaces
    what its first run wrote.
    """
    tagged = raw.withColumn("bad_reason", problem)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        is_bad = F.col("bad_reason").isNotNull()
        parts = ((good_out, batch.where(~is_bad).drop("bad_reason")), (bad_out, batch.where(is_bad)))
        for path, rows in parts:
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return (
        tagged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
