"""Keyed task state as streams, kept as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtally.functions.times import epoch_micros
from voxtally.operators.tasks import TTL_S, expire_tasks, latest_completed, latest_per_key
from voxtally.session import setting
from voxtally.streaming.expiry import ROCKSDB, expiring_changes
from voxtally.streaming.snapshots import merge_batch, read_snapshot, run_merged

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def task_state_stream(log: DataFrame, watermark: str | None = None, span: str = "1 day") -> DataFrame:
    """Newest row per task over a streaming log, for update mode.

    Without ``watermark`` the store holds one row per task for good, and rows may come in
    any order. With it the newest row of each task and ``span`` of time is kept, and a span
    leaves the store when the watermark has passed it; rows that come in later than
    ``watermark`` behind the newest are dropped. Rows of several spans of one task are
    folded where they are merged. Rows without a time pass by the store.
    """
    if not watermark:
        return latest_per_key(log)
    kind = log.schema["ts"].dataType
    timed = log.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    spans = latest_per_key(timed.withColumn("span", F.window("ts", span)), "task_id", "span")
    newest = spans.select(*[F.col(c).cast(kind).alias(c) if c == "ts" else F.col(c) for c in log.columns])
    return newest.unionByName(log.where(F.col("ts").isNull()))


def run_task_state(
    log: DataFrame, out: str, checkpoint: str, watermark: str | None = None, span: str = "1 day"
) -> StreamingQuery:
    """Keeps the state of all tasks as snapshots under ``out``; read it with ``read_task_state``.

    The stateful aggregate hands over the tasks a batch has changed, and those are merged.
    """
    return run_merged(task_state_stream(log, watermark, span), latest_per_key, out, checkpoint)


def read_task_state(spark: SparkSession, out: str) -> DataFrame:
    return read_snapshot(spark, out)


def run_latest_completed(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest completed task per subject as snapshots under ``out``.

    Nothing is kept in a state store: the snapshot is the state.
    """
    return run_merged(log, latest_completed, out, checkpoint, "append")


def read_latest_completed(spark: SparkSession, out: str) -> DataFrame:
    return read_snapshot(spark, out)


def compact(folded: DataFrame, out: str) -> None:
    """Writes what ``read_*`` returned as the first snapshot of a new place."""
    merge_batch(folded, 0, out, lambda rows: rows, "copy")


def _left(changes: DataFrame) -> DataFrame:
    """Newest row per task without the removed ones; a removal outdoes the row it removes."""
    changes = changes.withColumn("removed", F.coalesce("removed", F.lit(False)))
    newest = F.max_by(
        F.struct(*(c for c in changes.columns if c != "task_id")),
        F.struct(F.coalesce(epoch_micros(F.col("ts")), F.lit(0)), "removed", F.col("status").isin("completed", "failed"), "status", F.coalesce("error", F.lit(""))),
    )
    kept = changes.groupBy("task_id").agg(newest.alias("s")).select("task_id", "s.*")
    return kept.where(~F.col("removed"))


def run_expiring_tasks(
    log: DataFrame, out: str, checkpoint: str, lateness: str = "1 day", ttl_s: int = TTL_S, grace_s: int = TTL_S
) -> StreamingQuery:
    """Keeps the state of live tasks under ``out``; ``read_live_tasks`` reads it.

    Finished tasks leave the store by timers (see ``expiring_changes``) and the snapshot
    with them, so both hold what runs or ended within lateness, time to live and grace.
    """
    with setting(log.sparkSession, PROVIDER, ROCKSDB):  # timers need it; a query keeps the settings it starts with
        return run_merged(expiring_changes(log, lateness, ttl_s, grace_s), _left, out, checkpoint)


def read_live_tasks(spark: SparkSession, out: str, ttl_s: int = TTL_S) -> DataFrame:
    """Tasks that have not expired when the clock stands at the newest time of the log.

    The newest row of the log belongs to a task that is live, so the snapshot has it.
    """
    state = read_snapshot(spark, out).drop("removed")
    newest = state.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    live = expire_tasks(state, newest, ttl_s)
    return live.select("task_id", "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
