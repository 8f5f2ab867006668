"""Analysis-task state as tables.

A task log has ``task_id, subject, status, error, ts, error_code`` and is only appended
to. The state of a task is its newest log row. The code is set where a failure happens;
no text is searched for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.status import (
    ANALYSIS_FAILED, COMPLETED, FAILED, NOT_FOUND, RUNNING, is_terminal, user_message,
)
from voxtally.functions.text import clean_company_url
from voxtally.functions.times import age_micros, epoch_micros

TTL_S, LIMIT_S = 3600, 180
_SECOND = 1_000_000


def _newest(columns: list[str]) -> Column:
    """The row to keep: newest, a missing time as 0; then terminal before running."""
    order = F.struct(
        F.coalesce(epoch_micros(F.col("ts")), F.lit(0)),
        is_terminal(F.col("status")),
        F.col("status"),
        F.coalesce(F.col("error"), F.lit("")) if "error" in columns else F.lit(""),
    )
    return F.max_by(F.struct(*columns), order)


def latest_per_key(log: DataFrame, *key: str) -> DataFrame:
    """Current state of every task, or of every value of ``key``.

    An aggregate, not a window: the log of a busy task is folded before the
    shuffle and an older row never replaces a newer one.
    """
    key = key or ("task_id",)
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(_newest(rest).alias("s")).select(*key, "s.*")


def completed_for(tasks: DataFrame, subject: str, company: bool = False) -> DataFrame:
    """Completed tasks of one subject. A stored company URL is cleaned before comparing."""
    done = tasks.where(F.col("status") == COMPLETED)
    if not company:
        return done.where(F.col("subject") == subject)
    return done.where(
        clean_company_url(F.col("subject")) == clean_company_url(F.lit(subject))
    )


def latest_completed(tasks: DataFrame, key: str = "subject") -> DataFrame:
    """Newest completed task per subject; on equal time the smallest task id."""
    rest = [c for c in tasks.columns if c != key]
    order = F.struct(-F.coalesce(epoch_micros(F.col("ts")), F.lit(0)), F.col("task_id"))
    return (
        tasks.where(F.col("status") == COMPLETED)
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), order).alias("s"))
        .select(key, "s.*")
    )


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("task_count"))


def task_status(ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """State of the asked ids; an unknown id reads ``not_found``."""
    return ids.join(tasks.select("task_id", "status", "error", "ts"), "task_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(NOT_FOUND))
    )


def _expired(as_of: Column | None, ttl_s: int) -> Column:
    return is_terminal(F.col("status")) & (age_micros(F.col("ts"), as_of) > ttl_s * _SECOND)


def expire_tasks(tasks: DataFrame, as_of: Column | None = None, ttl_s: int = TTL_S) -> DataFrame:
    """Tasks that stay: all but terminal ones older than the time to live."""
    return tasks.where(~_expired(as_of, ttl_s))


def expired_tasks(tasks: DataFrame, as_of: Column | None = None, ttl_s: int = TTL_S) -> DataFrame:
    """Tasks that ``expire_tasks`` drops."""
    return tasks.where(_expired(as_of, ttl_s))


def classify_timeouts(
    log: DataFrame, as_of: Column | None = None, limit_s: int = LIMIT_S
) -> DataFrame:
    """Outcome per task: a task still running ``limit_s`` after its first row timed out."""
    first = log.groupBy("task_id").agg(
        F.min("ts").alias("first_ts"), _newest(["ts", "status"]).alias("s")
    )
    age = age_micros(F.col("first_ts"), as_of)
    waiting = ~is_terminal(F.col("s.status"))
    return first.select(
        "task_id",
        "first_ts",
        F.col("s.ts").alias("last_ts"),
        F.when(waiting & (age >= limit_s * _SECOND), "timeout")
        .otherwise(F.col("s.status"))
        .alias("outcome"),
    )


def failure_log(tasks: DataFrame) -> DataFrame:
    """Failed tasks with failure kind and the text a user is shown.

    A failure without a code, as in a log that has none, is an ``analysis_failed``.
    """
    failed = tasks.where(F.col("status") == FAILED)
    code = F.col("error_code") if "error_code" in tasks.columns else F.lit(None)
    return failed.select(
        "task_id",
        "subject",
        "ts",
        "error",
        F.coalesce(code, F.lit(ANALYSIS_FAILED)).alias("error_code"),
    ).withColumn("user_message", user_message(F.col("error_code"), F.col("error")))


def union_tasks(product_tasks: DataFrame, company_tasks: DataFrame) -> DataFrame:
    """Product and company tasks in one table; the other kind's column is null."""
    return product_tasks.unionByName(company_tasks, allowMissingColumns=True)


def start_tasks(subjects: DataFrame, task_id: Column, as_of: Column | None = None) -> DataFrame:
    """First log row of new tasks, one per row of ``subjects``."""
    return subjects.select(
        task_id.alias("task_id"),
        "subject",
        F.lit(RUNNING).alias("status"),
        F.lit(None).cast("string").alias("error"),
        (F.current_timestamp() if as_of is None else as_of).alias("ts"),
        F.lit(None).cast("string").alias("error_code"),
    )
