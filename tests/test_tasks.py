"""Task state, batch and stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from voxtally.functions import status as st
from voxtally.operators import tasks
from voxtally.schemas import TASK_LOG_SCHEMA as FULL_LOG
from voxtally.streaming import ingest
from voxtally.streaming import tasks as live

T0 = datetime(2024, 1, 1, 12)
# Most tests have no use for the code of a failure; a log may lack it.
TASK_LOG_SCHEMA = T.StructType(FULL_LOG.fields[:5])


def now():
    return F.lit(T0)


def at(seconds):
    return T0 - timedelta(seconds=seconds)


LOG = [
    ("a", "s1", "running", None, at(5000)), ("a", "s1", "completed", None, at(3600)),
    ("b", "s1", "completed", None, at(3601)), ("c", "s2", "running", None, at(9999)),
    ("d", "s2", "failed", "x", None), ("e", "s2", "running", None, at(100)),
    ("e", "s2", "failed", "late", at(100)), ("f", "s3", "completed", None, at(50)),
    ("f", "s3", "running", None, at(60)), ("g", "s1", "completed", None, at(3600)),
]
STATE = {
    "a": "completed", "b": "completed", "c": "running", "d": "failed", "e": "failed",
    "f": "completed", "g": "completed",
}


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, TASK_LOG_SCHEMA)


def test_state_is_the_newest_row(log, rows):
    assert dict(rows(tasks.latest_per_key(log), "task_id", "status")) == STATE
    assert dict(rows(tasks.latest_per_key(log.orderBy(F.desc("ts"))), "task_id", "status")) == STATE


def test_expiry_is_strict_and_spares_running_and_untimed(log, rows):
    state = tasks.latest_per_key(log)
    assert [r[0] for r in rows(tasks.expire_tasks(state, now()), "task_id")] == list("acdefg")
    assert [r[0] for r in rows(tasks.expired_tasks(state, now()), "task_id")] == ["b"]


def test_latest_completed_takes_the_smallest_id_on_a_tie(log, rows):
    assert rows(tasks.latest_completed(tasks.latest_per_key(log)), "subject", "task_id") == [
        ("s1", "a"), ("s3", "f"),
    ]


def test_status_of_unknown_id(spark, log, rows):
    ids = spark.createDataFrame([("a",), ("zz",)], "task_id string")
    got = tasks.task_status(ids, tasks.latest_per_key(log))
    assert rows(got, "task_id", "status") == [("a", "completed"), ("zz", "not_found")]


@pytest.mark.parametrize("age, outcome", [(179, "running"), (180, "timeout"), (9999, "timeout")])
def test_timeout_boundary(spark, age, outcome):
    log = spark.createDataFrame([("t", "s", "running", None, at(age))], TASK_LOG_SCHEMA)
    assert tasks.classify_timeouts(log, now()).first().outcome == outcome


def test_finished_task_is_no_timeout(log, rows):
    got = dict(rows(tasks.classify_timeouts(log, now()), "task_id", "outcome"))
    assert (got["a"], got["c"], got["e"]) == ("completed", "timeout", "failed")


def test_company_tasks_compare_clean_urls(log):
    stored = log.withColumn("subject", F.concat(F.lit("https://www."), "subject", F.lit(".com/")))
    assert tasks.completed_for(stored, "S1.com ", company=True).count() == 3
    assert tasks.completed_for(log, "s1").count() == 3


def test_failures_have_a_kind_and_a_message(spark, rows):
    found = [
        (st.INSUFFICIENT_TEXT % (3, 50), st.INSUFFICIENT), (st.NO_REVIEWS_TEXT, st.NO_REVIEWS),
        (st.FETCH_FAILED_TEXT % "404", st.FETCH_FAILED), ("boom", None), (None, None),
    ]
    log = spark.createDataFrame(
        [(str(i), "s", "failed", t, T0, c) for i, (t, c) in enumerate(found)], FULL_LOG
    )
    got = {r.task_id: (r.error_code, r.user_message) for r in tasks.failure_log(log).collect()}
    assert [got[str(i)][0] for i in range(5)] == [
        "insufficient", "no_reviews", "fetch_failed", "analysis_failed", "analysis_failed",
    ]
    assert got["0"][1] == st.INSUFFICIENT_NOTICE and got["3"][1] == "boom"
    assert got["4"][1] == "Analysis failed"
    # A log without codes knows of no kind; texts are not searched.
    old = {r.error_code for r in tasks.failure_log(log.drop("error_code")).collect()}
    assert old == {st.ANALYSIS_FAILED}


def test_start_and_union(spark, rows):
    subjects = spark.createDataFrame([("s",)], "subject string")
    start = tasks.start_tasks(subjects, st.task_id(F.col("subject"), F.lit(5)), now())
    assert start.first().status == "running" and start.schema.names == FULL_LOG.names
    both = tasks.union_tasks(
        start.withColumnRenamed("subject", "product_title"),
        start.withColumnRenamed("subject", "company_url"),
    )
    assert both.count() == 2 and both.where("product_title is null").count() == 1


@pytest.fixture
def feed(spark, tmp_path):
    """Log rows as files that arrive one after the other."""

    def add(rows, name):
        frame = spark.createDataFrame(rows, TASK_LOG_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "log"))
        return str(tmp_path / "log")

    return add


def stream(spark, path):
    return ingest.scan_stream(spark, path, TASK_LOG_SCHEMA, files_per_trigger=1)


@pytest.mark.parametrize("order", [1, -1])
def test_state_stream_equals_batch_after_restart(spark, feed, tmp_path, rows, order, log):
    parts = [LOG[:5], LOG[5:]][::order]
    out, done, point = (str(tmp_path / n) for n in ("out", "done", "cp"))
    for i, part in enumerate(parts):
        path = feed(part, i)
        live.run_task_state(stream(spark, path), out, point).awaitTermination()
        live.run_latest_completed(stream(spark, path), done, point + "2").awaitTermination()
    assert dict(rows(live.read_task_state(spark, out), "task_id", "status")) == STATE
    assert rows(live.read_latest_completed(spark, done), "subject", "task_id") == rows(
        tasks.latest_completed(log), "subject", "task_id"
    )
    live.compact(live.read_task_state(spark, out), str(tmp_path / "fresh"))
    assert dict(rows(live.read_task_state(spark, str(tmp_path / "fresh")), "task_id", "status")) == STATE


def test_state_stream_in_complete_mode(spark, feed, rows):
    path = feed(LOG[:4], 0)
    feed(LOG[4:], 1)
    q = (
        live.task_state_stream(stream(spark, path)).writeStream.format("memory")
        .queryName("state").outputMode("complete").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert dict(rows(spark.table("state"), "task_id", "status")) == STATE


@pytest.mark.parametrize("order", [1, -1])
def test_expiry_stream_in_any_batch_order(spark, feed, tmp_path, rows, order):
    """One row a file, one file a batch, rows without a time and restarts: as the whole log at once."""
    log = [*LOG, ("z", "s", "running", None, T0)][::order]
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for i in range(0, len(log), 4):
        for row in log[i : i + 4]:
            path = feed([row], i)
        live.run_expiring_tasks(stream(spark, path), out, point).awaitTermination()
    whole = spark.createDataFrame(log, TASK_LOG_SCHEMA)
    newest = whole.agg(F.max("ts")).first()[0]
    want = tasks.expire_tasks(tasks.latest_per_key(whole), F.lit(newest))
    assert rows(live.read_live_tasks(spark, out), "task_id", "status") == rows(want, "task_id", "status")
    # Two hours later the rest is gone, except what still runs or has no time.
    feed([("z", "s", "running", None, T0 + timedelta(hours=2))], 2)
    live.run_expiring_tasks(stream(spark, path), out, point).awaitTermination()
    left = {r[0] for r in rows(live.read_live_tasks(spark, out), "task_id")}
    assert {"c", "z"} <= left < set(STATE) | {"z"}


def test_ingest_stream_adds_each_file_once(spark, feed, tmp_path):
    path = feed(LOG[:3], 0)
    out, point = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (None, LOG[3:], None):
        if part:
            feed(part, 1)
        ingest.ingest_stream(
            stream(spark, path), lambda d: d.where("status <> 'running'"), out, point
        ).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_quarantine_stream(spark, feed, tmp_path):
    path = feed(LOG, 0)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    ingest.quarantine_stream(
        stream(spark, path), F.when(F.col("ts").isNull(), "no time"), good, bad, str(tmp_path / "cp")
    ).awaitTermination()
    assert (spark.read.parquet(good).count(), spark.read.parquet(bad).count()) == (9, 1)
