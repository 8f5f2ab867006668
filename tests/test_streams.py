"""Task state as streams: bounded stores, and snapshots that switch in one step."""

import itertools
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from test_tasks import LOG, T0, TASK_LOG_SCHEMA, feed, stream  # noqa: F401  the fixture comes along
from voxtally.operators import tasks
from voxtally.plans import driver_queries
from voxtally.streaming import expiry, snapshots, tasks as live

HOUR = timedelta(hours=1)


def kept(spark, checkpoint, var):
    return {r.key.task_id for r in spark.read.format("statestore").option("stateVarName", var).load(checkpoint).collect()}


def test_expired_tasks_leave_the_store(spark, feed, tmp_path, rows):  # noqa: F811
    """Finished tasks go from store and snapshot once the watermark is past their time to live; running ones stay."""
    out, point = str(tmp_path / "o"), str(tmp_path / "c")

    def arrive(*log):
        path = feed(list(log), 0)
        live.run_expiring_tasks(stream(spark, path), out, point, "1 hour", grace_s=0).awaitTermination()

    arrive(("done", "s", "completed", None, T0), ("busy", "s", "running", None, T0), ("timeless", "s", "failed", "x", None))
    assert kept(spark, point, "finished") == {"done", "timeless"} and kept(spark, point, "running") == {"busy"}
    arrive(("late", "s", "completed", None, T0 + 4 * HOUR))
    # The watermark is at 3 hours, past the end of "done" and not of "late"; without a time nothing expires.
    assert kept(spark, point, "finished") == {"late", "timeless"} and kept(spark, point, "running") == {"busy"}
    assert rows(live.read_snapshot(spark, out), "task_id") == [("busy",), ("late",), ("timeless",)]
    assert rows(live.read_live_tasks(spark, out), "task_id") == [("busy",), ("late",), ("timeless",)]
    # A task that ended once may run again, and the end of a running one makes it finished.
    arrive(("done", "s", "running", None, T0 + 4 * HOUR), ("busy", "s", "failed", "x", T0 + 4 * HOUR))
    assert kept(spark, point, "finished") == {"late", "timeless", "busy"} and kept(spark, point, "running") == {"done"}


STORY = [
    ("a", "s", "running", None, T0), ("a", "s", "completed", None, T0 + HOUR / 4), ("b", "s", "running", None, T0 + HOUR),
    ("a", "s", "running", None, None), ("c", "s", "failed", "x", None), ("c", "s", "running", None, T0 + HOUR),
    # Rows that come in after newer ones, the first of them the end of a task.
    ("b", "s", "completed", None, T0 + 5 * HOUR), ("d", "s", "failed", "y", T0 + 3 * HOUR), ("d", "s", "running", None, T0 + 2 * HOUR),
    ("e", "s", "completed", None, T0 + 4.5 * HOUR), ("a", "s", "failed", "z", T0 + HOUR / 8), ("c", "s", "failed", "w", None),
]


@pytest.mark.parametrize("cuts", [(), (3, 7), (1, 2, 4, 6, 9, 11)])
def test_expiry_in_any_split(spark, feed, tmp_path, rows, cuts):  # noqa: F811
    """Late ends and rows without a time give what the whole log gives at once, wherever it is cut."""
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for a, b in itertools.pairwise((0, *cuts, len(STORY))):
        path = feed(STORY[a:b], 0)
        live.run_expiring_tasks(stream(spark, path), out, point, "6 hours").awaitTermination()
    whole = spark.createDataFrame(STORY, TASK_LOG_SCHEMA)
    want = tasks.expire_tasks(tasks.latest_per_key(whole), F.lit(T0 + 5 * HOUR))
    got = live.read_snapshot(spark, out).join(live.read_live_tasks(spark, out).select("task_id"), "task_id")
    assert sorted(map(str, got.select(*TASK_LOG_SCHEMA.names).collect())) == sorted(map(str, want.select(*TASK_LOG_SCHEMA.names).collect()))


@pytest.mark.parametrize("cuts", [(), (2, 5, 8)])
def test_state_of_old_spans_leaves_the_aggregate(spark, feed, tmp_path, rows, cuts):  # noqa: F811
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for a, b in itertools.pairwise((0, *cuts, len(STORY))):
        path = feed(STORY[a:b], 0)
        live.run_task_state(stream(spark, path), out, point, "6 hours", "1 hour").awaitTermination()
    want = tasks.latest_per_key(spark.createDataFrame(STORY, TASK_LOG_SCHEMA))
    names = TASK_LOG_SCHEMA.names
    assert sorted(map(str, live.read_task_state(spark, out).select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    feed([("z", "s", "running", None, T0 + 24 * HOUR)], 0)
    live.run_task_state(stream(spark, path), out, point, "6 hours", "1 hour").awaitTermination()
    state = spark.read.format("statestore").load(point).select("key.task_id").collect()
    assert [r.task_id for r in state] == ["z"]
    assert live.read_task_state(spark, out).count() == want.count() + 1


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "task_id string, status string, ts timestamp")


def test_snapshot_merges_each_batch_once_and_keeps_few_versions(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    assert snapshots.read_snapshot(spark, root) is None
    for i in range(6):
        batch = frame(spark, ("a", f"s{i}", T0 + i * HOUR), (f"k{i}", "running", T0))
        snapshots.merge_batch(batch, i, root, tasks.latest_per_key, "one")
        before = snapshots.versions(spark, root)
        snapshots.merge_batch(frame(spark, ("a", "again", T0 + 99 * HOUR)), i, root, tasks.latest_per_key, "one")
        assert snapshots.versions(spark, root) == before
        # A read costs the live rows, however many batches there were.
        assert rows(snapshots.read_snapshot(spark, root), "task_id") == [("a",), *((f"k{j}",) for j in range(i + 1))]
    assert [v.number for v in snapshots.versions(spark, root)] == [3, 4, 5]
    assert sorted(p.name for p in (tmp_path / "t").glob("v=*")) == ["v=3", "v=4", "v=5"]
    # Another source, as a stream begun anew with a fresh checkpoint, counts its own batches.
    snapshots.merge_batch(frame(spark, ("new", "running", T0)), 0, root, tasks.latest_per_key, "two")
    assert snapshots.read_snapshot(spark, root).count() == 8


def test_reader_keeps_its_version_while_the_table_moves_on(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.merge_batch(frame(spark, ("a", "running", T0)), 0, root, tasks.latest_per_key)
    reader = snapshots.read_snapshot(spark, root)
    snapshots.merge_batch(frame(spark, ("b", "running", T0)), 1, root, tasks.latest_per_key)
    assert reader.count() == 1 and snapshots.read_snapshot(spark, root).count() == 2


def test_an_attempt_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    """Data without a marker is not seen, and the next attempt replaces it."""
    root = str(tmp_path / "t")
    snapshots.merge_batch(frame(spark, ("a", "running", T0)), 0, root, tasks.latest_per_key)
    with monkeypatch.context() as m:
        m.setattr(snapshots._Files, "create", lambda self, name: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshots.merge_batch(frame(spark, ("b", "running", T0), ("c", "running", T0)), 1, root, tasks.latest_per_key)
    assert snapshots.read_snapshot(spark, root).count() == 1
    snapshots.merge_batch(frame(spark, ("b", "running", T0)), 1, root, tasks.latest_per_key)
    assert snapshots.read_snapshot(spark, root).count() == 2


def test_latest_completed_snapshot_after_restarts(spark, feed, tmp_path, rows):  # noqa: F811
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for a, b in itertools.pairwise((0, 2, 5, len(LOG))):
        path = feed(LOG[a:b], 0)
        live.run_latest_completed(stream(spark, path), out, point).awaitTermination()
        want = tasks.latest_completed(spark.createDataFrame(LOG[:b], TASK_LOG_SCHEMA))
        assert rows(live.read_latest_completed(spark, out), "subject", "task_id") == rows(want, "subject", "task_id")
    # Nothing new: no version more.
    before = snapshots.versions(spark, out)
    live.run_latest_completed(stream(spark, path), out, point).awaitTermination()
    assert snapshots.versions(spark, out) == before


def test_number_of_batches_does_not_grow_with_the_files(spark, tmp_path):
    rows = [(i, T0 + i * HOUR, i % 7, "purchase" if i % 3 else "view", 1.0, "{}") for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    with live.setting(spark, "spark.sql.files.openCostInBytes", str(1 << 30)):  # a task a file, as for large ones
        stream_, _ = driver_queries._arrivals(spark, str(tmp_path))
    sizes = []
    stream_.writeStream.foreachBatch(lambda batch, i: sizes.append(batch.count())).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == len(rows) and 4 <= len(sizes) < 8


def test_rows_older_than_another_of_their_task_do_not_reach_the_store(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(expiry, "FOLD_ROWS", 4)
    log = [("a", 5, "x"), ("b", None, "y"), ("a", 7, "z"), (None, 3, "n"), (None, 4, "m"), ("a", None, "t"), ("a", 7, "w"), ("b", -2, "v"), ("c", 0, "u"), ("a", 6, "s")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("task_id", "us", "row"), r, strict=True)) for r in log[i : i + 3]], pa.schema({"task_id": pa.string(), "us": pa.int64(), "row": pa.string()})) for i in range(0, len(log), 3)]
    kept_rows = "".join(sorted(x for b in expiry._without_older(iter([*batches, batches[0].slice(0, 0)])) for x in b["row"].to_pylist()))
    assert kept_rows == "mtuvwyz"
    assert list(expiry._without_older(iter([]))) == [] == list(expiry._without_older(iter([batches[0].slice(0, 0)])))


def test_a_restart_that_keeps_longer_outdoes_older_timers(spark, feed, tmp_path):  # noqa: F811
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for grace, log in ((0, ("done", T0)), (8 * 3600, ("late", T0 + 4 * HOUR)), (8 * 3600, ("later", T0 + 12 * HOUR))):
        path = feed([(log[0], "s", "completed", None, log[1])], 0)
        live.run_expiring_tasks(stream(spark, path), out, point, "1 hour", grace_s=grace).awaitTermination()
        assert ("done" in kept(spark, point, "finished")) == (log[0] != "later")
