"""Task state with a bounded store: finished tasks leave it by event-time timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxtally.functions.status import is_terminal
from voxtally.functions.times import epoch_micros
from voxtally.operators.tasks import TTL_S

# Executors get the processor by value; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "us bigint, terminal boolean, status string, error string, row string"
FIELDS = [x.split()[0] for x in STATE.split(", ")]
CHANGE = Row("task_id", *FIELDS, "removed")
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _order(row: tuple) -> tuple:
    """Newest first of all, a missing time as 0; then terminal before running, as in ``latest_per_key``."""
    us, terminal, status, error, _ = row
    return us or 0, bool(terminal), status is not None, status or "", error or ""


#: Rows folded at once, at least.
FOLD_ROWS = 50_000


def _without_older(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` but those that are older than another of their task; rows without a time stay.

    The processor looks at each row alone and asks the store once a task, so most of a busy log ends here.
    """

    def fold(rows: pa.Table) -> pa.Table:
        timed = rows["us"].is_valid().to_numpy()
        us = pc.fill_null(rows["us"], 0).to_numpy()
        task = pc.fill_null(rows["task_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices, 0).to_numpy()
        newest = np.full(int(task.max()) + 1, np.iinfo(np.int64).min)
        np.maximum.at(newest, task[timed], us[timed])
        return rows.filter(pa.array(~timed | (us == newest[task])))

    held: list[pa.RecordBatch] = []
    count, limit = 0, FOLD_ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= limit:
            held = fold(pa.Table.from_batches(held)).combine_chunks().to_batches()
            count = sum(x.num_rows for x in held)
            limit = max(FOLD_ROWS, 2 * count)
    if held:
        yield from fold(pa.Table.from_batches(held)).to_batches()


class _TaskStates(StatefulProcessor):
    """Newest row per task: ``running`` for good, ``finished`` until its timer.

    Rows, not pandas: most tasks have a few rows a batch, and a frame costs many times what they do. The store is
    asked for no more than a task needs, since each call is a message to the JVM.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", STATE)
        self.finished = handle.getValueState("finished", STATE)

    def _end(self, row: tuple) -> int:
        return row[0] // 1000 + self.keep_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        finished = self.finished.get()
        running = None if finished else self.running.get()
        was = finished or running
        found = best = tuple(was) if was else None
        for given in rows:
            row = tuple(given[x] for x in FIELDS)
            if best is None or _order(row) > _order(best):
                best = row
        if best is found:
            return
        if finished and finished[0] is not None:  # no other task has a timer
            self.handle.deleteTimer(self._end(finished))
        if best[1]:
            self.finished.update(best)
            if running:
                self.running.clear()
            if best[0] is not None:
                self.handle.registerTimer(self._end(best))
        else:
            self.running.update(best)
            if finished:
                self.finished.clear()
        yield CHANGE(key[0], *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self.finished.get()
        if row is None or row[0] is None:
            return
        if expiredTimerInfo.getExpiryTimeInMs() < self._end(row):  # set when less time was to be kept, before a restart
            self.handle.registerTimer(self._end(row))
        else:
            self.finished.clear()
            yield CHANGE(key[0], *row, True)

    def close(self) -> None:
        pass


def expiring_changes(log: DataFrame, lateness: str = "1 day", ttl_s: int = TTL_S, grace_s: int = TTL_S) -> DataFrame:
    """What changes in the state of tasks as the log comes in: the log's columns and ``removed``.

    A row for every task whose newest row has changed, and one with ``removed`` when a
    finished task leaves the store, once the watermark is ``ttl_s`` + ``grace_s`` past it.
    The watermark lags the newest time by ``lateness``; rows that come in later than that
    are dropped and counted by the query's progress, but for those folded before. All others give the state that the
    whole log gives at once, however it is cut into batches. A row without a time counts as
    older than any other; it finds a finished task for as long as that is in the store.
    """
    rest = [c for c in log.columns if c not in ("task_id", "ts", "status", "error")]
    row = F.to_json(F.struct(*rest), TIMES) if rest else F.lit("{}")
    event = F.col("ts").cast("timestamp")
    narrow = log.select(
        "task_id", event.alias("ts"), epoch_micros(F.col("ts")).alias("us"),
        F.coalesce(is_terminal(F.col("status")), F.lit(False)).alias("terminal"), "status", "error", row.alias("row"),
    )
    kind = log.schema["task_id"].dataType.simpleString()
    # The rows of a task come together before they are folded. The watermark sees its newest rows, and a row
    # is too late only if all older ones are.
    folded = narrow.repartition("task_id").mapInArrow(_without_older, narrow.schema)
    states = (
        folded.withWatermark("ts", lateness).groupBy("task_id")
        .transformWithState(
            _TaskStates((ttl_s + grace_s) * 1000), f"task_id {kind}, {STATE}, removed boolean", "Update", "EventTime"
        )
    )
    time = F.timestamp_micros("us")
    time = time if log.schema["ts"].dataType.simpleString() == "timestamp" else time.cast(log.schema["ts"].dataType)
    known = {c: F.col(c) for c in ("task_id", "status", "error")} | {"ts": time}
    back = states.withColumn("row", F.from_json("row", log.select(*rest).schema, TIMES)) if rest else states
    return back.select(*[(known.get(c) if c in known else F.col(f"row.{c}")).alias(c) for c in log.columns], "removed")
