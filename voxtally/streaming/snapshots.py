"""A table kept as versioned snapshots: a batch is merged in, and readers switch in one step.

Version n lies in ``v=n``. An empty marker file named ``n.source.batch`` makes it the
current one: creating a file is atomic in every store Hadoop reads, so a reader sees the
version before or the one after, never a mixture. Marker and folder of versions that no
reader needs any more are removed, so a read costs the live rows and not the history.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

MARKERS = "_versions"
#: Versions that stay readable behind the current one.
KEEP = 2


@dataclass(frozen=True, order=True)
class Version:
    number: int
    source: str
    batch: int

    @property
    def marker(self) -> str:
        return f"{self.number:012d}.{self.source}.{self.batch}"


class _Files:
    """The few file operations the versions need, on whatever store the folder is in."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        where = self.at(folder) if folder else self.path(self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def create(self, name: str) -> None:
        self.fs.create(self.at(name), False).close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def versions(spark: SparkSession, root: str) -> list[Version]:
    """Committed versions, oldest first."""
    parts = [n.split(".") for n in _Files(spark, root).names(MARKERS) if n.count(".") == 2 and n[0].isdigit()]
    return sorted(Version(int(number), source, int(batch)) for number, source, batch in parts)


def read_snapshot(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame | None:
    """The current version, or a given one; None before the first."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    return spark.read.parquet(f"{root.rstrip('/')}/v={version.number}")


def merge_batch(
    batch: DataFrame, batch_id: int, root: str, fold: Callable[[DataFrame], DataFrame], source: str = "batch", keep: int = KEEP
) -> None:
    """Makes the fold of the current version and ``batch`` the current version.

    A batch of ``source`` that was merged already changes nothing, so a stream may repeat
    its last batch after a restart. What an attempt that failed has written is replaced.
    One writer a table.
    """
    spark = batch.sparkSession
    files, known = _Files(spark, root), versions(spark, root)
    if any(v.source == source and v.batch >= batch_id for v in known):
        return
    rows = batch if not known else read_snapshot(spark, root, known[-1]).unionByName(batch, allowMissingColumns=True)
    new = Version(known[-1].number + 1 if known else 0, source, batch_id)
    fold(rows).write.mode("overwrite").parquet(f"{files.root}/v={new.number}")
    files.create(f"{MARKERS}/{new.marker}")
    for old in known[: len(known) - keep]:
        # The marker first: a version that is listed is whole.
        files.remove(f"{MARKERS}/{old.marker}")
        files.remove(f"v={old.number}")


def run_merged(
    changes: DataFrame, fold: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "update"
) -> StreamingQuery:
    """Merges all that has arrived into the snapshots below ``out``, batch by batch, and stops.

    Batches are known by the checkpoint they belong to, so a stream begun anew with a fresh
    checkpoint goes on from the table as it is.
    """
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, out, fold, source)

    return (
        changes.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
