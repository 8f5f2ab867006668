"""Centroid clustering with ns-bounds: exact rounds of Lloyd's method that skip most distances.

For every vector and centroid the last distance measured is kept, with the round it was
measured in. The history of all centroids is kept too, so a later round loosens a stored
distance by the norm of the centroid's total displacement since that round. That is never
more, and often far less, than the sum of the norms of its steps. A vector whose bounds
leave its centroid the nearest beyond doubt is not looked at; for the others the pairs
in doubt are measured exactly, in whole numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from voxtally.session import materialize, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 4096
#: Relative error allowed for stored distances, far above that of their floating point.
SLACK = 1e-9


def chunks_of(vectors: DataFrame, dims: int, scale: int, rows: int) -> DataFrame:
    """Rows of up to ``rows`` vectors: their ids, and floor(scale * x) of their components as 32 or 64 bit integers."""
    most = int((2**63 / dims) ** 0.5) // 2 - 1
    kind = vectors.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = np.floor(batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(terms) and np.abs(terms).max() > most:
                raise ValueError(f"components beyond {most / scale:g} leave no exact distance in 64 bits")
            terms = terms.astype(np.int64).reshape(-1, dims)
            for a in range(0, batch.num_rows, rows):
                part = terms[a : a + rows]
                part = part.astype(np.int32) if np.abs(part).max() < 2**31 else part
                ids = batch["id"].slice(a, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                    ],
                    ["ids", "width", "terms"],
                )

    return vectors.mapInArrow(pack, f"ids array<{kind}>, width int, terms binary")


def matrix(data: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if width == 4 else np.int64).reshape(-1, dims)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from one centroid."""
    gap = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", gap, gap)


def displacement(history: np.ndarray) -> np.ndarray:
    """(rounds, k): how far each centroid has come since each round, from the first to now."""
    gap = (history[-1][None] - history).astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=2))


class State:
    """Of some vectors: ``owner``, and per centroid the last ``measured`` distance and the round ``since`` it holds."""

    def __init__(self, x: np.ndarray, k: int, owner: bytes | None, measured: bytes | None, since: bytes | None):
        n = len(x)
        self.x = x
        self.fresh = owner is None
        self.owner = np.zeros(n, np.int32) if owner is None else np.frombuffer(owner, np.int32).copy()
        self.measured = np.zeros((n, k)) if measured is None else np.frombuffer(measured).reshape(n, k).copy()
        self.since = np.zeros((n, k), np.uint16) if since is None else np.frombuffer(since, np.uint16).reshape(n, k).copy()

    def measure(self, rows: np.ndarray, j: int, history: np.ndarray) -> np.ndarray:
        exact = squared(self.x[rows], history[-1][j])
        self.measured[rows, j] = np.sqrt(exact.astype(np.float64))
        self.since[rows, j] = len(history) - 1
        return exact

    def doubtful(self, rows: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """(rows, k): whether a centroid other than the owner may be as near as the owner."""
        last, moved = self.measured[rows], drift[self.since[rows], np.arange(drift.shape[1])]
        slack = SLACK * (last + moved)
        own = self.owner[rows]
        at = np.arange(len(rows))
        most = (last + moved + slack)[at, own]
        doubt = last - moved - slack <= most[:, None]
        doubt[at, own] = False
        return doubt

    def assign(self, history: np.ndarray) -> int:
        """Moves every vector to its nearest centroid, the smaller number on ties; distances measured."""
        k, n = history.shape[1], len(self.x)
        if self.fresh:
            exact = np.stack([self.measure(np.arange(n), j, history) for j in range(k)], axis=1)
            self.owner = exact.argmin(axis=1).astype(np.int32)
            return n * k
        drift = displacement(history)
        rows = np.flatnonzero(self.doubtful(np.arange(n), drift).any(axis=1))
        exact = np.full((len(rows), k), np.iinfo(np.int64).max)
        for j in np.unique(self.owner[rows]):  # the distance to the owner first: it settles most doubts
            at = np.flatnonzero(self.owner[rows] == j)
            exact[at, j] = self.measure(rows[at], j, history)
        doubt = self.doubtful(rows, drift)
        for j in range(k):
            at = np.flatnonzero(doubt[:, j])
            exact[at, j] = self.measure(rows[at], j, history)
        self.owner[rows] = exact.argmin(axis=1)
        return len(rows) + int(doubt.sum())


STATE_COLUMNS = "owner binary, measured binary, since binary, change array<long>, measures long"


def assign_round(chunks: DataFrame, dims: int, history: np.ndarray) -> DataFrame:
    """The chunks with their state after one more assignment, and what it changes in each cluster's count and sums."""
    k = history.shape[1]
    kind = chunks.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                old = {c: one[c][0].as_py() for c in ("owner", "measured", "since")} if "owner" in batch.schema.names else {}
                x = matrix(one["terms"][0].as_buffer(), one["width"][0].as_py(), dims)
                state = State(x, k, *(old.get(c) for c in ("owner", "measured", "since")))
                before = state.owner.copy()
                measures = state.assign(history)
                change = np.zeros((k, dims + 1), np.int64)
                moved = np.arange(len(x)) if state.fresh else np.flatnonzero(before != state.owner)
                for sign, owners in ((1, state.owner), (-1, before)):
                    if sign == 1 or not state.fresh:
                        for j in np.unique(owners[moved]):
                            own = moved[owners[moved] == j]
                            change[j, 0] += sign * len(own)
                            change[j, 1:] += sign * x[own].sum(axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        one["ids"], one["width"], one["terms"], pa.array([state.owner.tobytes()], pa.binary()),
                        pa.array([state.measured.tobytes()], pa.binary()), pa.array([state.since.tobytes()], pa.binary()),
                        pa.array([change.ravel()], pa.list_(pa.int64())), pa.array([measures], pa.int64()),
                    ],
                    ["ids", "width", "terms", "owner", "measured", "since", "change", "measures"],
                )

    return chunks.mapInArrow(run, f"ids {kind}, width int, terms binary, {STATE_COLUMNS}")


def owners(chunks: DataFrame, dims: int, last: np.ndarray) -> DataFrame:
    """One row per vector: id, cluster and exact squared distance."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                owner = np.frombuffer(one["owner"][0].as_buffer(), np.int32)
                x = matrix(one["terms"][0].as_buffer(), one["width"][0].as_py(), dims)
                yield pa.RecordBatch.from_arrays(
                    [one["ids"].flatten(), pa.array(owner), pa.array(squared(x, last[owner]))], ["id", "cluster", "distance"]
                )

    return chunks.select("ids", "width", "terms", "owner").mapInArrow(run, f"id {kind}, cluster int, distance long")


def moved_centroids(last: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """floor(sum / count) for each component; a cluster without vectors keeps its centroid."""
    return np.array([[s // row[0] for s in row[1:]] if row[0] else list(c) for c, row in zip(last.tolist(), sums, strict=True)], np.int64)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int | str = 3,
    id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS,
    watch: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Clusters vectors of ``dims`` components x, taken as floor(``scale`` * x), by exact k-means rounds.

    Columns: the id, cluster, distance (squared, to the final centroid), cluster_inertia
    and inertia (distances summed over the cluster and over all) and centroid. Centroids
    start as the k vectors whose SHA-256 of "``seed``:id" is smallest, in that order (by
    components where ids repeat). A round assigns every vector to its nearest centroid, the
    smaller number on ties, and moves centroids to floor(sum / count). After ``rounds``
    of them vectors are assigned once more. Results equal those of a full scan: whole
    numbers decide, and bounds only spare distances that cannot matter.

    The vectors lie in chunks, with their state, in the shared folder; a round reads one
    folder and writes the other of two, so the disk holds the vectors twice however many
    rounds there are, and a lost executor costs its chunks of one round. The driver holds
    the centroids of all rounds and one sum per cluster and component.
    ``watch(round, distances measured)`` is told of each round.

    Null vectors, those of other lengths and those with null or non-finite components take
    no part. Rows with a null id are clustered but start no centroid; repeated rows count
    each. With fewer vectors than k there are as many centroids as vectors with ids; without
    any, and for an empty table, no rows. Components so large that a squared distance could
    leave 64 bits raise an error. Other columns are not read.
    """
    if not 0 < rounds < 1 << 16:
        raise ValueError("rounds must be between 1 and 65535")
    spark = vectors.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce((F.size(x) == dims) & finite, F.lit(False))
    kept = vectors.filter(usable).select(F.col(id_col).alias("id"), x.cast("array<double>").alias("x"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.filter("id IS NOT NULL").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long"
    if not first:
        empty = spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
        return empty.withColumnRenamed("id", id_col)
    history = np.floor(np.array([r.x for r in first]) * scale).astype(np.int64)[None]
    k = len(first)
    chunks = chunks_of(kept, dims, scale, chunk_rows)
    folders = [shared_folder(spark, "clusters") for _ in range(2)]
    sums = [[0] * (dims + 1) for _ in range(k)]
    for t in range(rounds + 1):
        step = assign_round(chunks, dims, history)
        step.write.mode("overwrite").parquet(folders[t % 2])
        chunks = spark.read.schema(step.schema).parquet(folders[t % 2])
        if watch:
            watch(t, chunks.agg(F.coalesce(F.sum("measures"), F.lit(0))).first()[0])
        if t < rounds:
            changes = chunks.select(F.posexplode("change").alias("place", "by")).filter("by <> 0")
            for place, by in changes.groupBy("place").agg(F.sum("by")).collect():
                sums[place // (dims + 1)][place % (dims + 1)] += by
            history = np.concatenate([history, moved_centroids(history[-1], sums)[None]])
    out = materialize(owners(chunks, dims, history[-1]), "clustered")
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())
    table = [(j, int(d), sum(inertia.values()), history[-1][j].tolist()) for j, d in inertia.items()]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    known = materialize(known, "centroids")  # of a size Catalyst knows: a few rows, joined without a shuffle
    return out.join(known, "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
