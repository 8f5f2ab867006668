"""Which fingerprints occur more than once in a corpus: the shared part of both repeat operators.

Texts are packed into chunks of a few MB, written once to the shared folder. A task
sends the distinct fingerprints of a chunk, sorted, to groups chosen by an independent
second hash; each group sorts what it got, compares neighbours and answers one bit per
fingerprint. So a fingerprint travels once per chunk however often it occurs there, a
group has a bounded number of them, and the answer is small. The second hash adds
log2(groups) bits to the 64 compared: the groups grow with the corpus, so the chance
of a false repeat for one window stays near 1e-13 at any size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.words import mixed, slices, window_hashes
from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20
GROUP_SIZE = 1 << 21

CHUNK_SCHEMA = "chunk long, size long, packed binary"
SENT_SCHEMA = "part int, chunk long, prints binary"
FLAG_SCHEMA = "chunk long, part int, bits binary"


def packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack_chunks(docs: DataFrame, text: str, size_of: Callable[[pa.Array], int]) -> DataFrame:
    """One row per few MB of consecutive rows of ``docs``, written to the shared folder.

    A chunk is named by partition and place; as the rows are written once, the name
    holds whatever tasks are repeated later. ``size`` bounds the fingerprints in it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, text, CHUNK_BYTES):
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [name], "size": [size_of(part.column(text))], "packed": [packed(part)]},
                    schema=pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())]),
                )
                name += 1

    return materialize(docs.mapInArrow(pack, CHUNK_SCHEMA), "chunks")


def group_count(chunks: DataFrame, group_size: int) -> int:
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(1, -(-total // group_size))


def distinct(prints: np.ndarray, second: np.ndarray, groups: int):
    """Distinct fingerprints in sorted order with their groups; the inverse and the counts."""
    values, place, inverse, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    part = (second[place] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    return values, part.astype(np.int64), inverse, counts


def by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parts, bounds): positions sorted by part, the parts that occur, and where each begins in the order.

    The work follows the number of fingerprints, however many groups there are.
    """
    order = np.argsort(part, kind="stable")
    ranked = part[order]
    begins = np.flatnonzero(np.diff(ranked, prepend=-1))
    return order, ranked[begins], np.append(begins, len(part))


def send_rows(name: int, prints: np.ndarray, second: np.ndarray, groups: int) -> pa.RecordBatch:
    values, part, _, _ = distinct(prints, second, groups)
    order, used, bounds = by_part(part)
    values = values[order]
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(used, pa.int32()),
            "chunk": pa.array([name] * len(used), pa.int64()),
            "prints": pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        }
    )


def mark(table: pa.Table) -> pa.Table:
    """Sorts the fingerprints of a group and marks those equal to a neighbour."""
    lists = [np.frombuffer(x, np.uint64) for x in table["prints"].to_pylist()]
    both = np.concatenate(lists)
    order = np.argsort(both)
    ranked = both[order]
    equal = np.zeros(len(both) + 1, bool)
    equal[1:-1] = ranked[1:] == ranked[:-1]
    repeated = np.empty(len(both), bool)
    repeated[order] = equal[:-1] | equal[1:]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pa.table(
        {
            "chunk": table["chunk"],
            "part": table["part"],
            "bits": pa.array([np.packbits(x).tobytes() for x in np.split(repeated, cuts)], pa.binary()),
        }
    )


def flags_of(sent: DataFrame) -> DataFrame:
    return sent.groupBy("part").applyInArrow(mark, FLAG_SCHEMA)


def read_flags(prints: np.ndarray, second: np.ndarray, groups: int, flags: pa.Table) -> np.ndarray:
    """Whether each fingerprint of a chunk occurs anywhere else, from the answers to ``send_rows``."""
    values, part, inverse, counts = distinct(prints, second, groups)
    repeated = counts > 1
    order, used, bounds = by_part(part)
    places = np.searchsorted(used, flags["part"].to_numpy())
    for k, bits in zip(places.tolist(), flags["bits"].to_pylist(), strict=True):
        own = order[bounds[k] : bounds[k + 1]]
        repeated[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return repeated[inverse]


def covered(starts: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which words lie in one of the windows of ``size`` words at ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:-1]) > 0


def second_hash(prints: np.ndarray, hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the same windows that does not follow from the first."""
    return window_hashes(mixed(hashes ^ np.uint64(0xA0761D6478BD642F)), size, 0xDA942042E4DD58B5)[starts]


def output_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()
