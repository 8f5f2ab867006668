"""Exact top-k search by inner product, block at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1024
LANE_BLOCKS = 16
#: Blocks whose bounds one task looks at, and blocks of queries it does so for.
SUMMARY_BLOCKS = 4096
SUMMARY_QUERIES = 8
BLOCK_SCHEMA = "dim int, ids binary, terms binary, lowest binary, highest binary, part int, place int"
FOUND = pa.struct([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])
FOUND_SCHEMA = "query_id long, vec_id long, score long"
#: Blocks of queries that one copy of a block serves before it is copied once more.
COPIES = 64


def blocks_of(vectors: DataFrame, rows: int, purpose: str) -> DataFrame:
    """Forward indexes of ranges of up to ``rows`` vectors of one length, with each term's smallest and largest value.

    Written to the shared folder and numbered from 0 without gaps in ``at``.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch["terms"]
            sizes = column.value_lengths().to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                ids = batch["vec_id"].to_numpy()[own]
                terms = column.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
                for a in range(0, len(own), rows):
                    part = np.ascontiguousarray(terms[a : a + rows])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "ids": [ids[a : a + rows].tobytes()],
                            "terms": [part.tobytes()],
                            "lowest": [part.min(axis=0).tobytes()],
                            "highest": [part.max(axis=0).tobytes()],
                            "part": pa.array([here], pa.int32()),
                            "place": pa.array([place], pa.int32()),
                        }
                    )
                    place += 1

    ranged = vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    blocks = materialize(ranged.mapInArrow(block, BLOCK_SCHEMA), purpose)
    # One row per partition, as many as the shuffle has.
    counts = blocks.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(before, "part").withColumn("at", F.col("before") + F.col("place")).drop("part", "place", "before")


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products; by floating point where no sum can leave the 53 bits it holds exactly."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[-1], 1)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(rows, dim)


def bounds_of(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No score of a query in a block exceeds the sum of its values times the block's extremes."""
    return inner(np.maximum(asked, 0), high) + inner(np.minimum(asked, 0), low)


def summaries(blocks: list[dict], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, smallest, largest values) of the blocks whose vectors have ``dim`` components."""
    own = [b for b in blocks if b["dim"] == dim]
    low = [np.frombuffer(b["lowest"], np.int64) for b in own]
    high = [np.frombuffer(b["highest"], np.int64) for b in own]
    shape = (len(own), dim)
    return np.array([b["at"] for b in own], np.int64), np.array(low, np.int64).reshape(shape), np.array(high, np.int64).reshape(shape)


def asked_of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(ids, vectors, kth scores so far) of a block of queries; kth scores only where a round went before."""
    names = np.frombuffer(block["ids"], np.int64)
    kth = block.get("kth")
    return names, matrix(block["terms"], block["dim"], len(names)), None if kth is None else np.frombuffer(kth, np.int64)


NO_SCORE = np.iinfo(np.int64).min


def search(query: dict, blocks: list[dict], k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The k best (query, vector, score) of each query among these blocks, and the kth scores by then.

    Rows below the kth score a query had before are left out.
    """
    dim = query["dim"]
    names, asked, kth = asked_of(query)
    floor = np.full(len(names), NO_SCORE) if kth is None else kth.copy()
    same = [b for b in blocks if b["dim"] == dim]
    _, low, high = summaries(same, dim)
    bounds = bounds_of(asked, low, high)
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores, ids = [np.zeros(0, np.int64)] * len(names), [np.zeros(0, np.int64)] * len(names)
    live = np.arange(len(names))
    for step in range(len(same)):
        # A query goes on while its next block may hold a score that reaches its kth.
        live = live[bounds[live, order[live, step]] >= floor[live]]
        for b in np.unique(order[live, step]):
            own = live[order[live, step] == b]
            there = np.frombuffer(same[b]["ids"], np.int64)
            every = inner(asked[own], matrix(same[b]["terms"], dim, len(there)))
            for i, row in zip(own, every, strict=True):
                fit = (there != names[i]) & (row >= floor[i])
                s, v = np.concatenate((scores[i], row[fit])), np.concatenate((ids[i], there[fit]))
                best = np.lexsort((v, -s))[:k]
                scores[i], ids[i] = s[best], v[best]
                if len(best) == k:
                    floor[i] = max(floor[i], scores[i][-1])
    found = [(int(n), int(v), int(x)) for n, s, d in zip(names, scores, ids, strict=True) for x, v in zip(s, d, strict=True)]
    return found, floor


def best_first(queries: pa.Table, blocks: pa.Table, n: int) -> list[tuple[int, int, int]]:
    """(block of queries, block, summed bound): the ``n`` blocks of highest bounds, summed over the queries."""
    out, tables = [], blocks.to_pylist()
    for q in queries.to_pylist():
        at, low, high = summaries(tables, q["dim"])
        total = bounds_of(asked_of(q)[1], low, high).astype(np.float64).sum(axis=0)
        out += [(q["turn"], int(at[b]), float(total[b])) for b in np.lexsort((at, -total))[:n]]
    return out


def still_open(queries: pa.Table, blocks: pa.Table, lane_blocks: int) -> list[tuple[int, int, int]]:
    """(block of queries, lane, block) where a bound still reaches some query's kth score, best bounds in the first lanes."""
    out, tables = [], blocks.to_pylist()
    for q in queries.to_pylist():
        at, low, high = summaries(tables, q["dim"])
        _, asked, kth = asked_of(q)
        bounds = bounds_of(asked, low, high)
        reach = (bounds >= kth[:, None]).any(axis=0) & ~np.isin(at, np.frombuffer(q["done"], np.int64))
        rest = np.flatnonzero(reach)
        rest = rest[np.lexsort((at[rest], -bounds[:, rest].max(axis=0, initial=NO_SCORE)))]
        out += [(q["turn"], place // lane_blocks, int(at[b])) for place, b in enumerate(rest)]
    return out


def rows_table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), cols, strict=True)})


def copied(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """A copy of a block for every row of ``wanted`` that names it.

    First one for every ``COPIES`` blocks of queries, dealt anew, so that a block that all
    queries want is not copied for all of them by one task.
    """
    wanted = wanted.withColumn("copy", F.floor(F.col("turn") / COPIES))
    few = blocks.join(wanted.select("at", "copy").distinct(), "at").repartition("at", "copy")
    return few.join(wanted, ["at", "copy"]).drop("copy")


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
    vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, lane_blocks: int = LANE_BLOCKS,
) -> DataFrame:
    """For every row that ``is_query`` names, the k rows of highest inner product.

    Components x become floor(``scale`` * x). Columns: query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id; all candidates where there are fewer than k.

    Vectors are cut into ranges of ids. Per query and block of ranges, the sum over terms
    of the query's value times the block's largest (or, below zero, smallest) value bounds
    every score in the block; blocks are scored in the order of that bound, until it falls
    below the kth score so far. Queries meet in blocks, in two rounds. The first sends a
    block of queries the ``lane_blocks`` blocks whose bounds are highest, summed over its queries,
    and gives every query a kth score. The second sends only blocks whose bound still
    reaches the kth score of some query there, ``lane_blocks`` to a task, and each query starts
    from that score. Bounds are taken from the blocks' extremes alone, without their vectors.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    Vectors are compared with those of their own length. A row is no candidate for a query
    of its own id; a query id that occurs more than once asks with the smallest of its
    vectors, while repeated candidates stay. Empty tables give no rows. Other columns
    are not read. Scores must fit 64 bits.
    """
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.filter(F.coalesce(usable, F.lit(False)))
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("terms"))
    asked = kept.filter(is_query).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("terms"))
    asked = asked.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    blocks = blocks_of(rows, block_rows, "blocks")
    queries = blocks_of(asked, block_rows // 2, "queries").withColumnRenamed("at", "turn").drop("lowest", "highest")
    # Numbers from 0 over tables with one row per block.
    parts = max(1, -(-blocks.count() // SUMMARY_BLOCKS))
    sets = max(1, -(-queries.count() // SUMMARY_QUERIES))
    extremes = blocks.select("dim", "at", "lowest", "highest", (F.col("at") % parts).cast("int").alias("part"))
    extremes = extremes.select("*", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))

    def over_extremes(asked: DataFrame, pick, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
        """What ``pick`` finds for blocks of queries in every part of the blocks' extremes."""

        def task(asked: pa.Table, there: pa.Table) -> pa.Table:
            return rows_table(pick(asked, there, lane_blocks) if asked.num_rows and there.num_rows else [], kinds)

        dealt = asked.select(
            "*", (F.col("turn") % sets).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        )
        return dealt.groupBy("set", "part").cogroup(extremes.groupBy("set", "part")).applyInArrow(task, schema)

    def first_round(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        for q in asked.to_pylist():
            found, kth = search(q, there.to_pylist(), k)
            rows = [dict(zip(("query_id", "vec_id", "score"), r, strict=True)) for r in found]
            out.append(q | {"kth": kth.tobytes(), "done": np.array(there["at"], np.int64).tobytes(), "found": rows})
        kinds = {"dim": pa.int32(), "ids": pa.binary(), "terms": pa.binary(), "turn": pa.int64(), "kth": pa.binary(), "done": pa.binary(), "found": pa.list_(FOUND)}
        return pa.table({n: pa.array([r[n] for r in out], kind) for n, kind in kinds.items()})

    def second_round(asked: pa.Table, there: pa.Table) -> pa.Table:
        blocks = there.to_pylist()
        rows = [r for q in asked.to_pylist() for r in search(q, blocks, k)[0]]
        return rows_table(rows, {f.name: f.type for f in FOUND})

    firsts = over_extremes(queries, best_first, {"turn": pa.int64(), "at": pa.int64(), "total": pa.float64()}, "turn long, at long, total double")
    nth = F.row_number().over(W.partitionBy("turn").orderBy(F.desc("total"), "at"))
    firsts = materialize(firsts.withColumn("nth", nth).filter(F.col("nth") <= lane_blocks).select("turn", "at"), "first-blocks")
    begun = queries.groupBy("turn").cogroup(copied(blocks, firsts).groupBy("turn")).applyInArrow(
        first_round, f"dim int, ids binary, terms binary, turn long, kth binary, done binary, found array<struct<{FOUND_SCHEMA.replace(' long', ':long')}>>"
    )
    begun = materialize(begun, "first-scores")
    queries = begun.drop("found")
    rest = over_extremes(queries, still_open, {n: pa.int64() for n in ("turn", "lane", "at")}, "turn long, lane long, at long")
    rest = materialize(rest.withColumn("part", F.col("at") % parts), "open-blocks")
    lane = ["turn", "part", "lane"]
    asked = queries.join(rest.select(*lane).distinct(), "turn")
    later = asked.groupBy(*lane).cogroup(copied(blocks, rest).groupBy(*lane)).applyInArrow(second_round, FOUND_SCHEMA)
    found = begun.select(F.inline("found")).unionByName(later)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
