"""Prefix trie of conversations as a node table, with subtree sums over flat arrays.

A prefix of d turns is known by its digest: two 64-bit hashes of each turn and its place,
combined by exclusive or, so the digests of all prefixes of a conversation are a running
aggregate and the digest of the parent is one step back. Equal conversations are folded
first; an aggregate over the rest enumerates the distinct digests. Whole subtrees of
bounded size form shards. In a shard every digest gets a slot by a minimal perfect hash,
its counts lie in flat arrays, and sums run from the deepest nodes up through the array
of parent slots. The few nodes above the shards take the sums of the shards' roots.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtally.llm.words import mixed
from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block in running aggregates; ids of a piece in lists of ends; nodes of a subtree.
BLOCK, PIECE = 256, 1 << 14
FEWEST_NODES, MOST_NODES = 1 << 10, 1 << 20
NODE = ["depth", "p1", "p2"]


def running(rows: DataFrame, key: str, block: str, order: Sequence[Column], counts: Sequence[str], xors: Sequence[str]) -> DataFrame:
    """Running counts and exclusive ors along ``order`` within a key, replacing columns of that name.

    Within blocks first, then over the blocks of a key, so that a key that holds a
    large share of all rows is many blocks and not one task. Blocks follow the order.
    """
    inside = W.partitionBy(key, block).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = [F.count("*").cast("long").alias(f"_{c}") for c in counts] + [F.bit_xor(x).alias(f"_{x}") for x in xors]
    earlier = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(key, block).agg(*whole).select(
        key, block,
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in counts],
        *[F.coalesce(F.bit_xor(f"_{x}").over(earlier), F.lit(0)).alias(f"_{x}") for x in xors],
    )
    within = rows.withColumns({c: F.count("*").over(inside) for c in counts} | {x: F.bit_xor(x).over(inside) for x in xors})
    out = within.join(before, [key, block])
    out = out.withColumns({c: F.col(c) + F.col(f"_{c}") for c in counts} | {x: F.col(x).bitwiseXOR(F.col(f"_{x}")) for x in xors})
    return out.drop(block, *[f"_{x}" for x in (*counts, *xors)])


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns numbered from 1 in each conversation, their texts as two hashes and a length."""
    known = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"),
        *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(name) for x, name in ((role, "role"), (text, "text"))],
    )
    first = F.lit(-(1 << 62)).cast("long")
    rows = known.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), first))
    numbered = running(rows, "c", "block", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["d"], [])
    return numbered.select(
        "c", "d", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.md5(F.col("text").cast("binary")), "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def rebuilt(own: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation with the head of its family's first one, and its length.

    Conversation c takes the first h turns of c - c % ``family``, then its own after the
    first h; h is the CRC-32 of c, in decimal, modulo ``most`` + 1.
    """
    head = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    convs = own.groupBy("c").agg(F.max("d").alias("n")).select("c", "n", head.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    convs = materialize(convs, "conversations")
    convs = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.select("c", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "conversations")
    parts = ["t1", "t2", "bytes", "length"]
    # The first conversation of a family gives each member ``most`` turns at most.
    heads = own.filter(F.col("d") <= most).withColumnRenamed("c", "base").join(convs, "base").filter("d <= h").select("c", "d", *parts)
    tails = own.join(convs, "c").filter("d > h").select("c", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), *parts)
    return heads.unionByName(tails), convs.select("c", "length")


def digested(turns: DataFrame) -> DataFrame:
    """Digests p1, p2 of the prefix that ends in each turn, and q1, q2 of the prefix before it."""
    rows = turns.select(
        "c", "d", "bytes", "length", F.xxhash64("d", "t1").alias("p1"), F.xxhash64(F.lit("second"), "d", "t2").alias("p2"),
        F.floor(F.col("d") / BLOCK).alias("block"),
    )
    rows = rows.withColumns({"q1": F.col("p1"), "q2": F.col("p2")})
    out = running(rows, "c", "block", [F.col("d")], [], ["p1", "p2"])
    return out.withColumns({"q1": F.col("q1").bitwiseXOR(F.col("p1")), "q2": F.col("q2").bitwiseXOR(F.col("p2"))})


class Slots:
    """A minimal perfect hash of distinct 128-bit digests: level by level, digests alone in their cell get the next numbers."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.slot = np.full(len(a), -1, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = np.arange(len(a)), 0
        while len(left):
            size = 1 << int(2 * len(left) - 1).bit_length()
            cell = self.cells(a[left], b[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            if len(self.levels) == 64:
                raise ValueError("a digest occurs twice")
            number = used + np.cumsum(alone) - 1
            own = alone[cell]
            self.slot[left[own]] = number[cell[own]]
            self.levels.append((alone, number))
            used += int(alone.sum())
            left = left[~own]
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        self.a[self.slot], self.b[self.slot] = a, b

    @staticmethod
    def cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(a ^ mixed(b + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))) & np.uint64(size - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests, compared with the digest that holds the slot; -1 for those not here."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, number) in enumerate(self.levels):
            cell = self.cells(a[left], b[left], level, len(alone))
            hit = alone[cell]
            slot, at = number[cell[hit]], left[hit]
            same = (self.a[slot] == a[at]) & (self.b[slot] == b[at])
            out[at[same]] = slot[same]
            left = left[~hit]
        return out


SUMMED = ["n_children", "n_leaves", "saved"]
SHARD_SCHEMA = (
    "depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long"
)


def accumulate(nodes: pa.Table) -> pa.Table:
    """Sums over the subtrees of some nodes; ``n_children``, ``n_leaves`` and ``saved`` come with what hangs below from elsewhere."""

    def column(name: str) -> np.ndarray:
        return nodes[name].to_numpy()

    key = [column(c).view(np.uint64) for c in ("p1", "p2", "q1", "q2")]
    slots = Slots(key[0], key[1])
    n = len(slots.slot)
    depth, row, parent = (np.zeros(n, np.int64) for _ in range(3))
    depth[slots.slot], row[slots.slot] = column("depth"), np.arange(n)
    parent[slots.slot] = slots.find(key[2], key[3])
    parent[depth == 0] = -1
    inside = parent >= 0
    if (depth[parent[inside]] != depth[inside] - 1).any():
        raise ValueError("digests of different prefixes are equal")
    children, leaves, saved = (column(c)[row] for c in SUMMED)
    children = children + np.bincount(parent[inside], minlength=n)
    leaves = leaves + (children == 0)
    saved = saved.copy()
    deepest_first = np.argsort(-depth, kind="stable")
    for at in np.split(deepest_first, np.flatnonzero(np.diff(depth[deepest_first])) + 1):
        at = at[inside[at]]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    conv = column("conv_id")[row]
    above = pa.array(conv[np.maximum(parent, 0)], pa.int64(), mask=~inside)
    out = nodes.select(["depth", "p1", "p2", "q1", "q2", "conv_id", "n_convs"]).take(pa.array(row))
    sums = dict(zip(SUMMED, (children, leaves, saved), strict=True))
    return pa.table({**dict(zip(out.column_names, out.columns, strict=True)), "parent_conv_id": above, **sums}).select(
        [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in a node, ascending and joined by commas.

    Ids are put in order and joined in pieces of bounded size by many tasks; the pieces of
    one node then pass one task in their order, which holds a piece at a time.
    """
    ids = F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*NODE, F.floor(F.col("c") / PIECE).alias("piece")).agg(F.concat_ws(",", ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done():
            return pa.RecordBatch.from_pydict(
                {**{c: pa.array([x], pa.int64()) for c, x in zip(NODE, node, strict=True)}, "ends_sha256": [digest.hexdigest()]}
            )

        for batch in batches:
            found = []
            for *key, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")], strict=True):
                if key == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        found.append(done())
                    node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield from found
        if node is not None:
            yield done()

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def nodes_of(paths: DataFrame, *more: str) -> DataFrame:
    """The distinct prefixes with their members; a digest that stands for two prefixes is an error."""
    turn = F.struct("q1", "q2", "bytes")
    one = F.when(F.min(turn).eqNullSafe(F.max(turn)), F.min(turn)).otherwise(
        F.raise_error(F.lit("digests of different prefixes are equal")).cast("struct<q1:long,q2:long,bytes:long>")
    )
    nodes = paths.groupBy(*NODE, *more).agg(one.alias("turn"), F.min("c").alias("conv_id"), F.sum("copies").alias("n_convs"))
    return nodes.select(*NODE, *more, "turn.q1", "turn.q2", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("turn.bytes")).alias("saved"))


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", family: int = 5, most: int = 8, subtree: int | None = None,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty prefix among them.

    Conversation c is rebuilt from the first h turns of c - c % ``family`` (all if fewer,
    none if absent) and its own turns after the first h, h being the CRC-32 of c modulo
    ``most`` + 1. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, (members - 1) x bytes of the last
    text) and ends_sha256 (ids that end here, ascending, joined by commas).

    Turns go by ``turn_col``, nulls first, then by role and text. A null role or text is
    the empty string; an empty text is a turn. Rows without conversation id take no part;
    repeated rows are turns each. A conversation of any length is rows, never a list:
    numbers and digests run over blocks of turns. Other columns are not read. An empty
    table gives no rows. ``subtree`` bounds the nodes of a shard's subtree; results do not
    depend on it. The nodes above all subtrees, a share of 1 / ``subtree`` of all turns at
    each depth, are summed in one task.
    """
    own = materialize(turns_of(conversations, conv_col, turn_col, role_col, text_col), "turns")
    turns, convs = rebuilt(own, family, most)
    turns = materialize(digested(turns), "prefixes")
    none = F.lit(0).cast("long")
    bare = convs.filter("length = 0").select("c", none.alias("depth"), none.alias("p1"), none.alias("p2"))
    ends = turns.filter("d = length").select("c", F.col("d").alias("depth"), "p1", "p2").unionByName(bare)
    ends = materialize(ends, "ends")
    # Equal conversations are one from here on: copies are a count.
    single = ends.groupBy(*NODE).agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    single = materialize(single.select("c", F.col("depth").alias("length"), "copies"), "single")
    roots = single.select("c", "length", "copies", *[none.alias(x) for x in (*NODE, "q1", "q2", "bytes")])
    paths = turns.drop("length").withColumnRenamed("d", "depth").join(single, "c")
    paths = materialize(paths.unionByName(roots), "paths")
    total = paths.count()
    spread = 4 * int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = subtree or min(max(total // spread, FEWEST_NODES), MOST_NODES)

    # A subtree has at most as many nodes as its conversations have turns from there on.
    weight = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    tops = paths.groupBy(*NODE).agg(weight).filter((F.col("weight") > limit) | (F.col("depth") == 0)).select(*NODE)
    tops = materialize(tops, "tops")
    above = materialize(paths.join(tops, NODE, "left_semi"), "above")
    cuts = materialize(above.groupBy("c").agg(F.max("depth").alias("cut")), "cuts")
    units = paths.join(cuts, "c").filter("depth = cut + 1").select("c", "cut", F.col("p1").alias("unit"))
    below = paths.join(materialize(units, "units"), "c").filter("depth > cut")
    shards = max(1, -(-total // limit))
    rooted = (F.col("depth") == F.col("cut") + 1).alias("rooted")
    low = nodes_of(below.withColumn("rooted", rooted), "unit", "rooted").select(
        "*", none.alias("n_children"), none.alias("n_leaves"), F.pmod("unit", F.lit(shards)).alias("shard")
    )
    low = materialize(low.groupBy("shard").applyInArrow(accumulate, SHARD_SCHEMA), "shards")

    hung = low.filter("parent_conv_id IS NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("more")
    )
    heads = nodes_of(above).join(hung, NODE, "left").select(
        *NODE, "q1", "q2", "conv_id", "n_convs", (F.col("saved") + F.coalesce("more", none)).alias("saved"),
        *[F.coalesce(c, none).alias(c) for c in ("n_children", "n_leaves")],
    )
    heads = materialize(heads.groupBy(none).applyInArrow(accumulate, SHARD_SCHEMA), "heads")
    parent = heads.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("_above"))
    low = low.join(parent, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).drop("_above")
    out = low.unionByName(heads).join(end_hashes(ends), NODE, "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
