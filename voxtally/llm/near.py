"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard similarity."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.components import connected_components
from voxtally.llm.words import find_words, mixed, slices, window_hashes, word_hashes
from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, DEEPEST = 20, 6
SLICE_BYTES = 2 << 20
#: Texts below one node of a trie that are compared in one place; more go there in pairs of blocks.
GROUP_ROWS = 1024
#: Shingles of a block of a component. One of many texts is cut finer, so that several tasks share it.
BLOCK_SHINGLES, FINE_SHINGLES, FINE_TEXTS, FINE_BLOCKS = 400_000, 16_000, 32, 16
SIGNED_SCHEMA = "id long, text_key long, digest binary, n long, signature binary"


def shortest_prefix(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """How far prefixes are shortened: the longest one at which pairs of ``similarity`` meet
    in some tree with probability ``recall``."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of one text; all its words make one if there are fewer than ``size``."""
    return np.unique(window_hashes(hashes, min(size, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def lowest_hashes(shingles: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """MinHash signatures, one row per text: the low 16 bits of the smallest 32-bit hashes."""
    seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, count), dtype=np.uint64) | np.uint64(1)
    filled = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, count), 0xFFFF, np.uint16)
    if len(filled):
        for k in range(count):
            values = ((shingles * seeds[0, k] + seeds[1, k]) >> np.uint64(16)).astype(np.uint32)
            out[filled, k] = np.minimum.reduceat(values, bounds[:-1][filled]) & np.uint32(0xFFFF)
    return out


def walk_trie(rows: np.ndarray, tree: int, depth: int, deepest: int, least_equal: float) -> np.ndarray:
    """Roots of the texts of one subtree of a sorted prefix trie.

    ``rows`` are whole signatures of texts that share the first ``depth`` values of
    ``tree``. From the deepest prefixes up, texts below the same node that do not belong
    together yet are compared by all their values, and joined if the share of equal ones
    reaches ``least_equal``: longer prefixes settle most, shorter ones add what is left.
    """
    own = rows[:, tree * deepest : (tree + 1) * deepest]
    order = np.lexsort(own.T[::-1])
    n = len(rows)
    root = np.arange(n)
    for level in range(deepest, depth - 1, -1):
        head = own[order, :level]
        cut = np.flatnonzero(np.any(head[1:] != head[:-1], axis=1)) + 1
        for run in np.split(order, cut):
            if len(run) < 2 or (root[run] == root[run[0]]).all():
                continue
            for i, x in enumerate(run[:-1]):
                rest = run[i + 1 :]
                rest = rest[root[rest] != root[x]]
                if len(rest):
                    close = rest[(rows[rest] == rows[x]).mean(axis=1) >= least_equal]
                    for r in np.unique(root[close]):
                        low, high = sorted((root[x], r))
                        root[root == high] = low
    return root


def agreeing(left: np.ndarray, right: np.ndarray, least_equal: float) -> np.ndarray:
    """Roots of the texts of two blocks of one node, ``left`` first, after comparing each pair across by its signatures."""
    n = len(left)
    root = np.arange(n + len(right))
    for x in range(n):
        rest = np.flatnonzero(root[n:] != root[x])
        close = rest[(right[rest] == left[x]).mean(axis=1) >= least_equal]
        for r in np.unique(root[n + close]):
            low, high = sorted((root[x], r))
            root[root == high] = low
    return root


def lowest_of(names: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each text the smallest name below its root, so that most trees and blocks tell the same edges of a large group."""
    lowest = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, names)
    return lowest[root]


def linked(left: list[np.ndarray], right: list[np.ndarray], same: bool, similarity: float):
    """For each i on the left, the j on the right of exact Jaccard similarity of at least ``similarity``.

    Only j > i if both sides are the same.
    """
    sizes = np.array([len(x) for x in right])
    ids, inverse = np.unique(np.concatenate(right), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for i, own in enumerate(left):
        at = np.searchsorted(ids, own)
        at[at == len(ids)] = 0
        marked = np.zeros(len(ids), np.int32)
        marked[at[ids[at] == own]] = 1
        common = np.add.reduceat(marked[inverse], bounds)
        close = np.flatnonzero(common >= similarity * (len(own) + sizes - common) - 1e-9)
        close = close[close > i] if same else close
        if len(close):
            yield i, close


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys, across the bounds of batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        begin = 0
        for i in range(len(values) + 1):
            if i == len(values):
                held.append(batch.slice(begin))
            elif values[i] != current:
                if current is not None and (held or i > begin):
                    yield current, pa.Table.from_batches([*held, batch.slice(begin, i - begin)])
                held, begin, current = [], i, values[i]
    if held:
        yield current, pa.Table.from_batches(held)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8,
    recall: float = 0.9999, trees: int = TREES, deepest: int = DEEPEST,
) -> DataFrame:
    """Classes of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more.

    One row per row of ``docs``: id, text_key (xxhash64 of the text), class_id (the smallest
    id in the class, connected by links), n_links (other rows it is linked to) and keep
    (true for one row of each class: smallest id, then smallest text_key; rows repeated whole
    share id and key). Words are runs of bytes other than ASCII white space.

    Texts with equal shingle sets are folded first; their links are counted by their
    number. Each remaining text gets ``trees`` sequences of ``deepest`` MinHash values, the
    sorted sequences of a tree being a prefix trie. Prefixes start at ``deepest`` values and
    are shortened to where a pair at the threshold shares one in some tree with probability
    ``recall``. Texts below one node are candidates if their whole signatures agree enough
    (five standard deviations below the threshold). Candidates only make components; in each, all
    pairs are compared by their exact shingle sets, in pairs of bounded blocks of texts, so
    no link inside a component is lost and no pair of a group is a row of its own.

    A null text or one without words has no shingles: it is alone, with no links. A text
    of fewer words than ``size`` has one shingle. Ids must be whole numbers; a null id counts
    as larger than any, and class_id is null where no id is known. An empty table gives
    no rows. Other columns are not read.
    """
    depth = shortest_prefix(similarity, recall, trees, deepest)
    values = trees * deepest
    least_equal = similarity - 5 * (similarity * (1 - similarity) / values) ** 0.5

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = find_words(part["text"])
                hashes = word_hashes(words)
                sets = [shingles_of(hashes[a:b], size) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                signature = lowest_hashes(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds, values)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part["id"],
                        "text_key": part["text_key"],
                        "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "signature": pa.array([x.tobytes() for x in signature], pa.binary()),
                    }
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.col(text_col).cast("string").alias("text"),
    )
    signed = materialize(rows.mapInArrow(sign, SIGNED_SCHEMA), "signed")
    # Copies fold before anything else; each remaining set of shingles is a node.
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key")
    folded = signed.filter("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(first).alias("first"), F.max("n").alias("n"), F.max("signature").alias("signature")
    )
    nodes = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = connected_components(candidates(nodes, trees, depth, deepest, least_equal))
    near = near.join(nodes.select("node", "copies", "first", "n"), "node")
    found = materialize(exact_links(near, rows, size, similarity), "links")
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        nodes.select("node", "digest", "copies", "first").join(classes, "node", "left").join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = materialize(named, "named")
    heads = materialize(named.groupBy("root").agg(F.min("first").alias("head")), "heads")
    others = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    whole = materialize(named.join(heads, "root").select("digest", "head", others.alias("n_links")), "classes")
    head_id = F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id"))
    keep = F.col("head").isNull() | (F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.text_key") == F.col("text_key")))
    out = signed.select("id", "text_key", "digest").join(whole, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), "text_key", head_id.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), keep.alias("keep"),
    )


def candidates(nodes: DataFrame, trees: int, depth: int, deepest: int, least_equal: float) -> DataFrame:
    """Edges that connect nodes which share a prefix of some tree and agree in enough values.

    Only prefixes that several nodes share get signatures. Texts below a node of the trie
    are dealt to blocks of ``GROUP_ROWS``, one for most nodes, and every two blocks meet in
    one place, where each pair of texts is compared by all values.
    """
    prefix = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.xxhash64(F.substring(F.col("signature"), t * (2 * deepest) + 1, F.lit(2 * depth))).alias("prefix")
        ),
    )
    keyed = nodes.select("node", F.inline(prefix))
    shared = materialize(
        keyed.groupBy("tree", "prefix").agg(F.count("*").alias("members"), F.min("node").alias("lowest")).filter("members > 1"),
        "prefixes",
    )
    members = materialize(keyed.join(shared, ["tree", "prefix"]), "members")
    blocks = F.ceil(F.col("members") / GROUP_ROWS).cast("int")
    placed = members.select("tree", "prefix", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    signed = meeting(placed.join(nodes.select("node", "signature"), "node"))
    keys = ["tree", "prefix", "one", "two"]
    dealt = signed.repartition(*keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, one, two), group in runs(batches, keys):
            names, block = group["node"].to_numpy(), group["block"].to_numpy()
            rows = np.stack([np.frombuffer(x, np.uint16) for x in group["signature"].to_pylist()])
            if one == two:
                root = walk_trie(rows, tree, depth, deepest, least_equal)
            else:
                order = np.argsort(block, kind="stable")
                names, rows, n = names[order], rows[order], int((block == one).sum())
                root = agreeing(rows[:n], rows[n:], least_equal)
            lowest = lowest_of(names, root)
            joined_ = np.flatnonzero(names != lowest)
            if len(joined_):
                yield pa.RecordBatch.from_pydict({"a": names[joined_], "b": lowest[joined_]})

    return dealt.mapInArrow(walk, "a long, b long").distinct()


def meeting(placed: DataFrame) -> DataFrame:
    """Rows with a ``block`` of ``blocks`` for every pair of blocks, ``one`` and ``two``, theirs is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_with")
    both = placed.select("*", other)
    return both.select("*", F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("two")).drop("_with", "blocks")


def exact_links(near: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Per node and pair of blocks: the rows its linked nodes stand for, and one node it is connected to.

    ``near`` has the nodes of every component (root). A component's texts are dealt to
    blocks of about ``BLOCK_SHINGLES`` shingles, and every two blocks meet in one place.
    A component of many texts has up to ``FINE_BLOCKS`` blocks also where it is smaller.
    """
    size_of, texts_of = F.sum("n"), F.count("*")
    fine = F.least(F.ceil(size_of / FINE_SHINGLES), F.floor(texts_of / FINE_TEXTS), F.lit(FINE_BLOCKS))
    blocks = F.greatest(F.ceil(size_of / BLOCK_SHINGLES), fine, F.lit(1)).cast("int")
    sums = materialize(near.groupBy("root").agg(blocks.alias("blocks")), "components")
    wanted = near.select("node", "root", "copies", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"))
    texts = rows.withColumn("known", F.coalesce("id", F.lit(0))).withColumn("unknown", F.col("id").isNull())
    wanted = wanted.withColumn("known", F.coalesce("id", F.lit(0))).withColumn("unknown", F.col("id").isNull()).drop("id")
    keys = ["known", "unknown", "text_key"]
    found = texts.select(*keys, "text").join(wanted, keys).dropDuplicates(keys)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = meeting(found.join(sums, "root").select("root", "node", "copies", "text", block.alias("block"), "blocks"))
    dealt = dealt.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, two), group in runs(batches, ["root", "one", "two"]):
            words = find_words(group["text"])
            hashes = word_hashes(words)
            sets = [shingles_of(hashes[a:b], size) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            block, names, copies = (group[c].to_numpy() for c in ("block", "node", "copies"))
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            if not len(left) or not len(right):
                continue
            links, root = np.zeros(len(names), np.int64), np.arange(len(names))
            for i, close in linked([sets[x] for x in left], [sets[x] for x in right], one == two, similarity):
                x, ys = left[i], right[close]
                links[x] += copies[ys].sum()
                links[ys] += copies[x]
                apart = np.unique(root[ys])
                apart = apart[apart != root[x]]
                if len(apart):
                    apart = np.append(apart, root[x])
                    root[np.isin(root, apart)] = apart.min()
            told = np.flatnonzero(links)
            if len(told):
                yield pa.RecordBatch.from_pydict({"node": names[told], "other": lowest_of(names, root)[told], "links": links[told]})

    return dealt.mapInArrow(compare, "node long, other long, links long")
