"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtally.llm.words import Words, find_words, is_letter_byte, slices, window_hashes, word_hashes
from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
GRAM = 3
SHORT_ITEM = 8
SLICE_BYTES = 2 << 20
#: Room for rounding in bounds; sums for passages and blocks made at a time.
SLACK, CELLS = 1e-6, 1 << 22
#: A term in more than one of so many blocks has its maxima as a row over all blocks beside its list.
COMMON = 8
#: An index is sent to every task; beyond these sizes items are dealt over several indexes.
INDEX_ITEMS, INDEX_BYTES = 20_000, 8 << 20


def term_table() -> np.ndarray:
    """Bytes of terms: letters and digits."""
    table = is_letter_byte()
    table[48:58] = True
    return table


def terms_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Terms of texts in lower case, and their hashes."""
    words = find_words(pc.utf8_lower(texts), term_table())
    return words, word_hashes(words)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line answers; of a single one, the second half of the words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    tokens = text.split()
    half = -(-len(tokens) // 2)
    return " ".join(tokens[:half]), " ".join(tokens[half:])


def grams(hashes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Distinct hashes of ``width`` consecutive words, of single words in a text of under twice as many; and the width."""
    width = min(width if len(hashes) >= 2 * width else 1, len(hashes))
    return (np.unique(window_hashes(hashes, width)) if width else np.zeros(0, np.uint64)), width


@dataclass
class Index:
    """Inverted index of items in blocks; weights are BM25 impacts over the item's own score, so a whole item scores 1."""

    names: list
    terms: np.ndarray  # sorted hashes
    highest: np.ndarray  # per term, over all items of the index
    first: np.ndarray  # per term, where its postings begin, and the end of the last
    postings: np.ndarray  # per term, the blocks that hold it, ascending
    block_highest: np.ndarray  # per posting, the largest weight of the term in the block
    common: np.ndarray  # per term, its row in ``common_highest``, or -1
    common_highest: np.ndarray  # the same maxima of common terms, by block
    blocks: list[tuple[np.ndarray, np.ndarray]]  # per block: its terms, and weights by term and item
    parts: list[tuple]  # per item: (grams, width) of question and of answer, number of words
    reach: int  # words of the longest item of the benchmark


@dataclass
class Benchmark:
    """What scores take from the whole benchmark, whichever items share an index."""

    df: dict[int, int]
    items: int = 0
    words: int = 0
    reach: int = 0


def hashed_items(items: list[tuple[object, str, str]]) -> Iterator[tuple]:
    """Name, and hashes of the words of question, answer and both; items without a word are left out."""
    for name, question, answer in items:
        q, a = (terms_of(pa.array([text]))[1] for text in (question, answer))
        if len(q) + len(a):
            yield name, q, a, np.concatenate((q, a))


def measure(rows: list[tuple]) -> Benchmark:
    """The statistics of a benchmark that consists of these hashed items."""
    df = Counter(t for r in rows for t in set(r[3].tolist()))
    sizes = [len(r[3]) for r in rows]
    return Benchmark(df, len(rows), sum(sizes), max(sizes, default=0))


def build_index(items: list[tuple[object, str, str]], gram: int = GRAM) -> Index | None:
    """Index of a whole benchmark of (name, question, answer) triples; items without a word are left out."""
    rows = list(hashed_items(items))
    return index_rows(rows, measure(rows), gram) if rows else None


def index_rows(rows: list[tuple], bench: Benchmark, gram: int) -> Index:
    """Index of some hashed items of a benchmark."""
    df, mean = bench.df, bench.words / bench.items
    bags = [Counter(r[3].tolist()) for r in rows]
    terms = np.array(sorted({t for bag in bags for t in bag}), np.uint64)
    at = {t: i for i, t in enumerate(terms.tolist())}
    weights = []
    for bag, row in zip(bags, rows, strict=True):
        norm = K1 * (1 - B + B * len(row[3]) / mean)
        own = {at[t]: np.log1p((bench.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in bag.items()}
        whole = sum(own.values())
        weights.append({t: w / whole for t, w in own.items()})
    n_blocks = -(-len(rows) // BLOCK_ITEMS)
    highest = np.zeros(len(terms), np.float32)
    most_of, blocks = [], []
    for b in range(n_blocks):
        part = weights[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS]
        used = np.array(sorted({t for w in part for t in w}))
        matrix = np.array([[w.get(t, 0.0) for w in part] for t in used], np.float32)
        most = np.nextafter(matrix.max(axis=1), np.float32(2))
        highest[used] = np.maximum(highest[used], most)
        most_of.append(most)
        blocks.append((used, matrix))
    term = np.concatenate([used for used, _ in blocks])
    block = np.repeat(np.arange(n_blocks), [len(used) for used, _ in blocks])
    order = np.lexsort((block, term))
    term, block, most = term[order], block[order], np.concatenate(most_of)[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    often = np.diff(first) * COMMON > n_blocks
    common = np.where(often, np.cumsum(often) - 1, -1)
    common_highest = np.zeros((int(often.sum()), n_blocks), np.float32)
    own = often[term]
    common_highest[common[term[own]], block[own]] = most[own]
    return Index(
        [r[0] for r in rows], terms, highest, first, block, most, common, common_highest, blocks,
        [(grams(r[1], gram), grams(r[2], gram), len(r[3])) for r in rows], bench.reach,
    )


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places low to high of each range, one after another, and the range each belongs to."""
    n = high - low
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n), own


def reached_blocks(index: Index, passage: np.ndarray, term: np.ndarray, total: int, score_at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(passages, blocks) whose bound reaches the threshold, from the distinct (passage, term) pairs in their order.

    A passage's terms are put in the order of their largest weights. The pivot is where
    their running sum reaches the threshold: an item without any term from the pivot on cannot
    reach it, so only the posting lists of those terms name blocks. Of a block named, the
    maxima in that very block are then summed over all terms of the passage.
    """
    none = np.zeros(0, np.int64)
    live = np.bincount(passage, index.highest[term], total)[passage] + SLACK >= score_at_least
    passage, term = passage[live], term[live]
    if not len(passage):
        return none, none
    order = np.lexsort((index.highest[term], passage))
    ranked, weight = passage[order], index.highest[term[order]].astype(np.float64)
    running = np.cumsum(weight)
    begins = np.flatnonzero(np.diff(ranked, prepend=-1))
    base = np.repeat(running[begins] - weight[begins], np.diff(np.append(begins, len(ranked))))
    beyond = order[running - base + SLACK >= score_at_least]
    n_blocks = len(index.blocks)

    def postings(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, own = ranges(index.first[term[pairs]], index.first[term[pairs] + 1])
        return passage[pairs[own]] * n_blocks + index.postings[at], at

    named = np.unique(postings(beyond)[0])
    of, block = np.divmod(named, n_blocks)
    row = index.common[term]
    keys, at = postings(np.flatnonzero(row < 0))
    place = np.minimum(np.searchsorted(named, keys), len(named) - 1)
    hit = named[place] == keys
    bound = np.zeros(len(named)) + np.bincount(place[hit], index.block_highest[at[hit]], len(named))
    passage, row = passage[row >= 0], row[row >= 0]
    asked = np.unique(of)
    low, high = np.searchsorted(passage, asked), np.searchsorted(passage, asked, "right")
    step = max(1, CELLS // (n_blocks * int((high - low).max(initial=1)) or 1))
    for a in range(0, len(asked), step):  # a bounded number of sums at a time
        at, own = ranges(low[a : a + step], high[a : a + step])
        sums = np.zeros((len(asked[a : a + step]), n_blocks), np.float64)
        if len(at):
            begins = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[begins]] = np.add.reduceat(index.common_highest[row[at]], begins, axis=0, dtype=np.float64)
        mine = slice(*np.searchsorted(of, [asked[a], asked[min(a + step, len(asked)) - 1] + 1]))
        bound[mine] += sums[np.searchsorted(asked[a : a + step], of[mine]), block[mine]]
    fit = bound + SLACK >= score_at_least
    return of[fit], block[fit]


def leaks(index: Index, words: Words, hashes: np.ndarray, score_at_least: float, overlap: float, short_item: int = SHORT_ITEM):
    """(text, item, first word, words, score, question overlap, answer overlap) of every verified passage.

    A passage is two neighbouring segments of as many words as the longest item has, so
    every item that a text holds lies in one passage.
    """
    counts = words.counts()
    segments = -(-counts // index.reach)
    segment_of_text = np.concatenate(([0], np.cumsum(segments)))
    text = words.text_of()
    segment = segment_of_text[text] + (np.arange(len(hashes)) - words.first[text]) // index.reach
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[place] == hashes
    # Each term counts once in a segment.
    pairs = np.unique(segment[known] * len(index.terms) + place[known])
    of, term = np.divmod(pairs, len(index.terms))
    total = int(segment_of_text[-1])
    bounds = np.searchsorted(of, np.arange(total + 1))
    last = np.zeros(total, bool)
    last[segment_of_text[1:][segments > 0] - 1] = True

    # A term of a segment is one of the passage that begins there, and of the one before in the same text.
    before = (of > 0) & ~last[of - 1]
    pairs = np.unique(np.concatenate((pairs, pairs[before] - len(index.terms))))
    own_passage, own_term = np.divmod(pairs, len(index.terms))
    segment_text = np.repeat(np.arange(len(counts)), segments)
    there: dict[tuple[int, int], np.ndarray] = {}
    for s, b in zip(*reached_blocks(index, own_passage, own_term, total, score_at_least), strict=True):
        used, matrix = index.blocks[b]
        ends = s + 1 if last[s] else s + 2
        own = np.unique(term[bounds[s] : bounds[ends]])
        rows = np.minimum(np.searchsorted(used, own), len(used) - 1)
        scores = matrix[rows[used[rows] == own]].sum(axis=0, dtype=np.float64)
        fit = np.flatnonzero(scores >= score_at_least)
        if not len(fit):
            continue
        t = int(segment_text[s])
        first = int(words.first[t] + (s - segment_of_text[t]) * index.reach)
        size = int(min(2 * index.reach, words.first[t + 1] - first))
        for i in fit + b * BLOCK_ITEMS:
            question, answer, n = index.parts[i]
            need = overlap if n >= short_item else 1.0
            found = []
            for part, width in (question, answer):
                if width and (s, width) not in there:
                    there = {k: v for k, v in there.items() if k[0] == s}  # those of one passage at a time
                    there[s, width] = np.unique(window_hashes(hashes[first : first + size], width))
                found.append(float(np.isin(part, there[s, width]).mean()) if width else 1.0)
            if min(found) >= need:
                yield t, int(i), first - int(words.first[t]), size, float(scores[i - b * BLOCK_ITEMS]), *found


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", answer_col: str | None = None, score_at_least: float = 0.6, overlap: float = 0.6,
    gram: int = GRAM, short_item: int = SHORT_ITEM,
) -> DataFrame:
    """Documents that hold a test item: one row per document row and item.

    Columns: id, item id, first_word and n_words of the passage, score (share of the item's
    own BM25 score), question_overlap and answer_overlap. All passages of all texts are
    asked; every item that reaches ``score_at_least`` is retrieved, and kept if ``overlap`` of
    the grams of ``gram`` words of its question and of its answer occur in the passage (single
    words for parts of under twice as many). A few words of a short item turn up anywhere,
    so of one of under ``short_item`` words all must occur; 0 makes no such difference. Without
    ``answer_col`` the last sentence of an item is its answer. Words are runs of letters
    and digits in lower case. Of several passages the one with the largest
    overlaps counts, then the first.

    Null and empty texts hold nothing; items without a word are left out; equal items,
    null ids and repeated rows are reported each. Empty tables give no rows. Columns of
    ``docs`` other than the two named are not read, so their names cannot clash.
    Items are counted and indexed in tasks. One index takes at most ``INDEX_ITEMS`` items
    and about ``INDEX_BYTES`` bytes of text; the driver holds one at a time, and each is a pass
    over the documents. Scores and passages do not depend on which items share an index.
    """
    limits = (score_at_least, overlap, short_item)
    rows = benchmark_rows(items, item_col, item_text_col, answer_col)
    totals = rows.agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("reach"), F.sum("size").alias("bytes")).first()
    if not totals["items"]:
        return search(docs, None, items, id_col, text_col, item_col, limits)
    n_parts = min(totals["items"], max(-(-totals["items"] // INDEX_ITEMS), -(-totals["bytes"] // INDEX_BYTES)))
    bench = Benchmark({}, totals["items"], totals["words"], totals["reach"])
    indexes = benchmark_indexes(rows, bench, n_parts, gram)
    out = []
    for part in range(n_parts):
        index = Index(**pickle.loads(indexes.filter(F.col("part") == part).first()["index"]))
        found = search(docs, index, items, id_col, text_col, item_col, limits)
        # Written where another follows, so that no plan holds two indexes.
        out.append(found if n_parts == 1 else materialize(found, "leaks-of-part"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def benchmark_rows(items: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """Hashed words of every item that has any, written once and numbered from 0 in ``at``."""
    columns = [items[item_col].alias("item"), items[text_col].alias("text")]
    columns += [F.coalesce(items[answer_col], F.lit("")).alias("answer")] if answer_col else []
    given = items.select(*columns).filter("text is not null")
    kind = given.schema["item"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            pairs = zip(texts, batch["answer"].to_pylist(), strict=True) if answer_col else map(split_item, texts)
            triples = [(i, *pair) for i, pair in enumerate(pairs)]
            rows = list(hashed_items(triples))
            sizes = [len(triples[r[0]][1].encode()) + len(triples[r[0]][2].encode()) for r in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "item": batch["item"].take(pa.array([r[0] for r in rows], pa.int64())),
                    "question": pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    "answer": pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    "terms": pa.array([np.unique(r[3]).view(np.int64) for r in rows], pa.list_(pa.int64())),
                    "n": pa.array([len(r[3]) for r in rows], pa.int64()),
                    "size": pa.array(sizes, pa.int64()),
                    "task": pa.array([here] * len(rows), pa.int32()),
                    "place": pa.array(range(place, place + len(rows)), pa.int64()),
                }
            )
            place += len(rows)

    schema = f"item {kind}, question binary, answer binary, terms array<bigint>, n long, size long, task int, place long"
    rows = materialize(given.mapInArrow(hashed, schema), "benchmark")
    # One row per task of the step above.
    counts = rows.groupBy("task").agg(F.count("*").alias("own"))
    before = counts.select("task", (F.sum("own").over(W.orderBy("task")) - F.col("own")).alias("before"))
    return rows.join(before, "task").withColumn("at", F.col("before") + F.col("place"))


def benchmark_indexes(rows: DataFrame, bench: Benchmark, n_parts: int, gram: int) -> DataFrame:
    """(part, index): one index for every ``n_parts``-th item, with the document frequencies of the whole benchmark."""
    rows = rows.withColumn("part", F.pmod("at", F.lit(n_parts)).cast("int"))
    terms = rows.select(F.col("part").alias("of_part"), F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    wanted = terms.distinct().join(df, "term")

    def build(items: pa.Table, df: pa.Table) -> pa.Table:
        items = items.sort_by("at")
        names, parts = items["item"].to_pylist(), items.select(["question", "answer"]).to_pylist()
        hashed = [(np.frombuffer(p["question"], np.uint64), np.frombuffer(p["answer"], np.uint64)) for p in parts]
        keys = df["term"].to_numpy().astype(np.int64).view(np.uint64).tolist()
        own = Benchmark(dict(zip(keys, df["df"].to_pylist(), strict=True)), bench.items, bench.words, bench.reach)
        index = index_rows([(n, q, a, np.concatenate((q, a))) for n, (q, a) in zip(names, hashed, strict=True)], own, gram)
        return pa.table({"part": items["part"].slice(0, 1), "index": pa.array([pickle.dumps(vars(index))], pa.binary())})

    made = rows.select("part", "at", "item", "question", "answer").groupBy("part").cogroup(wanted.groupBy("of_part"))
    return materialize(made.applyInArrow(build, "part int, index binary"), "benchmark-index")


def search(docs, index, items, id_col, text_col, item_col, limits) -> DataFrame:
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = (
        f"id {id_type.simpleString()}, item {item_type.simpleString()}, first_word long, n_words long, "
        "score double, question_overlap double, answer_overlap double"
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES) if index else ():
                words, hashes = terms_of(part["text"])
                best: dict[tuple[int, int], tuple] = {}
                for t, i, *found in leaks(index, words, hashes, *limits):
                    old = best.get((t, i))
                    if old is None or min(found[3:]) > min(old[3:]):
                        best[t, i] = tuple(found)
                if not best:
                    continue
                keys, rows = list(best), list(zip(*best.values(), strict=True))
                ids = part["id"].take(pa.array([t for t, _ in keys]))
                names = [index.names[i] for _, i in keys]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names), *(pa.array(c) for c in rows)],
                    names=["id", "item", "first_word", "n_words", "score", "question_overlap", "answer_overlap"],
                )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(ask, schema).withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)
