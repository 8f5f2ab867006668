"""Sparse suffixes: passages that occur more than once, found from sampled suffixes.

A suffix is retained where the hash of its first ``seed`` words is the smallest of some
``length`` - ``seed`` + 1 consecutive ones (a minimiser). The choice depends on content
only, so equal passages of ``length`` words retain the same suffixes. The retained
suffixes are sorted by the hash of their first ``seed`` words and compared with their
neighbours. For those that agree, all passages of ``length`` words around them, which
begin up to ``length`` - ``seed`` words further left, are sorted by their hashes and
compared with their neighbours in turn. Every passage belongs to exactly one retained
suffix, so none is lost, and only suffixes that agreed are extended.

This departs from a suffix array proper, which orders suffixes by their words and extends
the matches of neighbours: neighbours in that order agree most to the right, and the one
that agrees to the left may be far off, so extending neighbours alone loses passages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.repeats import (
    GROUP_SIZE,
    SENT_SCHEMA,
    covered,
    flags_of,
    group_count,
    output_type,
    pack_chunks,
    read_flags,
    second_hash,
    send_rows,
    unpacked,
)
from voxtally.llm.substrings import intervals_of
from voxtally.llm.words import find_words, window_hashes, window_starts, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lowest_in(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive values, the leftmost on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    reach = 1
    while reach < width:  # spans double: the best of two overlapping halves
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        reach += step
    return best[:n]


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, seed: int = 20,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """Maximal spans of words made of passages of ``length`` words that start at least twice.

    One row per span: id, first_word, n_words (``length`` at least). A word lies in a
    span exactly if some ``length`` consecutive words of its text, this word among them,
    also start anywhere else, the same text included. Words are runs of bytes other than
    ASCII white space, unchanged.

    Null, empty and short texts have no span. Equal texts and repeated rows hold repeats
    of each other and give their spans each; null ids are kept. Columns other than the
    two named are not read. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    sampled = 2.0 / (length - seed + 2)

    def bound(texts: pa.Array) -> int:
        return int(window_starts(find_words(texts), length).size * sampled) + 1

    chunks = pack_chunks(rows, "text", bound)
    groups = group_count(chunks, group_size)
    wide = 2 * groups

    def suffixes(table: pa.Table):
        """Words, hashes, starts of all passages, the suffix of each, and the retained suffixes."""
        words = find_words(table["text"])
        hashes = word_hashes(words)
        starts = window_starts(words, length)
        seeds = window_hashes(hashes, seed)
        of = lowest_in(seeds, length - seed + 1)[starts]
        kept = np.unique(of)
        return words, hashes, starts, of, kept, seeds[kept]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["chunk"].to_pylist(), batch["packed"], strict=True):
                _, hashes, _, _, kept, prints = suffixes(unpacked(data.as_buffer()))
                yield send_rows(name, prints, second_hash(prints, hashes, kept, seed), groups)

    def extensions(table: pa.Table, flags: pa.Table):
        """Passages whose retained suffix agreed with a neighbour."""
        words, hashes, starts, of, kept, prints = suffixes(table)
        agreed = kept[read_flags(prints, second_hash(prints, hashes, kept, seed), groups, flags)]
        starts = starts[np.isin(of, agreed)]
        prints = window_hashes(hashes, length)[starts]
        return words, starts, prints, second_hash(prints, hashes, starts, length)

    def extend(chunk: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for name, data in zip(chunk["chunk"].to_pylist(), chunk["packed"], strict=True):
            _, _, prints, second = extensions(unpacked(data.as_buffer()), flags)
            out.append(pa.Table.from_batches([send_rows(name, prints, second, wide)]))
        return pa.concat_tables(out)

    def spans(chunk: pa.Table, flags: pa.Table) -> pa.Table:
        ids, first, n = [], [], []
        early = flags.filter(pc.equal(flags["step"], 1))
        late = flags.filter(pc.equal(flags["step"], 2))
        for data in chunk["packed"]:
            table = unpacked(data.as_buffer())
            words, starts, prints, second = extensions(table, early)
            found = covered(starts[read_flags(prints, second, wide, late)], length, len(words.start))
            names = table["id"].to_pylist()
            for i in np.unique(words.text_of()[found]):
                for x in intervals_of(found[words.first[i] : words.first[i + 1]]):
                    ids.append(names[i])
                    first.append(x["first"])
                    n.append(x["n"])
        kind = unpacked(chunk["packed"][0].as_buffer()).schema.field("id").type
        return pa.table({"id": pa.array(ids, kind), "first_word": pa.array(first, pa.int64()), "n_words": pa.array(n, pa.int64())})

    early = flags_of(chunks.mapInArrow(send, SENT_SCHEMA))
    by_chunk = chunks.groupBy("chunk")
    late = flags_of(by_chunk.cogroup(early.groupBy("chunk")).applyInArrow(extend, SENT_SCHEMA))
    both = early.withColumn("step", F.lit(1)).unionByName(late.withColumn("step", F.lit(2)))
    schema = f"id {output_type(docs, id_col)}, first_word long, n_words long"
    done = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(spans, schema)
    return done.withColumnRenamed("id", id_col)
