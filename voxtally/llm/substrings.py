"""Substring dedup by Rabin-Karp hashes of every window of words."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from voxtally.llm.repeats import (
    SENT_SCHEMA,
    GROUP_SIZE,
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
from voxtally.llm.words import find_words, window_hashes, window_starts, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
    group_size: int = GROUP_SIZE, with_text: bool = True,
) -> DataFrame:
    """Removes every word covered by a window that starts at least twice in the corpus.

    Words are maximal runs of bytes other than space and \\x09 to \\x0D. One row per row
    of ``docs``: id, n_words, n_removed, intervals (maximal runs of removed words, as
    first and number), kept_sha256 (of the kept words joined by one space) and, with
    ``with_text``, kept_text. Windows are judged on the input alone.

    A null or empty text has no words. Rows with equal text, and rows repeated whole,
    count as occurrences of each other; so do two windows of one text, also where they
    overlap. Null ids are kept. Columns other than the two named are not read. An empty
    table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    chunks = pack_chunks(rows, "text", lambda texts: int(window_starts(find_words(texts), window).size))
    groups = group_count(chunks, group_size)

    def windows(table: pa.Table):
        words = find_words(table["text"])
        hashes = word_hashes(words)
        starts = window_starts(words, window)
        prints = window_hashes(hashes, window)[starts]
        return words, starts, prints, second_hash(prints, hashes, starts, window)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["chunk"].to_pylist(), batch["packed"], strict=True):
                _, _, prints, second = windows(unpacked(data.as_buffer()))
                yield send_rows(name, prints, second, groups)

    def finish(chunk: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for data in chunk["packed"]:
            table = unpacked(data.as_buffer())
            words, starts, prints, second = windows(table)
            gone = covered(starts[read_flags(prints, second, groups, flags)], window, len(words.start))
            out.append(kept_rows(table, words, gone, with_text))
        return pa.concat_tables(out)

    id_type = output_type(docs, id_col)
    schema = "id " + id_type + ", n_words long, n_removed long, intervals array<struct<first:long,n:long>>, kept_sha256 string"
    schema += ", kept_text string" if with_text else ""
    flags = flags_of(chunks.mapInArrow(send, SENT_SCHEMA))
    done = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(finish, schema)
    return done.withColumnRenamed("id", id_col)


def intervals_of(gone: np.ndarray) -> list[dict]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    return [{"first": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def kept_rows(table: pa.Table, words, gone: np.ndarray, with_text: bool) -> pa.Table:
    out = {"id": table["id"], "n_words": words.counts(), "n_removed": [], "intervals": [], "kept_sha256": []}
    kept_texts = []
    for i, text in enumerate(table["text"]):
        own = gone[words.first[i] : words.first[i + 1]]
        tokens = text.as_buffer().to_pybytes().split() if text.is_valid else []
        n = int(own.sum())
        kept = b" ".join(compress(tokens, (~own).tolist()) if n else tokens)
        out["n_removed"].append(n)
        out["intervals"].append(intervals_of(own) if n else [])
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if with_text:
            kept_texts.append(kept.decode())
    out["n_words"] = pa.array(out["n_words"], pa.int64())
    out["n_removed"] = pa.array(out["n_removed"], pa.int64())
    spans = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
    out["intervals"] = pa.array(out["intervals"], spans)
    return pa.table(out | ({"kept_text": kept_texts} if with_text else {}))
