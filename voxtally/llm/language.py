"""Language by compression: the dictionary that encodes a text shortest names its language."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 96
DICTIONARY_BYTES = 1 << 16
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Signs and digits say nothing about the language; each becomes a blank.
PLAIN = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
LEVEL = 6
#: A dictionary helps near the start of a code only, so longer texts are encoded piece by piece.
PIECE_BYTES = 1 << 16


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(PLAIN).split())


def code_length(coder: zstandard.ZstdCompressor, data: bytes) -> int:
    """Length of the whole text's code: of consecutive pieces, each encoded with a fresh use of the dictionary."""
    view = memoryview(data)
    return sum(len(coder.compress(view[at : at + PIECE_BYTES])) for at in range(0, len(data), PIECE_BYTES))


def learn_dictionaries(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Raw content of one dictionary per language, from a bounded sample of labelled rows.

    Of every language at most ``sample_rows`` rows count, those with the lowest hash of
    their id, texts that fit a sixteenth of a dictionary first; at most ``dictionary_bytes``
    bytes of each text and of each dictionary. Rows without label, text or letter do not
    count; equal texts count once.
    """
    usable = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    text = F.col(text_col)
    turn = W.partitionBy("lang").orderBy("long", "turn")
    rows = (
        usable.select(
            F.col(label_col).alias("lang"),
            (F.octet_length(text) > dictionary_bytes // 16).alias("long"),
            F.xxhash64(F.lit("language"), F.col(id_col)).alias("turn"),
            F.substring(text, 1, dictionary_bytes).alias("text"),
        )
        .withColumn("place", F.row_number().over(turn))
        .filter(F.col("place") <= sample_rows)
        .select("lang", "text", "place")
        .collect()
    )
    out: dict[str, bytes] = {}
    for lang in sorted({r.lang for r in rows}):
        texts = dict.fromkeys(plain(r.text) for r in sorted(rows, key=lambda r: r.place) if r.lang == lang)
        out[lang] = b"\n".join(texts)[:dictionary_bytes]
    return out


def predict_language(
    docs: DataFrame, dictionaries: Mapping[str, bytes], text_col: str = "text", margin: float = 0.002,
) -> DataFrame:
    """Adds lang_pred, score and accepted.

    Every whole text is encoded once per language with zstandard and that language's
    dictionary, in pieces of ``PIECE_BYTES`` that each start from the dictionary, so that what
    it saves grows with the text; lang_pred is the language of the shortest code (the first by name on
    ties). score is that language's share of 2 ** -(code length in half bytes), so it is
    1 / n for n languages in a tie and near 1 where one is clearly shortest. accepted is
    false where the shortest code saves less than ``margin`` of the next one's
    length, and where there is no guess.

    A null text and one without letters get ``und`` and score 0, as does every text when
    there is no dictionary. Repeated rows are judged alike; an empty table gives no rows.
    Columns of ``docs`` named as an added one are replaced; others are kept.
    """
    names = sorted(dictionaries)
    contents = [bytes(dictionaries[n]) for n in names]
    docs = docs.drop("lang_pred", "score", "accepted")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for content in contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
        for batch in batches:
            preds, scores, accepted = [], [], []
            for value in batch.column(batch.schema.get_field_index(text_col)):
                text = value.as_py()
                if not names or text is None or not LETTER.search(text):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    accepted.append(False)
                    continue
                data = plain(text)
                sizes = np.array([code_length(c, data) for c in coders])
                best = int(sizes.argmin())
                ranked = np.sort(sizes)
                preds.append(names[best])
                scores.append(float(1 / np.exp2(np.maximum(-2.0 * (sizes - ranked[0]), -1000.0)).sum()))
                accepted.append(len(names) == 1 or bool(ranked[1] - ranked[0] > margin * ranked[1]))
            added = {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64()), "accepted": pa.array(accepted, pa.bool_())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema
    return docs.mapInArrow(judge, schema)


def crc_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
