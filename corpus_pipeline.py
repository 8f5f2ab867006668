"""The corpus pipeline: language, near duplicates, benchmark leaks, source weights, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.llm.contamination import find_leaks
from voxtally.llm.language import learn_dictionaries, predict_language
from voxtally.llm.mixing import mix_sources
from voxtally.llm.near import near_duplicates
from voxtally.llm.sharding import shard_by_splitters
from voxtally.session import materialize

N_SHARDS = 40
SEED = 17


# A row by id and text. Null ids match each other; two columns stand for the null-safe comparison.
KEY = ["key_text", "key_id", "key_null"]


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_key(doc_id: str, text: Column) -> list[Column]:
    known = F.coalesce(F.col(doc_id), F.lit(0)).alias("key_id")
    return [text.alias("key_text"), known, F.col(doc_id).isNull().alias("key_null")]


def keyed(docs: DataFrame) -> DataFrame:
    """The row as one value beside its key, so that names of columns cannot clash."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *row_key("doc_id", text_key()))


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns renamed that bear one of ``names``, and the columns that give them their names back."""
    new = {}
    for c in docs.columns:
        if c.lower() in names:
            own = c + "_of_document"
            while own.lower() in {x.lower() for x in [*docs.columns, *new.values()]}:
                own += "_"
            new[c] = own
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells: texts without letters and narrow decisions go.

    The dictionaries are learned from the labelled documents at hand; a table without
    labels tells no language, so that all its documents go. Null and empty texts go; equal
    texts share their fate. Own columns named as those of the prediction are kept as they are.
    """
    docs, own = apart(docs, "lang_pred", "score", "accepted")
    return predict_language(docs, learn_dictionaries(docs)).filter("accepted").select(*own)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id.

    Rows that repeat both id and text are one document. Texts without words are no copies.
    """
    kept = near_duplicates(docs).filter("keep").select(*row_key("doc_id", F.col("text_key")))
    return keyed(docs).join(kept, KEY, "left_semi").dropDuplicates(KEY).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by id and text, also where ids are null."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select(F.struct(*row_key("doc_id", text_key())).alias("row"), "text")
    # Written, so that Catalyst knows the few leaks by size and need not move the texts.
    leaks = materialize(find_leaks(named, items, id_col="row").select("row.*").distinct(), "leaks")
    return keyed(docs).join(leaks, KEY, "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped by Poisson draws so that all sources weigh the same, in random order.

    A null source is that of the empty name. Rows of equal or null id in one source are drawn alike; null and
    empty texts are documents as any other. Own columns named as those of the draw are kept as they are.
    """
    docs, own = apart(docs, "copies", "copy", "shuffle_key")
    return mix_sources(docs, seed=SEED).select(*own)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they go to and their slot in it; shards have near equal sizes in bytes.

    Adds size, text_crc32, shard and slot, in place of own columns of these names. The order is that of
    text_crc32 and doc_id, nulls first; a null text counts as an empty one. Equal rows are interchangeable.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.drop("size", "text_crc32").select("*", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_by_splitters(sized, ["text_crc32", "doc_id"], "size", N_SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shards", shards),
]

# Compression, signatures and search are not SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again for the next.

    Documents with null or empty text, or null labels throughout, go in the first stage, so that an empty
    table, or one without labels, gives no rows. Extra columns are carried; see the stages for names that clash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
