"""Line dedup: first occurrences along sorted ranges of line hashes. DataFrame functions only.

Every line sends a fixed-width row: two 64-bit hashes of its key, the document's id, a hash
that tells the row, and its position. Rows go to ranges of the first hash and are sorted
there by hash, document and position, so that all occurrences of a key lie one after
another and the first names the document that keeps it. What comes back to the documents
is one bitmap each, of the lines that stay; no text travels for the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtally.llm.sharding import range_of, sampled_splitters
from voxtally.session import materialize

#: Rows of a range; and a range with more than so many times the mean, and so many rows, is divided.
RANGE_ROWS, OVERFULL, FEWEST_ROWS = 1 << 16, 8, 256
#: Keys sampled, over all overfull ranges together, for the places to divide them.
SAMPLES = 4096
STRIPPED = " \t\n\x0b\x0c\r"
HASHES = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A to Z lower-cased and other letters as they are."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def row_hash(id_col: Column, text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(id_col, F.coalesce(text.cast("string"), F.lit("")))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: its hashes, document, row and position."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("_id"), row_hash(docs[id_col], text).alias("_row"), F.posexplode(lines_of(text)).alias("_pos", "_line"))
    keys = rows.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= min_chars)
    return keys.select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"), "_id", "_row", "_pos"
    )


def ranged(lines: DataFrame, range_rows: int, samples: int) -> tuple[DataFrame, DataFrame | None]:
    """Lines with the number of their range; those of ranges beyond their share apart, with ``_part``.

    Hashes are uniform, so equal steps of the first one make even ranges, but for keys
    that are frequent themselves. Ranges beyond their share are found by exact counts and
    divided at sampled (hash, document, position) keys, so that a hot key's occurrences
    lie in several consecutive parts.
    """
    total = lines.count()
    n = max(-(-total // range_rows), 32 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(n, 1 << 30)
    lines = lines.withColumn("_range", F.shiftright(F.shiftrightunsigned("_h1", 32) * F.lit(n).cast("long"), 32))
    limit = max(OVERFULL * total // n, FEWEST_ROWS)
    full = materialize(lines.groupBy("_range").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit), "overfull")
    crowded, ranges = full.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    if not ranges:
        return lines, None
    full = full.select("_range")
    hot = materialize(lines.join(full, "_range", "left_semi"), "hot-lines")
    keys = [*HASHES, "_none", "_id", "_row", "_pos"]
    hot = hot.withColumn("_none", F.col("_id").isNull())
    parts = min(samples // 2, 2 * (crowded // limit) + ranges)
    splitters, kind = sampled_splitters(hot, keys, F.lit(1), int(parts), samples)
    hot = hot.withColumn("_part", range_of(keys, splitters, kind)).drop("_none")
    return lines.join(full, "_range", "left_anti"), hot


def carried(hot: DataFrame) -> DataFrame:
    """For each part of a divided range: its first hashes, and the first document of that key in any part.

    A key that goes over several parts is the first or the last of each of them, so the
    edges of the parts, one row each, hold all that is needed.
    """
    doc = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")).alias("doc")
    back = [F.bitwise_not(h).alias(h) for h in HASHES]
    edges = hot.groupBy("_range", "_part").agg(
        F.min(F.struct(*HASHES, doc)).alias("low"), F.min(F.struct(*back, doc)).alias("high")
    )
    edges = materialize(edges, "edges")
    low = edges.select("low.*")
    high = edges.select("high.*").select(*back, "doc")
    starts = low.unionByName(high).groupBy(*HASHES).agg(F.min("doc").alias("doc"))
    first = edges.select("_range", "_part", "low._h1", "low._h2").join(starts, HASHES)
    out = first.select("_range", "_part", F.struct(*HASHES).alias("_edge"), F.struct("doc.id").alias("_start"))
    return materialize(out, "carried")


def repeats_of(lines: DataFrame, range_rows: int, samples: int) -> DataFrame:
    """Lines whose key occurs in a document of smaller id: ``_id``, ``_row`` and ``_pos``."""
    rows, hot = ranged(lines, range_rows, samples)
    key = F.struct(*HASHES)
    kinds = rows.select(key.alias("k"), F.struct(F.col("_id").alias("id")).alias("d")).schema
    rows = rows.select(
        "*", F.lit(0).alias("_part"), F.lit(None).cast(kinds["k"].dataType).alias("_edge"),
        F.lit(None).cast(kinds["d"].dataType).alias("_start"),
    )
    if hot is not None:
        # A row for each part of a divided range: Catalyst broadcasts it by its size as written.
        rows = rows.unionByName(hot.join(carried(hot), ["_range", "_part"]))
    along = W.partitionBy("_range", "_part").orderBy(*HASHES, F.col("_id").asc_nulls_last(), "_row", "_pos")
    begins = ~F.lag(key).over(along).eqNullSafe(key)
    first = F.when(key.eqNullSafe(F.col("_edge")), F.col("_start")).otherwise(F.struct(F.col("_id").alias("id")))
    rows = rows.withColumn("_head", F.when(begins, first))
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    keeper = F.last("_head", ignorenulls=True).over(so_far)
    return rows.withColumn("_keeper", keeper).filter(~F.col("_keeper.id").eqNullSafe(F.col("_id"))).select("_id", "_row", "_pos")


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
    range_rows: int = RANGE_ROWS, samples: int = SAMPLES,
) -> DataFrame:
    """Which lines of a document stay when a line is kept in one document only.

    A line's key is the line without ASCII white space at its ends, with A to Z in lower
    case. Keys of at least ``min_chars`` code points that occur in several documents stay
    in the one of smallest id and go from all others, wherever they stand there.

    One row per document that loses lines: the id, row_hash, n_dropped, and ``keep``, a
    bitmap of its lines in words of 64 bits, lowest bit first; words whose lines all stay
    are left out. Documents not listed keep all lines.

    Rows of one id are one document, told apart by row_hash; so repeated rows keep or lose
    the same lines. Null ids are one document, after all others. Null and empty texts have
    one empty line. A very long text is as many rows as it has lines. Other columns are
    not read. An empty table gives no rows.
    """
    lines = materialize(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    gone = repeats_of(lines, range_rows, samples)
    words = gone.groupBy("_id", "_row", F.expr("_pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_gone")
    )
    kept = F.struct("word", F.bitwise_not("_gone").alias("bits"))
    maps = words.groupBy("_id", "_row").agg(
        F.sum(F.bit_count("_gone")).alias("n_dropped"), F.sort_array(F.collect_list(kept)).alias("keep")
    )
    return maps.select(F.col("_id").alias(id_col), F.col("_row").alias("row_hash"), "n_dropped", "keep")


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bits are set in a bitmap of ``line_bitmaps``."""
    none = F.lit(-1).cast("long")

    def word(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(none, x["word"] - before - 1), F.array(x["bits"]))

    full = F.flatten(F.transform(keep, word))

    def chosen(words: Column) -> Column:
        return F.filter(lines, lambda x, i: F.getbit(F.coalesce(F.get(words, F.floor(i / 64).cast("int")), none), i % 64) == 1)

    # As the one item of an array, so that the bitmap is spread once and not for every line.
    return F.element_at(F.transform(F.array(full), chosen), 1)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
    range_rows: int = RANGE_ROWS, samples: int = SAMPLES,
) -> DataFrame:
    """The documents with the bitmaps of ``line_bitmaps`` applied: adds n_lines, n_dropped and kept_text.

    Row for row the table given, repeated rows included; n_lines counts before dropping.
    Columns of ``docs`` named as an added one are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    maps = line_bitmaps(docs, id_col, text_col, min_chars, range_rows, samples).select(
        F.col(id_col).alias("_id"), "row_hash", "n_dropped", "keep"
    )
    # The row travels as one value, so that no name of its columns can clash with those made here.
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), docs[id_col].alias("_doc"), row_hash(docs[id_col], docs[text_col]).alias("_row")
    )
    both = rows.join(maps, rows["_doc"].eqNullSafe(maps["_id"]) & (rows["_row"] == maps["row_hash"]), "left")
    text = F.col("doc")[text_col]
    lines, whole = lines_of(text), F.coalesce(text.cast("string"), F.lit(""))
    kept = F.when(F.col("keep").isNull(), whole).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    done = both.select(
        "doc", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
    return done.select("doc.*", "n_lines", "n_dropped", "kept_text")
