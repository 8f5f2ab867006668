"""Shards of near equal size, by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtally.session import materialize

SAMPLES = 4096
#: A range of more than so many times its fair share of rows or bytes is divided further.
OVERFULL, FEWEST_ROWS = 8, 64


def sampled_splitters(
    docs: DataFrame, keys: Sequence[str], size: Column, n_ranges: int, samples: int
) -> tuple[list[list[str]], str]:
    """About ``n_ranges`` - 1 keys at equal steps of sampled size, and their type.

    A row is drawn with a probability in proportion to its size, decided by a hash of
    its keys, so a rerun draws the same. At most some multiple of ``samples`` keys, in
    expectation ``samples``, reach the driver, whatever the size of the table.
    """
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    chance = F.pmod(F.xxhash64(F.lit("splitters"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.filter(chance * F.lit(float(total)) < size.cast("double") * F.lit(float(samples)))
    key = F.struct(*keys)
    kind = drawn.select(key.alias("k")).schema["k"].dataType.simpleString()
    ranked = [r[0] for r in drawn.groupBy(key.alias("k")).count().sort("k").select(F.to_json("k")).collect()]
    step = max(1.0, len(ranked) / n_ranges)
    picks = [ranked[int(i * step)] for i in range(1, n_ranges) if int(i * step) < len(ranked)]
    return list(dict.fromkeys(picks)), kind


def range_of(keys: Sequence[str], splitters: list[str], kind: str, fan: int = 64) -> Column:
    """Number of splitters at or below a row's key, found in two steps."""

    def literal(items: list[str]) -> Column:
        return F.from_json(F.lit(f"[{','.join(items)}]"), f"array<{kind}>")

    def at_or_below(items: Column) -> Column:
        return F.size(F.filter(items, lambda s: s <= F.struct(*keys)))

    if not splitters:
        return F.lit(0)
    tops = splitters[::fan]
    parts = [splitters[i : i + fan] for i in range(0, len(splitters), fan)]
    nested = F.from_json(F.lit("[" + ",".join(f"[{','.join(p)}]" for p in parts) + "]"), f"array<array<{kind}>>")
    top = at_or_below(literal(tops))
    within = at_or_below(F.element_at(nested, F.greatest(top, F.lit(1))))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * fan + within)


def overfull(sums: DataFrame, n_ranges: int) -> list[int]:
    """Ranges far beyond their share, by their exact sums; a range of one row cannot be divided."""
    whole = sums.agg(F.coalesce(F.sum("_sum"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    rows = max(OVERFULL * whole[1] / n_ranges, FEWEST_ROWS)
    wide = (F.col("_sum") > F.lit(OVERFULL * float(whole[0]) / n_ranges)) & (F.col("_n") > 1)
    return sorted(r[0] for r in sums.filter((F.col("_n") > F.lit(float(rows))) | (wide & (F.col("_n") >= FEWEST_ROWS))).select("_range").collect())


def divided(ranged: DataFrame, ranges: list[int], keys: Sequence[str], n_ranges: int, samples: int) -> DataFrame:
    """Adds ``_part`` within a range, and a stored number of the row, by which rows equal in all columns are told apart."""
    if not ranges:
        return ranged.select("*", F.lit(0).cast("long").alias("_row_id"), F.lit(0).alias("_part"))
    inside = F.col("_range").isin(ranges)
    # Written, so that the number of a row is the same for all that read it.
    hot = materialize(ranged.filter(inside).select("*", F.monotonically_increasing_id().alias("_row_id")), "overfull")
    longer = [*keys, "_spread", "_row_id"]
    splitters, kind = sampled_splitters(hot, longer, F.col("_size") + 1, n_ranges, samples)
    cold = ranged.filter(~inside).select("*", F.lit(0).cast("long").alias("_row_id"), F.lit(0).alias("_part"))
    return cold.unionByName(hot.select("*", range_of(longer, splitters, kind).alias("_part")))


def shard_by_splitters(
    docs: DataFrame, keys: Sequence[str], size_col: str, n_shards: int, samples: int = SAMPLES
) -> DataFrame:
    """Adds ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Shards are consecutive ranges of the order by ``keys``; the size of each differs from
    total / ``n_shards`` by less than the largest row. Size-weighted samples give splitters
    of many more ranges than shards. A splitter holds all keys: where a frequent first key
    overfills a range, the sample has as many of its rows as its weight asks for, and they
    subdivide it by the further keys. The exact size of every range is then summed, so
    each range knows where it begins, and rows are placed by running sums within their
    range. Ranges that are still overfull, as rows equal in all keys overfill one, are
    written with a number for each row and divided by that in the same way. A window holds
    one range or part, and their table has a bounded number of rows.

    Rows equal in all keys are ordered by a hash of the whole row; rows equal in all
    columns are interchangeable.
    Nulls in keys sort first; a null size counts as 0, and a row of size 0 takes a slot as
    any other. An empty table gives no rows. Columns named ``shard`` or ``slot`` in
    ``docs`` are replaced, others are kept.
    """
    docs = docs.drop("shard", "slot")
    spread = F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    # The row travels as one value, so that no name of its columns can clash with those made here.
    docs = docs.select(
        F.struct(*docs.columns).alias("doc"), F.coalesce(docs[size_col], F.lit(0)).cast("long").alias("_size"),
        spread.alias("_spread"), *[docs[k].alias(f"_key{i}") for i, k in enumerate(keys)],
    )
    keys, size = [f"_key{i}" for i in range(len(keys))], F.col("_size")
    n_ranges = min(n_shards * 32, samples // 2)
    splitters, kind = sampled_splitters(docs, keys, size, n_ranges, samples)
    ranged = docs.select("*", range_of(keys, splitters, kind).alias("_range"))
    measured = [F.sum("_size").alias("_sum"), F.count("*").alias("_n")]
    sums = materialize(ranged.groupBy("_range").agg(*measured), "ranges")
    ranges = overfull(sums, n_ranges)
    ranged = divided(ranged, ranges, keys, n_ranges, samples)
    if ranges:
        sums = materialize(ranged.groupBy("_range", "_part").agg(*measured), "ranges")
    else:
        sums = sums.withColumn("_part", F.lit(0))
    before = W.orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    begins = materialize(
        sums.select(
            "_range", "_part",
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row_from"),
            F.sum("_sum").over(W.partitionBy()).alias("_total"),
        ),
        "ranges",
    )
    within = W.partitionBy("_range", "_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys], "_spread", "_row_id")
    ahead = F.sum("_size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    placed = ranged.join(begins, ["_range", "_part"]).select(
        "doc",
        (F.col("_row_from") + F.row_number().over(within) - 1).alias("_row"),
        (F.col("_from") + ahead).cast("decimal(28,0)").alias("_at"),
        F.greatest("_total", F.lit(1)).alias("_total"),
    )
    # A row of size 0 at the very end would begin beyond the last shard.
    shard = F.least(F.expr(f"(_at * {n_shards}) div _total"), F.lit(n_shards - 1)).cast("int")
    placed = placed.select("doc", "_row", shard.alias("shard"))
    firsts = materialize(placed.groupBy("shard").agg(F.min("_row").alias("_first")), "shards")
    slot = (F.col("_row") - F.col("_first")).cast("long")
    return placed.join(firsts, "shard").select("doc.*", "shard", slot.alias("slot"))
