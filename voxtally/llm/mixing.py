"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtally.session import materialize

BITS = 52
#: A document with more copies is dealt to several tasks, so many copies each.
COPIES_PER_TASK = 1024
SMALL = 20


def unit(seed: str, *keys: Column) -> Column:
    """A whole number below 2**52 from the first 13 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def repetition_rates(sizes: DataFrame, weights: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """Mean number of copies of a document of each source: target share x total / rows of the source."""
    if weights is None:
        share = F.lit(1.0)
    else:
        known = F.from_json(F.lit("{}"), "map<string,double>") if not weights else F.create_map(
            *[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        )
        share = F.coalesce(known[F.col("_source")], F.lit(0.0))
    sums = sizes.select("*", share.alias("_share"))
    whole = sums.agg(F.sum("_share").alias("w"), F.sum("_n").alias("n")).first()
    rows = total if total is not None else (whole["n"] or 0)
    scale = F.lit(float(rows)) / F.lit(float(whole["w"] or 1.0))
    return sums.select("_source", (F.col("_share") * scale / F.col("_n")).alias("_rate"))


def log_factorial(k: Column) -> Column:
    """Logarithm of k!, by Stirling's series, of the small ones by their product."""
    x = k.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    product = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.lit(1.0), lambda p, i: p * i)
    return F.when(k <= SMALL, F.log(product)).otherwise(series)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``_source``, ``_first`` and ``_steps``: cumulative probabilities of ``_first`` copies, one more, and so on.

    They go from 12 standard deviations below the rate, before which there is less than
    2**-52, to as far beyond it. Each probability is a row and the sums run along the rows,
    so a rate of r takes work in proportion to its square root.
    """
    rate = F.col("_rate")
    spread = 12 * F.sqrt(rate)
    first = F.greatest(F.floor(rate - spread), F.lit(0)).cast("long")
    last = (F.ceil(rate + spread) + 29).cast("long")
    counts = rates.select("_source", "_rate", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_k"))
    k = F.col("_k")
    # Terms of like size are subtracted first, so that no digit is lost at high rates.
    high = k * F.log(rate / k) + (k - rate)
    log_mass = F.when(k <= SMALL, k * F.log(rate) - rate - log_factorial(k)).otherwise(high - (log_factorial(k) - (k * F.log(k) - k)))
    mass = F.when(rate <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(log_mass))
    along = W.partitionBy("_source").orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = counts.select("_source", "_first", "_k", F.sum(mass).over(along).alias("_sum"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_sum"))), lambda x: x["_sum"])
    return sums.groupBy("_source", "_first").agg(listed.alias("_steps"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights, in random order.

    ``weights`` maps sources to relative weights; without it all sources weigh the same.
    A source not named gets none. The result has about ``total`` rows, by default as many
    as ``docs``. A document of a source with rate r (target share x total / rows of the
    source) appears k times, k being the Poisson distribution of mean r inverted at
    a number the hash of seed and id gives: a rerun draws the same, and one document's count
    does not depend on any other. Adds copies (k), copy (0 to k - 1) and shuffle_key,
    a hash of id and copy; rows are dealt and sorted by it over all partitions.

    A null source is a source of its own, named by the empty string in ``weights``. Rows
    with equal or null ids draw alike. Null and empty texts are documents as any other.
    An empty table gives no rows. Columns of ``docs`` named as an added one are replaced.
    """
    docs = docs.drop("copies", "copy", "shuffle_key")
    # The row travels as one value, so that no name of its columns can clash with those made here.
    named = docs.select(
        F.struct(*docs.columns).alias("doc"), docs[id_col].alias("_id"), F.coalesce(docs[source_col], F.lit("")).alias("_source")
    )
    sizes = materialize(named.groupBy("_source").agg(F.count("*").alias("_n")), "sources")
    rates = repetition_rates(sizes, weights, total)
    steps = materialize(poisson_steps(rates), "rates")
    u = unit(str(seed), F.col("_id")) / F.lit(float(1 << BITS))

    def drawn(table: DataFrame) -> DataFrame:
        # The table of rates has a row per source; Catalyst broadcasts it by its size as written, and
        # beyond that adaptive execution splits a frequent source, as neither side is an aggregate.
        known = named.join(table, "_source")
        copies = F.col("_first") + F.size(F.filter("_steps", lambda c: c <= u))
        return known.select("doc", "_id", copies.cast("long").alias("copies")).filter("copies > 0")

    most = F.col("_first") + F.size("_steps")
    last = F.col("copies") - 1
    each = drawn(steps.filter(most <= COPIES_PER_TASK))
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    often = steps.filter(most > COPIES_PER_TASK)
    if not often.isEmpty():
        # The copies of one document, in pieces that several tasks make.
        piece = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES_PER_TASK).cast("long"))).alias("_from")
        pieces = drawn(often).select("doc", "_id", "copies", piece)
        dealt = pieces.repartition(F.xxhash64("_id", "_from"), "_from")
        end = F.least(F.col("_from") + (COPIES_PER_TASK - 1), last)
        copies = copies.unionByName(dealt.select("doc", "_id", "copies", F.explode(F.sequence("_from", end)).alias("copy")))
    keyed = copies.select("doc", "copies", "copy", unit(f"{seed}:", F.col("_id"), F.col("copy")).alias("shuffle_key"))
    dealt = keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("doc.*", "copies", "copy", "shuffle_key")
