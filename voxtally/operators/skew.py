"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy beyond a task's even share of the rows; its parts are so many to that share.
FINE = 8
#: Heavy keys are at most as many as tasks; the sketch follows so many times more.
TRACKED = 16


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(rows: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """(``_key``, ``_parts``): hashes of the keys that hold more than a task's even share of ``rows``.

    A frequent-items sketch, folded in each task, so that one small buffer a task is all
    that moves. At most ``tasks`` keys can hold such a share. A count is off by less than
    a share / ``TRACKED``, which only changes how finely a key is cut.
    """
    hashed = rows.select(F.xxhash64(*on).alias("_key"))
    tracked = min(1 << 20, max(1024, TRACKED * tasks))
    found = hashed.agg(
        F.expr(f"approx_top_k(_key, {min(tasks, tracked)}, {tracked})").alias("top"), F.count("*").alias("n")
    ).select(F.inline("top"), "n")
    share = F.col("n") / F.lit(float(tasks))
    heavy = found.where(F.col("count") > share)
    return heavy.select(F.col("item").alias("_key"), F.ceil(F.col("count") * FINE / share).cast("int").alias("_parts"))


def weighty_keys(keyed: DataFrame, on: list[str], weight: str, tasks: int) -> DataFrame:
    """The same from exact numbers of rows that ``keyed`` has in a column."""
    share = keyed.agg(F.sum(weight)).scalar() / F.lit(float(tasks))
    heavy = keyed.where(F.col(weight) > share)
    return heavy.select(F.xxhash64(*on).alias("_key"), F.ceil(F.col(weight) * FINE / share).cast("int").alias("_parts"))


def salted_join(
    big: DataFrame, keyed: DataFrame, on: list[str], how: str, spread: Column, weight: str | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Joins ``big`` to a narrow table, one row per key, with the heavy keys of ``big`` cut in parts.

    Adaptive execution cannot split a hot key when the other side is an aggregate on that
    very key, because such a side has no shuffle of its own; this does not depend on it.
    Heavy keys are found first, by ``weight`` (a column of ``keyed`` with about the number
    of rows of ``big`` a key has; it does not come out) or else by a sketch of the keys of
    ``sample`` (some rows of ``big``; all of them if none is given). A heavy key gets parts
    in proportion to its rows: its rows of ``big`` are dealt to them by the hash of
    ``spread``, a value that differs within a key, and its row of ``keyed`` is repeated
    for each. All other keys are joined plainly, and where no key is heavy no row is
    repeated. The table of heavy keys has fewer rows than there are tasks; that
    bound is why it may be broadcast. Catalyst broadcasts ``keyed`` too when its measured
    size allows.
    """
    tasks = _tasks(big)
    heavy = weighty_keys(keyed, on, weight, tasks) if weight else heavy_keys(big if sample is None else sample, on, tasks)
    rest = [c for c in keyed.columns if c != weight]
    right = _with_parts(keyed, on, heavy).select(*rest, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return cut_heavy(big, on, spread, heavy).join(right, [*on, "_part"], how).drop("_part")


def _with_parts(df: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    found = df.withColumn("_key", F.xxhash64(*on)).join(F.broadcast(heavy), "_key", "left")
    return found.withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_key")


def cut_heavy(rows: DataFrame, on: list[str], spread: Column, heavy: DataFrame | None = None) -> DataFrame:
    """Adds ``_part``: 0 for rows of light keys, some part of theirs for rows of heavy ones."""
    heavy = heavy_keys(rows, on, _tasks(rows)) if heavy is None else heavy
    # Never null, so no null check is pushed below it and shared shuffles stay equal.
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))
    return _with_parts(rows, on, heavy).select(*rows.columns, part.alias("_part"))
