"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtally.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge, the smallest node it is connected to.

    Every round each node that has a smaller neighbour goes to the smallest one; their chains are followed to the
    end by halving. Then edges stand between the ends alone, which are at most half as many nodes: an edge inside
    a component found so far is not read again. Rounds are written to the shared folder; only whether anything is
    left reaches the driver.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    pairs = materialize(edges.select(low.alias("low"), high.alias("high")).distinct(), "edges")
    roots = pairs.select(F.col("low").alias("root")).union(pairs.select("high")).distinct().select(F.col("root").alias("node"), "root")
    pairs = pairs.filter("low < high")
    while True:
        ends = _ends(pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("end")))
        roots = materialize(_followed(roots, "root", ends), "roots")
        moved = _followed(_followed(pairs, "low", ends), "high", ends).filter("low <> high")
        pairs = materialize(moved.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "edges")
        if pairs.isEmpty():
            return roots


def _followed(rows: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """``rows`` with the node of ``column`` replaced by its end, if it has one."""
    known = ends.select(F.col("node").alias(column), "end")
    return rows.join(known, column, "left").withColumn(column, F.coalesce("end", column)).drop("end")


def _ends(steps: DataFrame) -> DataFrame:
    """(node, end): where the steps from each node end. A step goes to a smaller node, so that there are no rings."""
    steps = materialize(steps, "steps")
    while True:
        further = steps.select(F.col("node").alias("end"), F.col("end").alias("next"))
        if steps.join(further, "end", "left_semi").isEmpty():
            return steps
        far = steps.join(further, "end", "left").select("node", F.coalesce("next", "end").alias("end"))
        steps = materialize(far, "steps")
