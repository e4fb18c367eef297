"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id that occurs in ``edges`` (a, b).

    Each round keeps no more edges than the one before and roughly halves the
    depth, so a handful of rounds suffice; the last one changes no edge. Nothing
    is collected but counts.
    Self loops and repeated edges are allowed; an empty table gives no rows.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(stars, "cc")
    changed = not stars.isEmpty()
    while changed:
        before, stars = stars, materialize(_small_star(_large_star(stars)), "cc")
        changed = before.count() != stars.count() or not stars.join(before, ["u", "v"], "left_anti").isEmpty()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("label")).union(stars.select("v", "v").distinct())
