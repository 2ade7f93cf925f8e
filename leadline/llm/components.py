"""Connected components by alternating stars, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.skew import narrow_join, parts
from leadline.session import materialise


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of links, and whether some node has two upward links or lies inside a path."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"),
                                         F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(
        F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return found[0] or 0, bool(found[1])


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the smallest node.

    Every round ties the larger neighbours of a node to the smallest one, then the smaller
    ones; rounds end when every node has one link, to a node that has none. Each round is a
    stored table. ``rows`` is about the number of links, where the caller knows it; it sets
    the number of tasks that write the first table.
    """
    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges if rows is None else edges.coalesce(parts(rows)))
    n, open_ends = _state(edges)
    while open_ends:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(narrow_join(both, _smallest(both), "a", 2 * n).where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
            .coalesce(parts(n)))
        least = _smallest(large)
        small = narrow_join(large, least, "a", n).where("b != m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b")))
                            .where("a != b").distinct().coalesce(parts(n)))
        n, open_ends = _state(edges)
    # each node has one edge now, to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
