"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join, so a node with very
many neighbours is a skewed join key, which AQE splits, and never one task's whole input. The edge
table is written once per round; rounds grow with the logarithm of the longest path, and a table of
stars needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b; the result has the same form."""
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    low = sides.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = sides.join(low, F.col("a") == F.col("k"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        ).select("e.a", "e.b")
    return out.where(F.col("a") > F.col("b")).distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: every a has one edge and is no other edge's b."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; a component is named by its smallest node.

    Nodes may be of any orderable type. Self-links, repeated links and null ends are ignored
    (a node known only from a self-link is not returned). An empty table gives an empty result.
    """
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    e = durable(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    while not _finished(e):
        e = durable(_stars(_stars(e, large=True), large=False))
    # A finished table is a set of stars: every a points to the smallest node of its component.
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def merged_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components `parts` (node, component) after further links (a, b), which may name nodes that `parts` has not.

    Only the components that the links touch are solved again.
    """
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = connected_components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    new = over.select("node").join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    over = over.toDF("component", "into")
    return parts.union(new).join(over, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
