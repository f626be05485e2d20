"""Connected components of an undirected graph, as smallest reachable node, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def _fold(edges: DataFrame, everyone: bool) -> tuple[DataFrame, list[Cut]]:
    """One star step over links (hi, lo), hi > lo.

    everyone=True looks at all neighbours of a node and moves its larger ones to the smallest
    (large star); False looks at the smaller neighbours only and moves them and the node (small star).
    The smallest neighbours are written out before they are joined, so both sides of the join are
    exchanged anew and a hot centre can be split.
    """
    sides = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    if everyone:
        sides = sides.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
    least = Cut(sides.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m")))
    joined = sides.join(least.df, "node")
    if everyone:
        moved = joined.where("near > node").select(F.col("near").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = joined.where("near <> m").select(F.col("near").alias("hi"), F.col("m").alias("lo"))
        moved = moved.unionByName(least.df.where("node <> m").select(F.col("node").alias("hi"), F.col("m").alias("lo")))
    return moved.where("hi <> lo").distinct(), [least]


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and no smaller neighbour has one itself."""
    sides = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    sides = sides.unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0


def smallest_reachable(links: DataFrame) -> Cut:
    """links(a, b) -> Cut of (node, root) for every node with a link, root = smallest reachable node.

    Alternating large-star and small-star steps, each linear in the number of links; rounds grow with
    the logarithm of the longest chain. They end when all links form stars, whose centres are the roots.
    Every step is written to the shared folder, so no lineage grows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = Cut(pairs.distinct())
    while not _is_stars(now.df):
        for everyone in (True, False):
            df, extra = _fold(now.df, everyone)
            after = Cut(df)
            for old in (*extra, now):
                old.drop()
            now = after
    roots = now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out = Cut(roots.unionByName(now.df.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
    now.drop()
    return out
