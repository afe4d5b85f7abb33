"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termindex.session import settled


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of (a, b); ``comp`` is the smallest node of its component.

    In a round every component moves to its smallest neighbour, chains of moves
    are followed two steps, and links inside a component go. It ends when no link
    is left; nothing but counts comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges = settled(both, "edges")
    labels = settled(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), "labels")
    while not edges.isEmpty():
        moves = settled(edges.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"), "moves")
        for _ in range(2):
            onward = moves.select(F.col("a").alias("to"), F.col("to").alias("further"))
            moves = settled(moves.join(onward, "to", "left").select(
                "a", F.coalesce("further", "to").alias("to")), "moves")
        ahead = moves.select(F.col("a").alias("comp"), "to")
        labels = settled(labels.join(ahead, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        one = edges.join(moves, "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        other = moves.select(F.col("a").alias("b"), "to")
        edges = settled(one.join(other, "b", "left").select("a", F.coalesce("to", "b").alias("b"))
                        .filter("a <> b").distinct(), "edges")
    return labels
