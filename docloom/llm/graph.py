"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage, unstage


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for each node of links (columns a and b, long); component is its smallest node.

    Alternates large-star and small-star steps, in which every node passes its
    smallest neighbour on to the others, until the links no longer change. Each
    step only takes a minimum by key and joins it back, so that a node with very
    many links is combined before the shuffle. Each round is written to the
    shared folder. Loops and repeated links are allowed; null ends are ignored.
    """
    spark = links.sparkSession
    edges, path = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a point to the smallest of a's neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a and its smaller neighbours point to the smallest of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new, new_path = stage(small, "links")
        unstage(spark, path)
        edges, path = new, new_path
        after = mark(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Every node now has one link, to the smallest node of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
