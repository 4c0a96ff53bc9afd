"""Connected components of links between nodes, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import compact, materialized


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """A row (node, root) for each node of links (a, b); root is the least node of its component.

    Each round hangs every larger neighbour of a node on the least one it can see (large star), then every node and its
    smaller neighbours on the least of those (small star), till nothing changes. Both sides of a step are a join with one
    row for each node, so Spark can split a node with very many links. Links never grow in number. Each round ends in a
    checkpoint. Repeated links, loops and either direction are fine; a link with a null end is none. No links give no rows.
    """
    edges = materialized(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    edges, seen = compact(edges, 16), _sum(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialized(small.where("u <> v").distinct())
        edges, before, seen = compact(after, 16), seen, _sum(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    """What tells sets of different rows apart: their count and a sum of hashes in decimals."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
