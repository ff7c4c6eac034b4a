"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) from each node's neighbours to the smallest node among itself and them. A large star moves the larger
    neighbours of each node, a small star a node and its smaller neighbours. Minima come from a partial aggregation and an
    equi-join, so a hub's neighbours are never gathered."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """(node, root) for each node that has an edge in (u, v): root is the smallest node that it is connected with. Also
    the tables of the shared folder that the result reads. Loops and repeated edges do no harm; nulls are left out."""
    spark = edges.sparkSession
    now = edges.select("u", "v").na.drop().filter(F.col("u") != F.col("v"))
    at, seen = None, None
    for _ in range(most_rounds):
        table, new = materialize(_star(_star(now, True), False), "stars")
        if at:
            discard(spark, at)
        now, at = table, new
        # The edges are stars, each around its smallest node, once a round changes none of them.
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return nodes, [at]
