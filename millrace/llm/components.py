"""Connected components by alternating large-star and small-star steps.

Each step is one grouped minimum and one join on the node, so a hub's neighbours are
never gathered in one place, and the edges stay linear in number. The edges are written
to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def _least_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_of(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges go from large to small."""
    joined = edges.join(_least_of(edges), "u")
    pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return joined.select(pair.alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node on an edge (u, v); the component is its least node.

    Edges may repeat, in either direction; loops and edges with a null end are dropped.
    """
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = written(tidy, "edges")
    seen = None
    for _ in range(most_rounds):
        mark = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or mark == seen:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = mark
        held = written(_small_star(_large_star(held).distinct()).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
