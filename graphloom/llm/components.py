"""Connected components of an edge table, by alternating stars.

Each round, every node's larger neighbours are tied to its smallest neighbour
(large star), then its smaller ones (small star); the edges end as one star a
component. Edges stay a table throughout, each round is written down, and a node
with very many neighbours is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise, release, salted_left_join


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each u's smallest neighbour or u itself, beside its edges (u, v); and the table of the former."""
    least = materialise(edges.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return salted_left_join(edges, least, "u", "n", ["v"]), least


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) of every node with an edge to another."""
    e = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tied, least = _least(both)
        large = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        release(e, least)
        tied, least = _least(large)
        small = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        small = materialise(small, "small")
        release(large, least)
        # A fixpoint: every node has one edge, and what it leads to has none.
        tips = small.groupBy("u").count().where("count > 1").limit(1)
        chain = small.alias("x").join(small.select(F.col("u").alias("w")).alias("y"), F.col("x.v") == F.col("y.w"), "left_semi").limit(1)
        if tips.isEmpty() and chain.isEmpty():
            break
        e = small
    roots = small.select(F.col("v").alias("node")).distinct()
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
