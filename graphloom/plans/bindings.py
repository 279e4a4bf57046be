"""The provided tables as the engine's facts: graphs, files, references, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import table

GRAPH = """e0 AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
e AS (SELECT DISTINCT e0.a AS src, e0.b AS dst FROM e0 JOIN part p ON p.p_partkey = e0.a JOIN part q ON q.p_partkey = e0.b WHERE p.p_brand = q.p_brand)"""


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, if of one brand: (src, dst)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # A part's brands come along before parts meet: of the pairs, only those of one brand are made distinct, and no table is broadcast.
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_set("p_brand").alias("brands"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.join(brands.hint("shuffle_hash"), "l_partkey", "left").withColumns({"dst": F.lead("l_partkey").over(w), "others": F.lead("brands").over(w)})
    return pairs.where(F.arrays_overlap("brands", "others")).select(F.col("l_partkey").alias("src"), "dst").distinct()


def entry_parts(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_size") <= most).select("p_partkey")
