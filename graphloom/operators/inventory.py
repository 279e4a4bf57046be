"""Pattern inventories over texts: flags, secrets, transport, grouped with their occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import redact, secret_shape

RANKS = {"high": 3, "medium": 2, "low": 1}


def occurrences(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """path, line and name of every match of a pattern, line by line."""
    lines = files.select("path", F.posexplode(F.split("source", "\n")).alias("_n", "text"))
    hits = lines.where(F.col("text").rlike(pattern))
    return hits.select("path", (F.col("_n") + 1).cast("bigint").alias("line"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("name"))


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row a key: the highest confidence and the distinct occurrences."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    out = rows.withColumn("_r", rank).groupBy(*keys).agg(F.max("_r").alias("_r"), F.count_distinct("path", "line").alias("n_occurrences"), F.min(F.struct("path", "line")).alias("_f"))
    name = F.when(F.col("_r") == 3, "high").when(F.col("_r") == 2, "medium").otherwise("low")
    return out.select(*keys, name.alias("confidence"), "n_occurrences", F.col("_f.path").alias("path"), F.col("_f.line").alias("line"))


def secrets(files: DataFrame) -> DataFrame:
    """Lines with a secret's shape: the shape, and the line with its literals struck out."""
    lines = files.select("path", F.posexplode(F.split("source", "\n")).alias("_n", "text"))
    return lines.withColumn("shape", secret_shape(F.col("text"))).where("shape IS NOT NULL").select("path", (F.col("_n") + 1).cast("bigint").alias("line"), "shape", redact(F.col("text")).alias("redacted"))


def flag_severity(group: DataFrame, is_dev: Column) -> Column:
    """A flag seen at compile time and in development paths alone is a warning."""
    return F.when(is_dev, "warning").otherwise("error")
