"""Declared packages against what the sources import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage(imports: DataFrame) -> DataFrame:
    """Whether each package's dependency is used in production and in development."""
    return imports.groupBy("package", "dep").agg(F.bool_or("in_production").alias("production"), F.bool_or(~F.col("in_production")).alias("development"))


def issue(declared: DataFrame, used: DataFrame) -> DataFrame:
    """The issue of each declaration, by its section and use; ``ok`` if none."""
    both = declared.join(used.withColumn("_used", F.lit(True)), ["package", "dep"], "left")
    none, dev = F.col("_used").isNull(), F.col("section") == "dev_dependencies"
    over = F.col("section") == "dependency_overrides"
    kind = (
        F.when(none & over, "unused-dependency-override").when(none & dev, "unused-dev-dependency").when(none, "unused-dependency")
        .when(dev & F.col("production"), "dev-dependency-in-production").when(~dev & ~over & ~F.col("production"), "test-only-dependency").otherwise("ok")
    )
    return both.withColumn("issue", kind).drop("_used")


def unlisted(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """The first import of each package and dependency that no section declares."""
    missing = imports.join(declared.select("package", "dep").distinct(), ["package", "dep"], "left_anti")
    return missing.groupBy("package", "dep").agg(F.min(F.struct("path", "line")).alias("_f")).select("package", "dep", F.col("_f.path").alias("path"), F.col("_f.line").alias("line"))
