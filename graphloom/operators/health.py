"""Function metrics, line coverage and file scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import crap, div, percent


@dataclass(frozen=True)
class Limits:
    """Default thresholds; a finding exceeds them strictly."""

    cyclomatic: int = 20
    cognitive: int = 15
    unit_size: int = 60
    crap_allowance: int = 30
    hotspot: int = 70
    refactoring: int = 85


def complexity_findings(functions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Functions over the cyclomatic or cognitive limit, with the kind of finding."""
    cyc, cog = F.col("cyclomatic") > limits.cyclomatic, F.col("cognitive") > limits.cognitive
    kind = F.when(cyc & cog, "high-complexity").when(cyc, "high-cyclomatic-complexity").when(cog, "high-cognitive-complexity")
    return functions.withColumn("kind", kind).where("kind IS NOT NULL")


def large_functions(functions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    lines = F.greatest(F.col("end_line") - F.col("line"), F.lit(0)) + 1
    return functions.withColumn("line_count", lines.cast("bigint")).where(F.col("line_count") > limits.unit_size)


def line_coverage(coverage: DataFrame) -> DataFrame:
    """Covered and executable lines of each file, percent, status."""
    per = coverage.groupBy("path").agg(F.count_if(F.col("hits") > 0).alias("covered_lines"), F.count("*").alias("executable_lines"), F.min("line").alias("first_line"))
    status = F.when(F.col("executable_lines") == 0, "no-executable-lines").when(F.col("covered_lines") == 0, "uncovered").otherwise("covered")
    return per.withColumns({"coverage_percent": percent(F.col("covered_lines"), F.col("executable_lines")), "status": status})


def coverage_gaps(functions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Files that have functions, executable lines, and none covered: with their first function."""
    first = functions.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("line", "symbol"))).where("_r = 1").drop("_r")
    gaps = line_coverage(coverage).where("covered_lines = 0").select("path", "executable_lines", "first_line")
    return first.select("path", F.col("symbol").alias("first_symbol")).join(gaps, "path")


def crap_scores(functions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Covered and executable lines within each function, and its score; files without coverage are left out.

    The range join is an equi-join on the path, so a file's lines and functions
    meet in one place, and the counts are made as the rows pass.
    """
    files = coverage.select("path").distinct()
    f = functions.join(files, "path", "left_semi").select("path", "symbol", "line", "end_line", "cyclomatic")
    c = coverage.select(F.col("path").alias("_p"), F.col("line").alias("_l"), "hits")
    met = f.join(c, (F.col("path") == F.col("_p")) & F.col("_l").between(F.col("line"), F.col("end_line")), "left")
    per = met.groupBy("path", "symbol", "line", "end_line", "cyclomatic").agg(F.count_if(F.col("hits") > 0).alias("covered_lines"), F.count("hits").alias("executable_lines"))
    return per.withColumn("crap", crap(F.col("cyclomatic"), F.col("covered_lines"), F.col("executable_lines")))


def coverage_penalty(status: Column) -> Column:
    return F.when(status == "no-executable-lines", 15).when(status == "missing", 25).when(status == "uncovered", 35).otherwise(0)


def over(value: Column, limit: int) -> Column:
    """Twice what lies above half a limit."""
    return F.greatest(value - limit // 2, F.lit(0)) * 2


def file_scores(functions: DataFrame, crap_findings: DataFrame | None = None, coverage: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """A row a file: counts, maxima, score from 0 to 100 and coverage status."""
    complex_ = (F.col("cyclomatic") > limits.cyclomatic) | (F.col("cognitive") > limits.cognitive)
    per = functions.groupBy("path").agg(
        F.count("*").alias("functions"), F.count_if(complex_).alias("complex_functions"),
        F.max("cyclomatic").cast("bigint").alias("max_cyclomatic"), F.max("cognitive").cast("bigint").alias("max_cognitive"),
    )
    zero = F.lit(0).cast("bigint")
    if crap_findings is not None:
        per = per.join(crap_findings.groupBy("path").agg(F.max("crap").alias("max_crap")), "path", "left").withColumn("max_crap", F.coalesce("max_crap", zero))
    else:
        per = per.withColumn("max_crap", zero)
    if coverage is not None:
        per = per.join(line_coverage(coverage).select("path", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    else:
        per = per.withColumn("status", F.lit("not-requested"))
    penalty = over(F.col("max_cyclomatic"), limits.cyclomatic) + over(F.col("max_cognitive"), limits.cognitive) + F.col("complex_functions") * 8 + over(F.col("max_crap"), limits.crap_allowance) + coverage_penalty(F.col("status"))
    return per.withColumn("score", (100 - F.least(penalty, F.lit(100))).cast("bigint"))


def project_quality(scores: DataFrame) -> DataFrame:
    """Mean score weighted by functions (at least one a file), half up; 100 without files."""
    w = F.greatest(F.col("functions"), F.lit(1).cast("bigint"))
    agg = scores.agg(F.sum(F.col("score") * w).alias("s"), F.sum(w).alias("w"))
    q = F.when(F.col("w") > 0, div(F.col("s") + div(F.col("w"), 2), F.when(F.col("w") > 0, F.col("w")).otherwise(1))).otherwise(F.lit(100).cast("bigint"))
    return agg.select(q.alias("quality_score"))


def hotspots(scores: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return scores.where(F.col("score") < limits.hotspot)


def refactoring_targets(scores: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Low scores with a complex or CRAP function, and their priority."""
    bonus = F.when(F.col("status").isin("missing", "uncovered"), 10).otherwise(0)
    priority = 100 - F.col("score") + F.col("complex_functions") * 10 + div(F.col("max_crap"), 2) + bonus
    return scores.where((F.col("score") < limits.refactoring) & ((F.col("complex_functions") > 0) | (F.col("max_crap") > 0))).withColumn("priority", priority.cast("bigint"))
