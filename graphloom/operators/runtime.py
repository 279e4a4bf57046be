"""Runtime traffic: observations, importance, hot paths, blast radius, low traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import div, micro_ratio

HOT, VOLUME, LOW_MICROS = 100, 5_000, 1_000


def observations(calls: DataFrame) -> DataFrame:
    """Invocations by (path, line, symbol); files without functions give one row of their own.

    ``calls`` has path, line, symbol and invocations; a row without a symbol is
    a file-level count.
    """
    functions = calls.where("symbol IS NOT NULL").groupBy("path", "line", "symbol").agg(F.sum("invocations").alias("invocations"))
    with_some = calls.where("symbol IS NOT NULL").select("path").distinct()
    files = calls.where("symbol IS NULL").join(with_some, "path", "left_anti").groupBy("path").agg(F.sum("invocations").alias("invocations"))
    none = F.lit(None)
    return functions.unionByName(files.select("path", none.cast("bigint").alias("line"), none.cast("string").alias("symbol"), "invocations"))


def total_of(files: DataFrame) -> DataFrame:
    """One row: all invocations. Small enough to be broadcast at any size."""
    return files.agg(F.coalesce(F.sum("invocations"), F.lit(0).cast("bigint")).alias("total"))


def importance(obs: DataFrame, functions: DataFrame, callers: DataFrame, total: DataFrame) -> DataFrame:
    """score = min(100, 70 · share of traffic + min(complexity, 20) + min(5 · callers, 10)).

    Complexity is that of the first function (by order) that has the symbol and
    spans the line.
    """
    f = functions.select(F.col("path").alias("fp"), F.col("symbol").alias("fs"), F.col("line").alias("fl"), "end_line", "cyclomatic")
    same = (F.col("path") == F.col("fp")) & F.coalesce(F.col("symbol") == F.col("fs"), F.lit(True)) & F.coalesce(F.col("o.line").between(F.col("fl"), F.col("end_line")), F.lit(True))
    met = obs.alias("o").join(f, same, "left").groupBy("path", "o.line", "symbol", "invocations").agg(F.min_by("cyclomatic", F.struct("fl", "fs")).alias("cyclomatic"))
    met = met.join(callers.select(F.col("node").alias("path"), "n_callers"), "path", "left").crossJoin(F.broadcast(total))
    zero = F.lit(0).cast("bigint")
    cc, n = F.coalesce(F.col("cyclomatic").cast("bigint"), zero), F.coalesce("n_callers", zero)
    traffic = F.when(F.col("total") > 0, div(F.col("invocations") * 70, F.when(F.col("total") > 0, F.col("total")).otherwise(1))).otherwise(zero)
    score = F.least(F.lit(100), traffic + F.least(cc, F.lit(20)) + F.least(n * 5, F.lit(10))).cast("bigint")
    return met.select("path", "line", "symbol", "invocations", cc.alias("complexity"), n.alias("n_callers"), score.alias("score"))


def hot_paths(calls: DataFrame, hot: int = HOT) -> DataFrame:
    """Hot functions; a file without one is a row if it is hot as a whole."""
    obs = calls.groupBy("path", "line", "symbol").agg(F.sum("invocations").alias("invocations"))
    functions = obs.where((F.col("invocations") >= hot) & F.col("symbol").isNotNull())
    files = calls.groupBy("path").agg(F.sum("invocations").alias("invocations")).where(F.col("invocations") >= hot)
    files = files.join(functions.select("path").distinct(), "path", "left_anti")
    none = F.lit(None)
    return functions.unionByName(files.select("path", none.cast("bigint").alias("line"), none.cast("string").alias("symbol"), "invocations"))


def blast_risk(invocations: Column, n_callers: Column, hot: int = HOT) -> Column:
    return F.when((n_callers >= 5) | (invocations >= 10 * hot), "high").when((n_callers >= 2) | (invocations >= hot), "medium").otherwise("low")


def blast_radius(hot_rows: DataFrame, obs: DataFrame, edges: DataFrame, total: DataFrame, hot: int = HOT) -> DataFrame:
    """Callers of each hot path, their traffic in millionths of all, and the risk."""
    traffic = obs.groupBy(F.col("path").alias("src")).agg(F.sum("invocations").alias("n"))
    per = edges.select("src", "dst").distinct().join(traffic, "src", "left").groupBy(F.col("dst").alias("path"))
    per = per.agg(F.count("*").alias("n_callers"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("caller_invocations"))
    zero = F.lit(0).cast("bigint")
    out = hot_rows.join(per, "path", "left").crossJoin(F.broadcast(total)).withColumns({"n_callers": F.coalesce("n_callers", zero), "caller_invocations": F.coalesce("caller_invocations", zero)})
    return out.select("path", "line", "symbol", "invocations", "n_callers", micro_ratio(F.col("caller_invocations"), F.col("total")).alias("caller_reach_micros"), blast_risk(F.col("invocations"), F.col("n_callers"), hot).alias("risk"))


def confidence(total: Column, volume: int = VOLUME) -> Column:
    return F.when(total == 0, "low").when(total >= volume, "high").otherwise("medium")


def low_traffic(files: DataFrame, total: DataFrame, micros: int = LOW_MICROS) -> DataFrame:
    """Files with a share of traffic of at most ``micros`` millionths, rounded down."""
    out = files.crossJoin(F.broadcast(total)).where("total > 0").withColumn("micros", micro_ratio(F.col("invocations"), F.col("total")))
    return out.where(F.col("micros") <= micros).select("path", "invocations", "micros", confidence(F.col("total")).alias("confidence"))


def unobserved(paths: DataFrame, files: DataFrame) -> DataFrame:
    return paths.join(files, "path", "left_anti")
