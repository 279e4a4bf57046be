"""Declarations against references: counts, anti-joins, duplicates, couplings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_counts(references: DataFrame, reachable: DataFrame, keys: list[str]) -> DataFrame:
    """References in reachable files by name, (qualifier, name) or (library, name)."""
    return references.join(reachable.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_references"))


def unreferenced(declarations: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Declarations that nothing refers to."""
    return declarations.join(counts.where("n_references > 0").select(*keys), keys, "left_anti")


def is_private(name: Column) -> Column:
    return name.startswith("_")


def duplicates(rows: DataFrame, keys: list[str], member: str, order: list) -> DataFrame:
    """Keys whose members are of several different values: their number and, in order, the values."""
    per = rows.groupBy(*keys, member).agg(F.min(F.struct(*order)).alias("_f"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list(member)).alias("members"))
    return out.where("n_members > 1")


def collisions(rows: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """Keys met more than once, as a multiset: the same member twice collides with itself."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_routes"), F.array_sort(F.collect_list(F.struct(*members))).alias("routes"))
    return out.where("n_routes > 1")


def unique_targets(refs: DataFrame, declarations: DataFrame, keys: list[str], target: str) -> DataFrame:
    """References whose key is declared exactly once, with that declaration."""
    once = declarations.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")
    return refs.join(once, keys)


def alone_on_line(declarations: DataFrame) -> DataFrame:
    """Declarations of a single line that no other shares: safe to delete."""
    n = F.count("*").over(Window.partitionBy("path", "start_line"))
    return declarations.withColumn("_n", n).where("_n = 1 AND start_line = end_line").drop("_n")


def selected_branches(branches: DataFrame, environment: DataFrame) -> DataFrame:
    """One branch of each directive: the first whose condition holds, else the one without.

    A condition compares a variable with a value; an absent variable equals
    ``false``. With an empty environment every branch is kept.
    """
    env = environment.select(F.col("variable").alias("_v"), F.col("value").alias("_x"))
    some = F.broadcast(environment.agg((F.count("*") > 0).alias("_some")))
    b = branches.join(F.broadcast(env), F.col("variable") == F.col("_v"), "left").crossJoin(some)
    holds = F.coalesce("_x", F.lit("false")) == F.col("expected")
    b = b.withColumn("_rank", F.when(F.col("variable").isNull(), 1).when(holds, 0))
    r = F.row_number().over(Window.partitionBy("path", "line", "col").orderBy(F.col("_rank").asc_nulls_last(), "ordinal"))
    return b.withColumn("_r", r).where(~F.col("_some") | (F.col("_rank").isNotNull() & (F.col("_r") == 1))).select(*branches.columns)


def lookback(lines: DataFrame, back: int = 32) -> DataFrame:
    """Each line with the text of itself and the lines before it."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-back, 0)
    return lines.withColumn("window", F.array_join(F.collect_list("text").over(w), "\n"))


def resolution(candidates: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Found, absent or unknown: one target is found, none is absent if all was read, else unknown.

    ``candidates`` has a row a possible target (null if none) and ``complete``.
    """
    per = candidates.groupBy(*keys).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target), F.bool_and("complete").alias("complete"))
    state = F.when(F.col("n") == 1, "found").when((F.col("n") == 0) & F.col("complete"), "absent").otherwise("unknown")
    return per.select(*keys, state.alias("state"), F.when(F.col("n") == 1, F.col(target)).alias(target))


def sections(lines: DataFrame, keys: list[str], order: list[str], header: Column) -> DataFrame:
    """Each line with the last header at or before it: section names, record ids."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, True).over(w))
