"""Joins that plain equality doesn't give: prefix, priority, range, nearest, first and last match."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

#: Keys of one value in a piece of near_pairs.
PIECE = 1024
#: Rule tables are written by people; larger ones are refused as broadcasts.
MAX_RULES = 100_000


def rules(df: DataFrame) -> DataFrame:
    """A rule table as a broadcast side, its size checked."""
    return F.broadcast(df) if df.limit(MAX_RULES + 1).count() <= MAX_RULES else df


def ancestors(path: Column, sep: str = "/") -> Column:
    """All leading parts of a path, itself included, and the empty root."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Each row with the deepest root that is a leading part of its path.

    The ancestors of each distinct path meet the roots by equality, so no pair of
    row and root is formed that doesn't match.
    """
    paths = rows.select(path).distinct()
    up = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("_depth", root))
    best = up.join(roots, root).groupBy(path).agg(F.max_by(F.struct(*roots.columns), "_depth").alias("_best"))
    return rows.join(best, path, "left").select(*rows.columns, *(F.col(f"_best.{c}").alias(c) for c in roots.columns))


def prioritised(candidates: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Union of lookups, the first list that has a match wins, then ``order``."""
    every = None
    for k, c in enumerate(candidates):
        part = c.withColumn("priority", F.lit(k).cast("bigint"))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("priority", *order)
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prefix_rules(edges: DataFrame, rule_table: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose ends lie under a rule's two folders; component-wise, so ``lib/a`` isn't under ``lib/ab``."""
    slash = lambda c: F.concat(c, F.lit("/"))
    hit = F.startswith(slash(F.col(src)), slash(F.col("rule_from"))) & F.startswith(slash(F.col(dst)), slash(F.col("rule_disallow")))
    return edges.join(rules(rule_table), hit)


def first_match(rows: DataFrame, rule_table: DataFrame, on: Column, keys: list[str], ordinal: str) -> DataFrame:
    """Each row with its first matching rule, nulls if none. ``keys`` tell rows apart."""
    return _match(rows, rule_table, on, keys, F.min_by, ordinal)


def last_match(rows: DataFrame, rule_table: DataFrame, on: Column, keys: list[str], ordinal: str) -> DataFrame:
    """Each row with its last matching rule, nulls if none."""
    return _match(rows, rule_table, on, keys, F.max_by, ordinal)


def _match(rows, rule_table, on, keys, pick, ordinal):
    met = rows.join(rules(rule_table), on, "left")
    others = [c for c in rows.columns if c not in keys]
    best = met.groupBy(*keys).agg(*(F.first(c).alias(c) for c in others), pick(F.struct(*rule_table.columns), ordinal).alias("_m"))
    return best.select(*rows.columns, *(F.col(f"_m.{c}").alias(c) for c in rule_table.columns))


def nearest(rows: DataFrame, key: str, value: str, targets: DataFrame, name: str, at: str) -> DataFrame:
    """Each row with the target of the nearest value; ties go to the smaller name.

    Values are numbers: the two sides are merged in order, and each row looks at
    the last target at or before it and the first at or after it. No pairs are
    formed. Ranges of values (a hundredth of the targets' span) are the
    partitions; each knows the targets just outside from a table of range ends.
    """
    span = targets.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    cell = lambda c: F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(99), F.floor((c - F.col("lo")) * 100 / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1))))).otherwise(F.lit(0)).cast("int")
    one = targets.groupBy(at).agg(F.min(name).alias(name))
    t = one.crossJoin(F.broadcast(span)).select(F.col(at).cast("double").alias("_v"), F.col(name).alias("_name"), cell(F.col(at)).alias("_cell"))
    ends = t.groupBy("_cell").agg(F.max(F.struct("_v", "_name")).alias("_last"), F.min(F.struct("_v", "_name")).alias("_first"))
    cells = targets.sparkSession.range(100).select(F.col("id").cast("int").alias("_cell"))
    all_ends = cells.join(ends, "_cell", "left")
    back = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    outside = all_ends.select("_cell", F.last("_last", True).over(back).alias("_before"), F.first("_first", True).over(ahead).alias("_after"))  # 100 rows
    r = rows.crossJoin(F.broadcast(span)).select(*rows.columns, F.col(value).cast("double").alias("_v"), cell(F.col(value)).alias("_cell"))
    none = F.lit(None)
    merged = r.withColumn("_name", none.cast("string")).unionByName(t.select(*(none.cast(rows.schema[c].dataType).alias(c) for c in rows.columns), "_v", "_cell", F.col("_name").cast("string")))
    mark = F.when(F.col("_name").isNotNull(), F.struct("_v", "_name"))
    up = Window.partitionBy("_cell").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_cell").orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumns({"_below": F.max(mark).over(up), "_above": F.min(mark).over(down)}).where(F.col("_name").isNull())
    merged = merged.join(F.broadcast(outside), "_cell").withColumns({"_below": F.coalesce("_below", "_before"), "_above": F.coalesce("_above", "_after")})
    gap = lambda c: F.abs(F.col("_v") - F.col(f"{c}._v"))
    best = F.array_min(F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("d"), F.col(f"{c}._name").alias("n"))) for c in ("_below", "_above"))), lambda x: x.isNotNull()))
    return merged.withColumn("_best", best).select(*rows.columns, F.col("_best.n").alias(name), F.col("_best.d").alias("distance"))


def near_pairs(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Pairs of keys with 0 < (difference of whole values)² <= ``most``, each once.

    Rows of one value are kept as lists of keys, cut into pieces of at most ``PIECE``, and
    only pieces of values near enough meet, by equality of one value and the other less a
    difference. A task reads pairs of pieces and writes the pairs of rows, so what a task
    holds is bounded, and however many rows share a value, their pairs are many tasks' work.
    """
    width = max(1, math.isqrt(most))
    parts = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("x"))
    numbered = kept.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("x").orderBy("k")) - 1) / PIECE))
    pieces = cut(numbered.groupBy("x", "piece").agg(F.array_sort(F.collect_list("k")).alias("ks")))
    # Each two values once: the larger one less the difference is the smaller one.
    ahead = pieces.select(F.col("ks").alias("kb"), F.col("x").alias("xb"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(width).cast("bigint"))).alias("d"))
    ahead = ahead.select("kb", "d", (F.col("xb") - F.col("d")).alias("x"))
    met = pieces.join(ahead.hint("merge"), "x").select((F.col("d") * F.col("d")).alias("distance2"), "ks", "kb").where(F.col("distance2") <= most).repartition(parts)
    pairs = met.select("distance2", F.explode("ks").alias("l"), "kb").select("distance2", "l", F.explode("kb").alias("r"))
    return pairs.where("l != r").select(F.least("l", "r").alias("left_key"), F.greatest("l", "r").alias("right_key"), "distance2")


def pattern_hits(rows: DataFrame, rule_table: DataFrame, value: str, pattern: str) -> DataFrame:
    """A row for each row and pattern that match: globs of a rule table against a column."""
    from graphloom.functions.scalars import glob_match

    return rows.join(rules(rule_table), glob_match(F.col(value), F.col(pattern)))
