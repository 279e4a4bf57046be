"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components (positive: 1), cut into m
segments of about log2(n) bits. An index holds each distinct code once under
each of its segments. A search probes all segment values within radius s of the
query's, s = 0, 1, ...: once segments 0..a are probed to radius s and the others
to s - 1, every code within Hamming distance m*s + a has been seen. A query is
done when its kth verified distance is covered by that bound; in each round it
probes no more segments than it needs for it.

Rows with equal codes are one entry of the index with their k + 1 smallest ids,
which is all that a ranking by (distance, id) can use of them. Only DataFrame
functions are used.

Defined results: rows without a vector, or without any component, are neither
found nor searched for; null components count as 0 bits, shorter vectors are
filled with 0 bits; a row isn't its own neighbour; rows that repeat an id with
another vector are each a row; null ids are left out; fewer than k neighbours
give fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import HOT_SHARE, materialise, salted_left_join

_RESULT = "query_id bigint, rank bigint, neighbor_id bigint, distance bigint"
_SALTS = 16


def segments(vectors: DataFrame, id_col: str, vec_col: str, m: int, width: int) -> DataFrame:
    """id and the m segment values of each vector's code."""
    bit = f"transform(sequence(0, {m * width - 1}), i -> CAST(coalesce(get(`{vec_col}`, i) > 0, false) AS BIGINT))"
    value = f"transform(sequence(0, {m - 1}), j -> aggregate(slice(bits, j * {width} + 1, {width}), 0L, (a, x) -> a * 2 + x))"
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.expr(bit).alias("bits")).select("id", F.expr(value).alias("code"))


def _distance(a: str, b: str) -> F.Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(bit_count(x ^ y) AS BIGINT)), 0L, (s, d) -> s + d)")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance; ties go to the smaller id.

    ``is_query`` is a condition on the column ``id``, the row's id.
    """
    spark = vectors.sparkSession
    shape = vectors.where(F.col(id_col).isNotNull()).agg(F.max(F.size(vec_col)).alias("d"), F.count("*").alias("n")).first()
    if not shape["n"] or not shape["d"] or shape["d"] < 1:
        return spark.createDataFrame([], _RESULT)
    d = shape["d"]
    m = min(d, max(1, round(d / max(1.0, math.log2(shape["n"])))))
    width = -(-d // m)
    rows = segments(vectors, id_col, vec_col, m, width)
    # The k + 1 smallest ids of each code; the limit applies before the shuffle too, so a hot code is no hot task.
    first = Window.partitionBy("code").orderBy("id")
    codes = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes = materialise(codes.withColumn("least", F.element_at("ids", 1)), "codes")
    queries = materialise(rows.where(is_query), "queries")
    wanted = materialise(queries.groupBy("code").agg(F.min("id").alias("q"), F.count("*").alias("n")), "wanted")

    index = codes.select(F.posexplode("code").alias("seg", "value"), "code", "ids", "least")
    total = codes.count() * m
    sizes = codes.select(F.posexplode("code").alias("seg", "value")).groupBy("seg", "value").count()
    hot = F.broadcast(sizes.where(F.col("count") >= max(1000, total // HOT_SHARE)).select("seg", "value", F.lit(True).alias("hot")))
    index = index.join(hot, ["seg", "value"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("code"), F.lit(_SALTS)).cast("int")).otherwise(0)).drop("hot")
    index = materialise(index, "index")

    best: DataFrame | None = None
    # need: how many segments to probe in the next round; all, as long as fewer than k are known
    active = wanted.select("q", "code", F.lit(m).alias("need"), F.lit(d).cast("bigint").alias("bound"))
    for s in range(width + 1):
        masks = [sum(1 << b for b in c) for r in ((0, 1) if s == 1 else (s,)) for c in combinations(range(width), r)] if s else None
        if masks is None:
            continue  # radius 0 is probed along with radius 1
        flips = F.array(*map(F.lit, masks)) if len(masks) <= 256 else F.from_json(F.lit(str(masks)), "array<bigint>")
        probes = active.select("q", F.col("code").alias("asked"), "need", "bound", F.posexplode("code").alias("seg", "own")).where(F.col("seg") < F.col("need"))
        # One small file holds what is left: its probes are formed by many tasks.
        probes = probes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q", "seg")
        probes = probes.withColumn("flip", F.explode(flips)).select("q", "asked", "bound", "seg", F.col("own").bitwiseXOR(F.col("flip").cast("bigint")).alias("value"))
        probes = probes.join(hot, ["seg", "value"], "left")
        every = F.sequence(F.lit(0), F.lit(_SALTS - 1))
        probes = probes.withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))).drop("hot")
        # Its size is estimated as that of the few rows before the explodes: it must not be broadcast.
        met = probes.join(index.hint("shuffle_hash"), ["seg", "value", "salt"]).select("q", "code", "ids", "least", "bound", _distance("asked", "code").alias("distance"))
        # What is farther than the kth known can't be among the k nearest.
        met = met.where("distance <= bound").drop("bound")
        if best is not None:
            met = met.unionByName(best.select(met.columns))
        # A code can be met under several segments: its copies are next to each other in this order.
        order = Window.partitionBy("q").orderBy("distance", "least", "code")
        ranked = met.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).dropDuplicates(["q", "r"])
        best = materialise(ranked.drop("r"), "best")
        so_far = Window.partitionBy("q").orderBy("distance", "least").rowsBetween(Window.unboundedPreceding, 0)
        kth = best.withColumn("seen", F.sum(F.size("ids")).over(so_far)).where(F.col("seen") >= k + 1).groupBy("q").agg(F.min("distance").alias("kth"))
        # Covered so far: where `need` segments have radius s and the rest s - 1.
        covered = F.when(F.col("need") >= m, F.lit(m * (s + 1) - 1)).otherwise(F.lit(m * s - 1) + F.col("need"))
        left = active.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
        missing = (F.col("kth") - F.lit(m * (s + 1) - 1)).cast("int")
        bound = F.coalesce(F.col("kth"), F.lit(d).cast("bigint"))
        active = materialise(left.select("q", "code", F.least(F.lit(m), F.coalesce(missing, F.lit(m))).alias("need"), bound.alias("bound")), "active")
        if active.isEmpty():
            break
    lists = best.groupBy("q").agg(F.collect_list(F.struct("distance", "ids")).alias("found"))  # at most (k + 1) ** 2 ids
    answers = materialise(wanted.select("q", "code", "n").join(lists, "q").select("code", "n", "found"), "answers")
    got = salted_left_join(queries, answers, "code", "n", ["id"])
    own = F.expr("slice(array_sort(filter(flatten(transform(found, f -> transform(f.ids, x -> struct(f.distance AS distance, x AS neighbor)))), y -> y.neighbor != id)), 1, {})".format(k))
    out = got.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.neighbor").alias("neighbor_id"), F.col("x.distance").alias("distance"))
