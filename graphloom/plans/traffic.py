"""Runtime traffic queries: events are calls of the functions of their user's file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import runtime as r
from graphloom.plans.registry import query
from graphloom.session import table

CALLS = """k AS (SELECT 'lib/u' || user_id || '.dart' AS path, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(length(event_type) * 10 AS BIGINT) END AS line,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS symbol, 1 + event_id % 9 AS invocations FROM events WHERE event_type <> 'click' OR user_id % 2 = 0)"""
OBS = f"""{CALLS},
o AS (SELECT path, line, symbol, CAST(sum(invocations) AS BIGINT) AS invocations FROM k WHERE symbol IS NOT NULL GROUP BY ALL
  UNION ALL SELECT path, NULL, NULL, CAST(sum(invocations) AS BIGINT) FROM k WHERE symbol IS NULL AND path NOT IN (SELECT path FROM k WHERE symbol IS NOT NULL) GROUP BY path),
t AS (SELECT CAST(sum(invocations) AS BIGINT) AS total FROM k)"""
EDGES = """d AS (SELECT DISTINCT 'lib/u' || a.user_id || '.dart' AS src, 'lib/u' || (a.user_id * 3 % 50) || '.dart' AS dst FROM events a WHERE a.user_id % 4 <> 1)"""
HOTS = f"""{OBS}, {EDGES},
hf AS (SELECT path, line, symbol, CAST(sum(invocations) AS BIGINT) AS invocations FROM k GROUP BY ALL HAVING sum(invocations) >= 100 AND symbol IS NOT NULL),
h AS (SELECT * FROM hf UNION ALL SELECT path, NULL, NULL, CAST(sum(invocations) AS BIGINT) FROM k WHERE path NOT IN (SELECT path FROM hf) GROUP BY path HAVING sum(invocations) >= 100)"""
FUNCS = """f AS (SELECT 'lib/u' || user_id || '.dart' AS path, event_type AS symbol, min(CAST(length(event_type) * 10 - 2 AS BIGINT)) AS line, min(CAST(length(event_type) * 10 + 5 AS BIGINT)) AS end_line,
  min(event_id) % 27 AS cyclomatic FROM events WHERE user_id % 5 <> 0 GROUP BY ALL)"""


def _path(u) -> F.Column:
    return F.concat(F.lit("lib/u"), u.cast("string"), F.lit(".dart"))


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type != 'click' OR user_id % 2 = 0")
    fn = F.col("event_type") != "error"
    return e.select(_path(F.col("user_id")).alias("path"), F.when(fn, (F.length("event_type") * 10).cast("bigint")).alias("line"), F.when(fn, F.col("event_type")).alias("symbol"), (1 + F.col("event_id") % 9).alias("invocations"))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").where("user_id % 4 != 1").select(_path(u).alias("src"), _path(u * 3 % 50).alias("dst")).distinct()


def functions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id % 5 != 0")
    at = (F.length("event_type") * 10).cast("bigint")
    return e.groupBy(_path(F.col("user_id")).alias("path"), F.col("event_type").alias("symbol")).agg(F.min(at - 2).alias("line"), F.min(at + 5).alias("end_line"), (F.min("event_id") % 27).alias("cyclomatic"))


@query("runtime_observations", f"WITH {OBS} SELECT * FROM o")
def runtime_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.observations(calls_of(spark, sf_dir))


@query("runtime_importance", f"""WITH {OBS}, {EDGES}, {FUNCS},
n AS (SELECT dst AS path, count(DISTINCT src) AS n_callers FROM d GROUP BY dst),
m AS (SELECT o.path, o.line, o.symbol, o.invocations, arg_min(f.cyclomatic, (f.line, f.symbol)) AS c FROM o LEFT JOIN f ON f.path = o.path AND coalesce(o.symbol = f.symbol, true) AND coalesce(o.line BETWEEN f.line AND f.end_line, true) GROUP BY ALL)
SELECT m.path, m.line, m.symbol, m.invocations, coalesce(c, 0) AS complexity, coalesce(n_callers, 0) AS n_callers,
  CAST(least(100, m.invocations * 70 // total + least(coalesce(c, 0), 20) + least(coalesce(n_callers, 0) * 5, 10)) AS BIGINT) AS score FROM m LEFT JOIN n ON n.path = m.path, t""")
def runtime_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return r.importance(r.observations(calls), functions_of(spark, sf_dir), g.callers(edges_of(spark, sf_dir)), r.total_of(calls))


@query("hot_paths", f"WITH {HOTS} SELECT * FROM h")
def hot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.hot_paths(calls_of(spark, sf_dir)).orderBy(F.desc("invocations"), "path", "line", "symbol")


@query("blast_radius", f"""WITH {HOTS},
p AS (SELECT path, sum(invocations) AS n FROM o GROUP BY path),
c AS (SELECT d.dst AS path, count(*) AS n_callers, coalesce(sum(p.n), 0) AS ci FROM d LEFT JOIN p ON p.path = d.src GROUP BY d.dst)
SELECT h.path, h.line, h.symbol, h.invocations, coalesce(n_callers, 0) AS n_callers, CAST(coalesce(ci, 0) * 1000000 // total AS BIGINT) AS caller_reach_micros,
  CASE WHEN coalesce(n_callers, 0) >= 5 OR h.invocations >= 1000 THEN 'high' WHEN coalesce(n_callers, 0) >= 2 OR h.invocations >= 100 THEN 'medium' ELSE 'low' END AS risk FROM h LEFT JOIN c ON c.path = h.path, t""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return r.blast_radius(r.hot_paths(calls), r.observations(calls), edges_of(spark, sf_dir), r.total_of(calls))


@query("low_traffic", f"""WITH {CALLS}, t AS (SELECT sum(invocations) AS total FROM k), p AS (SELECT path, CAST(sum(invocations) AS BIGINT) AS invocations FROM k GROUP BY path)
SELECT path, invocations, CAST(invocations * 1000000 // total AS BIGINT) AS micros, CASE WHEN total >= 5000 THEN 'high' ELSE 'medium' END AS confidence FROM p, t WHERE invocations * 1000000 // total <= 9000""")
def low_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return r.low_traffic(calls.groupBy("path").agg(F.sum("invocations").alias("invocations")), r.total_of(calls), 9_000)


@query("unobserved_files", f"WITH {CALLS} SELECT DISTINCT 'lib/u' || c_custkey || '.dart' AS path FROM customer WHERE 'lib/u' || c_custkey || '.dart' NOT IN (SELECT path FROM k)")
def unobserved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "customer").select(_path(F.col("c_custkey")).alias("path")).distinct()
    return r.unobserved(paths, calls_of(spark, sf_dir).select("path").distinct())


@query("observation_confidence", f"WITH {CALLS} SELECT symbol, CAST(sum(invocations) AS BIGINT) AS total, CASE WHEN sum(invocations) = 0 THEN 'low' WHEN sum(invocations) >= 5000 THEN 'high' ELSE 'medium' END AS confidence FROM k GROUP BY symbol")
def observation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = calls_of(spark, sf_dir).groupBy("symbol").agg(F.sum("invocations").alias("total"))
    return per.withColumn("confidence", r.confidence(F.col("total")))
