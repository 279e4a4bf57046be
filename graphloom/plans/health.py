"""Function, coverage and score queries: orders are functions of their customer's file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import health as h
from graphloom.plans.registry import query
from graphloom.session import table

FUNCS = """f AS (SELECT 'lib/p' || (o_custkey % 97) || '/c' || o_custkey || '.dart' AS path, 'f' || o_orderkey AS symbol, o_orderkey % 1000 + 1 AS line,
  o_orderkey % 1000 + 1 + CAST(floor(o_totalprice / 3000) AS BIGINT) AS end_line, 1 + o_orderkey * 7 % 31 AS cyclomatic, o_orderkey * 13 % 23 AS cognitive FROM orders)"""
COVER = """c AS (SELECT 'lib/p' || (o_custkey % 97) || '/c' || o_custkey || '.dart' AS path, o_orderkey % 1000 + 1 + l_linenumber * 3 AS line,
  CAST(sum(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) % 4 END) AS BIGINT) AS hits
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 3 <> 0 GROUP BY 1, 2)"""
LINES = f"""{COVER},
v AS (SELECT path, count(*) FILTER (hits > 0) AS covered_lines, count(*) AS executable_lines, min(line) AS first_line FROM c GROUP BY path)"""
CRAP = f"""{FUNCS}, {COVER},
k AS (SELECT f.path, f.symbol, f.line, f.end_line, f.cyclomatic, count(*) FILTER (c.hits > 0) AS covered_lines, count(c.hits) AS executable_lines
  FROM f LEFT JOIN c ON c.path = f.path AND c.line BETWEEN f.line AND f.end_line WHERE f.path IN (SELECT path FROM c) GROUP BY ALL),
s AS (SELECT *, CASE WHEN executable_lines = 0 THEN cyclomatic * cyclomatic + cyclomatic ELSE cyclomatic + CAST(
  (cyclomatic * cyclomatic * (executable_lines - covered_lines) ** 3)::HUGEINT // (executable_lines ** 3)::HUGEINT +
  CASE WHEN (cyclomatic * cyclomatic * (executable_lines - covered_lines) ** 3)::HUGEINT % (executable_lines ** 3)::HUGEINT > 0 THEN 1 ELSE 0 END AS BIGINT) END AS crap FROM k)"""
SCORES = f"""{CRAP},
w AS (SELECT path, covered_lines FROM (SELECT path, count(*) FILTER (hits > 0) AS covered_lines FROM c GROUP BY path)),
g AS (SELECT path, count(*) AS functions, count(*) FILTER (cyclomatic > 20 OR cognitive > 15) AS complex_functions, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive FROM f GROUP BY path),
q AS (SELECT g.*, coalesce(m.max_crap, 0) AS max_crap, CASE WHEN w.path IS NULL THEN 'missing' WHEN w.covered_lines = 0 THEN 'uncovered' ELSE 'covered' END AS status
  FROM g LEFT JOIN (SELECT path, max(crap) AS max_crap FROM s WHERE crap >= 30 GROUP BY path) m ON m.path = g.path LEFT JOIN w ON w.path = g.path),
z AS (SELECT *, CAST(100 - least(100, greatest(max_cyclomatic - 10, 0) * 2 + greatest(max_cognitive - 7, 0) * 2 + complex_functions * 8 + greatest(max_crap - 15, 0) * 2
  + CASE status WHEN 'missing' THEN 25 WHEN 'uncovered' THEN 35 ELSE 0 END) AS BIGINT) AS score FROM q)"""


def path_of(cust) -> F.Column:
    return F.concat(F.lit("lib/p"), (cust % 97).cast("string"), F.lit("/c"), cust.cast("string"), F.lit(".dart"))


def functions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    line = o % 1000 + 1
    return table(spark, sf_dir, "orders").select(
        path_of(F.col("o_custkey")).alias("path"), F.concat(F.lit("f"), o.cast("string")).alias("symbol"), line.alias("line"),
        (line + F.floor(F.col("o_totalprice") / 3000).cast("bigint")).alias("end_line"), (1 + o * 7 % 31).alias("cyclomatic"), (o * 13 % 23).alias("cognitive"),
    )


def coverage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_custkey % 3 != 0").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    hits = F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("bigint") % 4)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(path_of(F.col("o_custkey")).alias("path"), (F.col("o_orderkey") % 1000 + 1 + F.col("l_linenumber") * 3).alias("line"), hits.alias("h")).groupBy("path", "line").agg(F.sum("h").alias("hits"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, coverage = functions_of(spark, sf_dir), coverage_of(spark, sf_dir)
    return h.file_scores(functions, h.crap_scores(functions, coverage).where("crap >= 30"), coverage)


@query("complexity_findings", f"WITH {FUNCS} SELECT *, CASE WHEN cyclomatic > 20 AND cognitive > 15 THEN 'high-complexity' WHEN cyclomatic > 20 THEN 'high-cyclomatic-complexity' ELSE 'high-cognitive-complexity' END AS kind FROM f WHERE cyclomatic > 20 OR cognitive > 15")
def complexity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.complexity_findings(functions_of(spark, sf_dir))


@query("large_functions", f"WITH {FUNCS} SELECT *, end_line - line + 1 AS line_count FROM f WHERE end_line - line + 1 > 60")
def large_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.large_functions(functions_of(spark, sf_dir))


@query("max_complexity", f"WITH {FUNCS} SELECT coalesce(max(cyclomatic), 0) AS max_cyclomatic FROM f")
def max_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_of(spark, sf_dir).agg(F.coalesce(F.max("cyclomatic"), F.lit(0).cast("bigint")).alias("max_cyclomatic"))


@query("line_coverage", f"WITH {LINES} SELECT *, (covered_lines * 100 + executable_lines // 2) // executable_lines AS coverage_percent, CASE WHEN covered_lines = 0 THEN 'uncovered' ELSE 'covered' END AS status FROM v")
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.line_coverage(coverage_of(spark, sf_dir))


@query("coverage_gaps", f"WITH {FUNCS}, {LINES} SELECT f.path, arg_min(symbol, (line, symbol)) AS first_symbol, any_value(v.executable_lines) AS executable_lines, any_value(v.first_line) AS first_line FROM f JOIN v ON v.path = f.path AND v.covered_lines = 0 GROUP BY f.path")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.coverage_gaps(functions_of(spark, sf_dir), coverage_of(spark, sf_dir))


@query("crap_scores", f"WITH {CRAP} SELECT * FROM s")
def crap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.crap_scores(functions_of(spark, sf_dir), coverage_of(spark, sf_dir))


@query("file_scores", f"WITH {SCORES} SELECT * FROM z")
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query("quality_score", f"WITH {SCORES} SELECT CAST((sum(score * functions) + sum(functions) // 2) // sum(functions) AS BIGINT) AS quality_score FROM z")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.project_quality(_scores(spark, sf_dir))


@query("hotspots", f"WITH {SCORES} SELECT path, score, functions, complex_functions FROM z WHERE score < 70")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.hotspots(_scores(spark, sf_dir)).select("path", "score", "functions", "complex_functions").orderBy("score", "path")


@query("refactoring_targets", f"""WITH {SCORES} SELECT path, score, CAST(100 - score + complex_functions * 10 + max_crap // 2 + CASE WHEN status IN ('missing', 'uncovered') THEN 10 ELSE 0 END AS BIGINT) AS priority
FROM z WHERE score < 85 AND (complex_functions > 0 OR max_crap > 0)""")
def refactoring_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.refactoring_targets(_scores(spark, sf_dir)).select("path", "score", "priority").orderBy(F.desc("priority"), "path")


@query("scoped_quality_score", f"WITH {SCORES} SELECT CAST((sum(score * functions) + sum(functions) // 2) // sum(functions) AS BIGINT) AS quality_score FROM z WHERE path LIKE 'lib/p1%'")
def scoped_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality over the files in scope alone: the scope is applied to scores, not to what they are made of."""
    return h.project_quality(_scores(spark, sf_dir).where(F.col("path").startswith("lib/p1")))
