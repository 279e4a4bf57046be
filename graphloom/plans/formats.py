"""Format queries: texts made from the tables, read back by the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import program
from graphloom.plans.registry import query
from graphloom.session import table
from graphloom.sources import readers as r


@query("lcov_lines", "SELECT 'f' || (o_custkey % 40) AS path, o_orderkey % 90 + 1 AS line, CAST(sum(o_orderkey % 4) AS BIGINT) AS hits FROM orders GROUP BY 1, 2")
def lcov_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("f"), k)
    da = F.concat(F.lit("DA:"), (k % 90 + 1).cast("string"), F.lit(","), (k % 4).cast("string"))
    parts = o.groupBy("f").agg(F.array_sort(F.collect_list(da)).alias("das"))
    text = F.concat(F.lit("TN:\nSF:f"), F.col("f").cast("string"), F.lit("\n"), F.array_join("das", "\n"), F.lit("\nend_of_record\n"))
    files = parts.groupBy((F.col("f") % 3).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("source"))
    return r.lcov(r.text_lines(files.select(F.concat(F.lit("lcov"), F.col("g").cast("string")).alias("path"), "source")))


@query("diff_added_lines", "SELECT DISTINCT 'lib/p' || p_partkey || '.dart' AS path, p_size + i AS line FROM part, (VALUES (1), (2), (4)) t(i) WHERE p_partkey % 3 = 0")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks with a kept line, two added, one removed, one kept and one added."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    name = F.concat(F.lit("lib/p"), F.col("p_partkey").cast("string"), F.lit(".dart"))
    text = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,3 +"), F.col("p_size").cast("string"), F.lit(",5 @@\n kept\n+one\n+two\n-gone\n kept\n+three"))
    files = p.groupBy((F.col("p_partkey") % 5).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("source"))
    return r.diff_lines(r.text_lines(files.select(F.col("g").cast("string").alias("path"), "source"))).select("path", F.col("line").cast("int").alias("line"))


@query("codeowner_rules", "SELECT n_nationkey + 1 + n_nationkey // 5 + 1 AS ord, n_name AS pattern, ['@r' || n_regionkey, '@' || n_name] AS owners, 'sec' || (n_nationkey // 5) AS section FROM nation")
def codeowner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    line = F.concat("n_name", F.lit("  @r"), F.col("n_regionkey").cast("string"), F.lit(" @"), "n_name")
    head = F.when(k % 5 == 0, F.concat(F.lit("[sec"), F.floor(k / 5).cast("string"), F.lit("]\n"))).otherwise("")
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, F.concat(head, line).alias("t")))), lambda x: x["t"]), "\n").alias("source"))
    return r.codeowners(r.text_lines(text.select(F.lit("OWNERS").alias("path"), "source"))).select(F.col("ord").cast("int").alias("ord"), "pattern", "owners", "section")


@query("runtime_json", """WITH v AS (SELECT 'lib/v' || user_id || '.dart' AS path, event_type AS symbol, event_id % 6 AS n FROM events),
f AS (SELECT path, symbol, max(n) AS n FROM v GROUP BY 1, 2)
SELECT path, symbol, CAST(n AS BIGINT) AS invocations FROM f WHERE n > 0 UNION ALL SELECT path, symbol, CAST(n AS BIGINT) FROM f WHERE n > 0""")
def runtime_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls as V8 and as Istanbul documents."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u"), "event_type", (F.col("event_id") % 6).alias("n"))
    ranges = e.groupBy("u", "event_type").agg(F.transform(F.collect_list("n"), lambda n: F.struct(F.lit(0).alias("startOffset"), F.lit(9).alias("endOffset"), n.alias("count"))).alias("ranges"), F.max("n").alias("most"))
    v8 = ranges.groupBy("u").agg(F.collect_list(F.struct(F.col("event_type").alias("functionName"), "ranges")).alias("functions"))
    v8 = v8.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("package:app/v"), "u", F.lit(".dart")).alias("url"), "functions")).alias("result"))).alias("content"))
    entry = F.struct(F.concat(F.lit("lib/v"), "u", F.lit(".dart")).alias("path"), F.map_from_entries(F.collect_list(F.struct("event_type", F.col("most")))).alias("f"), F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(F.col("event_type").alias("name")).alias("m")))).alias("fnMap"))
    ist = ranges.groupBy("u").agg(entry.alias("e")).select(F.to_json(F.create_map(F.col("e.path"), F.struct("e.path", "e.f", "e.fnMap"))).alias("content"))
    docs = v8.unionByName(ist).withColumn("format", r.runtime_format(F.col("content")))
    calls = r.v8_coverage(docs.where("format = 'v8'")).unionByName(r.istanbul_coverage(docs.where("format = 'istanbul'")))
    return calls.select("path", "symbol", "invocations")


@query("runtime_paths", """SELECT page_id, 'package:app/' || page_id || '%20x.dart' AS url, 'lib/' || page_id || ' x.dart' AS path FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'http://h/lib/' || page_id || '.dart', 'lib/' || page_id || '.dart' FROM pages WHERE page_id % 2 = 1""")
def runtime_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("package:app/"), k, F.lit("%20x.dart"))).otherwise(F.concat(F.lit("http://h/lib/"), k, F.lit(".dart")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url")).withColumn("path", r.runtime_path(F.col("url")))


@query("step_program", "SELECT path, score FROM (WITH z AS (SELECT 'lib/p' || (o_custkey % 97) || '/c' || o_custkey || '.dart' AS path, count(*) AS score FROM orders GROUP BY 1) SELECT path, score FROM z WHERE score = 7 AND path LIKE 'lib/p1/%')")
def step_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed program: a call, a selection over its rows, a projection."""
    def files(prefix: str) -> DataFrame:
        c = F.col("o_custkey")
        path = F.concat(F.lit("lib/p"), (c % 97).cast("string"), F.lit("/c"), c.cast("string"), F.lit(".dart"))
        return table(spark, sf_dir, "orders").groupBy(path.alias("path")).agg(F.count("*").alias("score"), F.lit("x").alias("unused")).where(F.col("path").startswith(prefix))

    return program.run({"steps": [{"id": "a", "call": "files", "arguments": {"prefix": "lib/p1/"}}, {"id": "b", "select": {"from": "a", "where": {"equals": {"score": 7}}, "fields": ["path", "score"]}}], "return": "b"}, {"files": files})


