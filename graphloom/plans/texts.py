"""Text queries: flags, secrets, transport, scalar functions, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators import inventory as v
from graphloom.plans.registry import query
from graphloom.session import table

_L = "l AS (SELECT 'd/' || doc_id AS path, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"))


@query("flag_inventory", f"""WITH {_L}, o AS (SELECT path, line, unnest(regexp_extract_all(text, '\\b(License|Copyright|Version)\\b', 1)) AS name FROM l WHERE regexp_matches(text, '\\b(License|Copyright|Version)\\b')),
c AS (SELECT *, CASE WHEN name = 'License' AND line > 1 THEN 3 WHEN name = 'Version' THEN 2 ELSE 1 END AS r FROM o)
SELECT name, CASE max(r) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, count(DISTINCT (path, line)) AS n_occurrences, min({{'p': path, 'l': line}}).p AS path, min({{'p': path, 'l': line}}).l AS line FROM c GROUP BY name""")
def flag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.occurrences(files_of(spark, sf_dir), r"\b(License|Copyright|Version)\b")
    conf = F.when((F.col("name") == "License") & (F.col("line") > 1), "high").when(F.col("name") == "Version", "medium").otherwise("low")
    return v.grouped(o.withColumn("confidence", conf), ["name"])


_SHAPE = "CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'pem' WHEN regexp_matches(text, '(?i)bearer [A-Za-z0-9._-]{8,}') THEN 'bearer' WHEN regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{20,}') THEN 'forge-token' WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+') THEN 'signed-token' WHEN regexp_matches(text, '[0-9a-fA-F]{32,}') THEN 'hex' END"


@query("secret_lines", f"""WITH {_L}, h AS (SELECT *, {_SHAPE} AS shape FROM l)
SELECT path, line, shape, md5(regexp_replace(regexp_replace(text, '"[^"]*"', '"***"', 'g'), '''[^'']*''', '''***''', 'g')) AS redacted_md5 FROM h WHERE shape IS NOT NULL""")
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.secrets(files_of(spark, sf_dir)).select("path", "line", "shape", F.md5("redacted").alias("redacted_md5"))


@query("security_inventory", """WITH u AS (SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'insecure-transport' WHEN contains(url, 'ref=') THEN 'tracking' END AS category, split_part(split_part(url, '//', 2), '/', 1) AS sink FROM pages)
SELECT category, sink, CASE category WHEN 'insecure-transport' THEN 'high' ELSE 'low' END AS confidence, count(DISTINCT page_id) AS n_occurrences, min(page_id) AS line FROM u WHERE category IS NOT NULL GROUP BY 1, 2""")
def security_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    cat = F.when(url.startswith("http://"), "insecure-transport").when(url.contains("ref="), "tracking")
    rows = table(spark, sf_dir, "pages").select(F.lit("pages").alias("path"), F.col("page_id").alias("line"), cat.alias("category"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("sink")).where("category IS NOT NULL")
    rows = rows.withColumn("confidence", F.when(F.col("category") == "insecure-transport", "high").otherwise("low"))
    return v.grouped(rows, ["category", "sink"]).drop("path")


@query("attack_surface", """WITH u AS (SELECT split_part(split_part(url, '//', 2), '/', 1) AS sink, page_id FROM pages WHERE starts_with(url, 'http://'))
SELECT sink, page_id, row_number() OVER (PARTITION BY sink ORDER BY page_id) AS nth FROM u""")
def attack_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a category, one row each, numbered within their sink."""
    u = table(spark, sf_dir, "pages").where(F.col("url").startswith("http://")).select(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("sink"), "page_id")
    return u.withColumn("nth", F.row_number().over(Window.partitionBy("sink").orderBy("page_id")).cast("bigint"))


@query("route_paths", "SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS route FROM (SELECT page_id, rtrim(replace(url, '//', '/'), '/') AS p FROM pages)")
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.route_path(F.col("url")).alias("route"))


@query("package_uris", """WITH u AS (SELECT p_partkey, 'package:' || lower(replace(p_brand, '#', '_')) || CASE WHEN p_size % 3 = 0 THEN '/src/' ELSE '/' END || p_size || '.dart' AS uri FROM part)
SELECT p_partkey, uri, split_part(substr(uri, 9), '/', 1) AS package, contains(uri, '/src/') AS private_src, regexp_full_match(split_part(substr(uri, 9), '/', 1), '[a-z_][a-z0-9_]*') AS valid FROM u""")
def package_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    uri = F.concat(F.lit("package:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.when(F.col("p_size") % 3 == 0, "/src/").otherwise("/"), F.col("p_size").cast("string"), F.lit(".dart"))
    u = p.select("p_partkey", uri.alias("uri")).withColumn("package", s.package_of(F.col("uri")))
    return u.withColumns({"private_src": s.imports_private_src(F.col("uri")), "valid": s.is_package_name(F.col("package"))})


@query("zones", """WITH p AS (SELECT p_partkey, 'lib/' || CASE p_size % 7 WHEN 0 THEN 'core' WHEN 1 THEN 'data' WHEN 2 THEN 'domain' WHEN 3 THEN 'presentation' WHEN 4 THEN 'ui' ELSE 'misc' END || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'ui/' ELSE '' END || 'a.dart' AS path FROM part)
SELECT p_partkey, path, CASE WHEN split_part(path, '/', 2) <> 'misc' THEN split_part(path, '/', 2) WHEN p_partkey % 2 = 0 THEN 'ui' END AS zone FROM p""")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 7
    top = F.when(k == 0, "core").when(k == 1, "data").when(k == 2, "domain").when(k == 3, "presentation").when(k == 4, "ui").otherwise("misc")
    path = F.concat(F.lit("lib/"), top, F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, "ui/").otherwise(""), F.lit("a.dart"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("zone", s.zone(F.col("path")))


@query("line_positions", """WITH p AS (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS INT)) AS head FROM documents)
SELECT doc_id, CAST(len(string_split(head, chr(10))) AS BIGINT) AS line, CAST(strlen(string_split(head, chr(10))[-1]) AS BIGINT) AS col FROM p""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-based line and 0-based UTF-8 column of the middle of each text."""
    line, col = s.line_and_column(F.col("text"), s.div(F.length("text"), 2))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), col.alias("col"))


@query("impact_totals", "SELECT CAST(sum(event_id % 7) AS BIGINT) AS surfaced, CAST(sum(event_id % 5) AS BIGINT) AS resolved, arg_max(event_id % 7, event_id) - arg_min(event_id % 7, event_id) AS surfaced_delta, arg_max(event_id % 5, event_id) - arg_min(event_id % 5, event_id) AS resolved_delta FROM events")
def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a history, and last less first in its order."""
    i = F.col("event_id")
    delta = lambda c: F.max_by(c, i) - F.min_by(c, i)
    return table(spark, sf_dir, "events").agg(F.sum(i % 7).alias("surfaced"), F.sum(i % 5).alias("resolved"), delta(i % 7).alias("surfaced_delta"), delta(i % 5).alias("resolved_delta"))


@query("impact_projects", "SELECT user_id, count(*) AS runs, CAST(sum(event_id % 7) AS BIGINT) AS surfaced, CAST(sum(event_id % 5) AS BIGINT) AS resolved FROM events GROUP BY user_id ORDER BY surfaced DESC, resolved DESC, runs DESC, user_id LIMIT 20")
def impact_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.sum(i % 7).alias("surfaced"), F.sum(i % 5).alias("resolved"))
    return per.orderBy(F.desc("surfaced"), F.desc("resolved"), F.desc("runs"), "user_id").limit(20)


@query("file_inventory", """WITH d AS (SELECT o_custkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'part' ELSE 'declaration' END AS kind FROM orders)
SELECT path, count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'export') AS exports, count(*) FILTER (kind = 'part') AS parts, count(*) FILTER (kind = 'declaration') AS declarations FROM d GROUP BY path""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    n = lambda i: F.count_if(k == i)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(n(0).alias("imports"), n(1).alias("exports"), n(2).alias("parts"), n(3).alias("declarations"))


@query("dependency_usage", """WITH u AS (SELECT l_suppkey AS dep, o_custkey % 20 AS package, bool_or(l_returnflag = 'R') AS production, bool_or(l_returnflag <> 'R') AS development FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
d AS (SELECT s_suppkey AS dep, s_suppkey % 20 AS package, CASE WHEN s_suppkey % 2 = 0 THEN 'dependencies' ELSE 'dev_dependencies' END AS section FROM supplier)
SELECT d.dep, d.package, section, CASE WHEN u.dep IS NULL AND section = 'dependencies' THEN 'unused-dependency' WHEN u.dep IS NULL THEN 'unused-dev-dependency' WHEN section = 'dev_dependencies' AND production THEN 'dev-dependency-in-production' WHEN section = 'dependencies' AND NOT production THEN 'test-only-dependency' ELSE 'ok' END AS issue
FROM d LEFT JOIN u ON u.dep = d.dep AND u.package = d.package""")
def dependency_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared dependencies against their use in production and development."""
    from graphloom.operators.dependencies import issue, usage

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    used = usage(rows.select(F.col("l_suppkey").alias("dep"), (F.col("o_custkey") % 20).alias("package"), (F.col("l_returnflag") == "R").alias("in_production")))
    k = F.col("s_suppkey")
    declared = table(spark, sf_dir, "supplier").select(k.alias("dep"), (k % 20).alias("package"), F.when(k % 2 == 0, "dependencies").otherwise("dev_dependencies").alias("section"))
    return issue(declared, used).select("dep", "package", "section", "issue")


@query("unlisted_dependencies", """WITH u AS (SELECT l_suppkey AS dep, o_custkey % 20 AS package, o_orderkey AS path, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT dep, package, min({'p': path, 'l': line}).p AS path FROM u WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = dep AND s_suppkey % 20 = package) GROUP BY 1, 2""")
def unlisted_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first import of each package that isn't declared."""
    from graphloom.operators.dependencies import unlisted

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    imports = rows.select(F.col("l_suppkey").alias("dep"), (F.col("o_custkey") % 20).alias("package"), F.col("o_orderkey").alias("path"), F.col("l_linenumber").alias("line"))
    declared = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dep"), (F.col("s_suppkey") % 20).alias("package"))
    return unlisted(imports, declared).select("dep", "package", "path")
