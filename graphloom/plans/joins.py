"""Join queries: prefixes, priorities, ranges, nearest values, ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators import joins as j
from graphloom.plans.registry import query
from graphloom.session import table

_PATH = "regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', '')"
_PATHS = f"u AS (SELECT page_id, {_PATH} AS path FROM pages)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))


@query("longest_prefix_owner", f"""WITH {_PATHS}, r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM u UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM u WHERE page_id % 3 = 0 UNION SELECT ''),
m AS (SELECT page_id, arg_max(root, length(root)) AS root FROM u JOIN r ON root = '' OR path = root OR starts_with(path, root || '/') GROUP BY page_id)
SELECT u.page_id, u.path, m.root FROM u LEFT JOIN m ON m.page_id = u.page_id""")
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _paths(spark, sf_dir)
    host, top = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))
    roots = u.select(host.alias("root")).union(u.where("page_id % 3 = 0").select(F.concat(host, F.lit("/"), top))).union(spark.sql("SELECT ''")).distinct()
    return j.longest_prefix(u, "path", roots, "root")


@query("prioritized_lookup", """WITH a AS (SELECT o_orderkey, 0 AS priority, o_custkey AS owner FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT o_orderkey, 1 AS priority, min(l_suppkey) AS owner FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 GROUP BY 1),
c AS (SELECT o_orderkey, 2 AS priority, CAST(-1 AS BIGINT) AS owner FROM orders),
x AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT o_orderkey, CAST(min(priority) AS BIGINT) AS priority, arg_min(owner, priority) AS owner FROM x GROUP BY 1""")
def prioritized_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own entry first, then the configured, then the fallback."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_custkey").alias("owner"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("owner"))
    conf = lines.join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    rest = o.select("o_orderkey", F.lit(-1).cast("bigint").alias("owner"))
    return j.prioritised([own, conf, rest], ["o_orderkey"], ["owner"])


@query("range_containment", """WITH f AS (SELECT o_custkey, o_orderkey, o_orderkey % 500 AS lo, o_orderkey % 500 + 60 AS hi FROM orders),
e AS (SELECT event_id, user_id, event_id % 560 AS line FROM events)
SELECT e.event_id, count(f.o_orderkey) AS n_functions, min(f.o_orderkey) AS first_function FROM e LEFT JOIN f ON f.o_custkey = e.user_id AND e.line BETWEEN f.lo AND f.hi GROUP BY e.event_id""")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that span each observation: equality on the file, then the range."""
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (k % 500).alias("lo"), (k % 500 + 60).alias("hi"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 560).alias("line"))
    met = e.join(f, (F.col("o_custkey") == F.col("user_id")) & F.col("line").between(F.col("lo"), F.col("hi")), "left")
    return met.groupBy("event_id").agg(F.count("o_orderkey").alias("n_functions"), F.min("o_orderkey").alias("first_function"))


_EDGE = """d AS (SELECT DISTINCT 'lib/' || p_brand || '/' || p_size AS src, 'lib/' || p_type || '/' || p_brand AS dst FROM part),
r AS (SELECT DISTINCT 'lib/' || p_brand AS rule_from, 'lib/' || p_type AS rule_disallow FROM part WHERE p_partkey <= 20)"""


def _edge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    lib, sep = F.lit("lib/"), F.lit("/")
    edges = p.select(F.concat(lib, "p_brand", sep, F.col("p_size").cast("string")).alias("src"), F.concat(lib, "p_type", sep, "p_brand").alias("dst")).distinct()
    rules = p.where("p_partkey <= 20").select(F.concat(lib, "p_brand").alias("rule_from"), F.concat(lib, "p_type").alias("rule_disallow")).distinct()
    return edges, rules


@query("boundary_violations", f"WITH {_EDGE} SELECT src, dst, rule_from, rule_disallow FROM d JOIN r ON starts_with(src || '/', rule_from || '/') AND starts_with(dst || '/', rule_disallow || '/')")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.prefix_rules(*_edge(spark, sf_dir))


@query("boundary_inventory", f"""WITH {_EDGE}, z AS (SELECT DISTINCT rule_from AS zone FROM r)
SELECT zone, count(d.src) AS n_files FROM z LEFT JOIN (SELECT DISTINCT src FROM d) d ON starts_with(d.src || '/', zone || '/') GROUP BY zone""")
def boundary_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, rules = _edge(spark, sf_dir)
    files = edges.select("src").distinct()
    owned = j.longest_prefix(files, "src", rules.select(F.col("rule_from").alias("zone")).distinct(), "zone")
    return rules.select(F.col("rule_from").alias("zone")).distinct().join(owned, "zone", "left").groupBy("zone").agg(F.count("src").alias("n_files"))


@query("boundary_coverage", f"WITH {_EDGE} SELECT DISTINCT src AS path FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(src || '/', rule_from || '/'))")
def boundary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no zone covers."""
    edges, rules = _edge(spark, sf_dir)
    owned = j.longest_prefix(edges.select("src").distinct(), "src", rules.select(F.col("rule_from").alias("zone")).distinct(), "zone")
    return owned.where("zone IS NULL").select(F.col("src").alias("path"))


@query("nearest_token", """WITH t AS (SELECT min(p_name || '#' || p_partkey) AS token, p_retailprice AS v FROM part WHERE p_partkey % 10 = 0 GROUP BY 2),
r AS (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 10 <> 0)
SELECT p_partkey, x, arg_min(token, (abs(x - v), token)) AS token, min(abs(x - v)) AS distance FROM r, t GROUP BY p_partkey, x""")
def nearest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tokens = p.where("p_partkey % 10 = 0").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("token"), F.col("p_retailprice").alias("v"))
    rows = p.where("p_partkey % 10 != 0").select("p_partkey", F.col("p_retailprice").alias("x"))
    return j.nearest(rows, "p_partkey", "x", tokens, "token", "v")


@query("near_duplicate_pairs", """WITH v AS (SELECT p_partkey AS k, CAST(floor(p_retailprice * 10) AS BIGINT) AS x FROM part)
SELECT a.k AS left_key, b.k AS right_key, (a.x - b.x) * (a.x - b.x) AS distance2 FROM v a JOIN v b ON a.k < b.k AND (a.x - b.x) * (a.x - b.x) BETWEEN 1 AND 4""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_retailprice") * 10).cast("bigint").alias("x"))
    return j.near_pairs(v, "k", "x", 4)


_COLOURS = """c AS (SELECT p_partkey AS k, (p_partkey * 2654435761) % 4294967296 AS argb FROM part)"""


@query("argb_distance", f"""WITH {_COLOURS}, d AS (SELECT a.k, a.argb, b.argb AS other FROM c a JOIN c b ON b.k = a.k + 1)
SELECT k, CAST(pow((argb >> 24 & 255) - (other >> 24 & 255), 2) + pow((argb >> 16 & 255) - (other >> 16 & 255), 2) + pow((argb >> 8 & 255) - (other >> 8 & 255), 2) + pow((argb & 255) - (other & 255), 2) AS BIGINT) AS distance2 FROM d""")
def argb_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * F.lit(2654435761) % F.lit(4294967296)).alias("argb"))
    other = c.select((F.col("k") - 1).alias("k"), F.col("argb").alias("other"))
    return c.join(other, "k").select("k", s.argb_distance2(F.col("argb"), F.col("other")).alias("distance2"))


_OWN = "(VALUES (0, '*', 'all'), (1, 'AUTO*', 'cars'), (2, '*ING', 'makers'), (3, 'HOUSE*', 'home'), (4, 'M?CHINERY', 'tools'), (5, '*O*', 'os')) r(ord, pattern, owner)"
_OWN_RE = "(VALUES (0, '.*', '*', 'all'), (1, 'AUTO.*', 'AUTO*', 'cars'), (2, '.*ING', '*ING', 'makers'), (3, 'HOUSE.*', 'HOUSE*', 'home'), (4, 'M.CHINERY', 'M?CHINERY', 'tools'), (5, '.*O.*', '*O*', 'os')) r(ord, re, pattern, owner)"


def _owners(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT CAST(ord AS BIGINT) AS ord, pattern, owner FROM {_OWN.replace(' r(', ' AS r(')}")


@query("last_match_owner", f"""SELECT c_custkey, c_mktsegment, CAST(max(ord) AS BIGINT) AS ord, arg_max(pattern, ord) AS pattern, arg_max(owner, ord) AS owner
FROM customer LEFT JOIN {_OWN_RE} ON regexp_full_match(c_mktsegment, re) GROUP BY 1, 2""")
def last_match_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership patterns: the last one that matches wins."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return j.last_match(rows, _owners(spark), s.glob_match(F.col("c_mktsegment"), F.col("pattern")), ["c_custkey"], "ord")


@query("first_match_threshold", f"""SELECT c_custkey, c_mktsegment, CAST(min(ord) AS BIGINT) AS ord, arg_min(pattern, ord) AS pattern, arg_min(owner, ord) AS owner
FROM customer LEFT JOIN (SELECT * FROM {_OWN_RE} WHERE ord > 0) ON regexp_full_match(c_mktsegment, re) GROUP BY 1, 2""")
def first_match_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold overrides: the first one that matches wins."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return j.first_match(rows, _owners(spark).where("ord > 0"), s.glob_match(F.col("c_mktsegment"), F.col("pattern")), ["c_custkey"], "ord")


@query("override_status", f"""WITH m AS (SELECT ord, count(c_custkey) AS n, count(*) FILTER (c_acctbal > 5000) AS over FROM {_OWN_RE} LEFT JOIN customer ON regexp_full_match(c_mktsegment, re) GROUP BY ord)
SELECT CAST(ord AS BIGINT) AS ord, n AS n_matched, CASE WHEN n = 0 THEN 'no_match' WHEN over > 0 THEN 'active' ELSE 'stale' END AS status FROM m""")
def override_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each override: does it match anything, and does it still change a verdict."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    met = j.rules(_owners(spark)).join(c, s.glob_match(F.col("c_mktsegment"), F.col("pattern")), "left")
    per = met.groupBy("ord").agg(F.count("c_custkey").alias("n_matched"), F.count_if(F.col("c_acctbal") > 5000).alias("over"))
    return per.select("ord", "n_matched", F.when(F.col("n_matched") == 0, "no_match").when(F.col("over") > 0, "active").otherwise("stale").alias("status"))


@query("policy_hits", f"SELECT p_partkey, p_type, CAST(ord AS BIGINT) AS ord, pattern FROM part JOIN (VALUES (0, '.*BRASS', '*BRASS'), (1, 'PROMO.*', 'PROMO*'), (2, 'S.*N', 'S*N'), (3, 'ECONOMY.*', 'ECONOMY*')) r(ord, re, pattern) ON regexp_full_match(p_type, re)")
def policy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls against banned patterns: a row a matching pattern."""
    banned = spark.sql("SELECT CAST(ord AS BIGINT) AS ord, pattern FROM (VALUES (0, '*BRASS'), (1, 'PROMO*'), (2, 'S*N'), (3, 'ECONOMY*')) AS r(ord, pattern)")
    return j.pattern_hits(table(spark, sf_dir, "part").select("p_partkey", "p_type"), banned, "p_type", "pattern")


@query("edit_distance_top3", """WITH d AS (SELECT a.n_name AS name, b.n_name AS other, CASE WHEN contains(lower(b.n_name), lower(a.n_name)) THEN 0 ELSE levenshtein(lower(a.n_name), lower(b.n_name)) END AS d FROM nation a JOIN nation b ON a.n_name <> b.n_name),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, other) AS r FROM d WHERE d <= greatest(2, length(name) // 3))
SELECT name, other, CAST(d AS BIGINT) AS distance, r AS rank FROM k WHERE r <= 3""")
def edit_distance_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three similar names, nearest first: at most two edits or a third of the name away; one that contains it is at 0."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    a, b = F.lower("name"), F.lower("other")
    met = n.join(j.rules(n.withColumnRenamed("name", "other")), F.col("name") != F.col("other")).withColumn("distance", F.when(F.contains(b, a), 0).otherwise(F.levenshtein(a, b)).cast("bigint"))
    met = met.where(F.col("distance") <= F.greatest(F.lit(2), s.div(F.length("name"), 3)))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("distance", "other")).cast("bigint")).where("rank <= 3")
