"""Symbol and route queries: parts are declarations, order lines are references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators import symbols as y
from graphloom.plans.registry import query
from graphloom.session import table

_REF = """r AS (SELECT l_partkey AS name, l_returnflag AS qualifier, l_suppkey % 10 AS library, 'o' || (l_orderkey % 300) AS path FROM lineitem),
x AS (SELECT DISTINCT 'o' || (o_orderkey % 300) AS path FROM orders WHERE o_orderkey % 300 < 12)"""


def references_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("qualifier"), (F.col("l_suppkey") % 10).alias("library"), F.concat(F.lit("o"), (F.col("l_orderkey") % 300).cast("string")).alias("path"))


def reachable_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey") % 300
    return table(spark, sf_dir, "orders").where(o < 12).select(F.concat(F.lit("o"), o.cast("string")).alias("path")).distinct()


def _counts(keys: str) -> str:
    return f"WITH {_REF} SELECT {keys}, count(*) AS n_references FROM r WHERE path IN (SELECT path FROM x) GROUP BY {keys}"


@query("reference_counts", _counts("name"))
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.reference_counts(references_of(spark, sf_dir), reachable_of(spark, sf_dir), ["name"])


@query("qualified_reference_counts", _counts("qualifier, name"))
def qualified_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.reference_counts(references_of(spark, sf_dir), reachable_of(spark, sf_dir), ["qualifier", "name"])


@query("library_reference_counts", _counts("library, name"))
def library_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.reference_counts(references_of(spark, sf_dir), reachable_of(spark, sf_dir), ["library", "name"])


@query("unused_exports", f"WITH {_REF} SELECT p_partkey AS name, p_name FROM part WHERE p_partkey NOT IN (SELECT name FROM r WHERE path IN (SELECT path FROM x)) AND p_name NOT LIKE '\\_%' ESCAPE '\\'")
def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_name").where(~y.is_private(F.col("p_name")))
    return y.unreferenced(declared, reference_counts(spark, sf_dir), ["name"])


@query("unused_members", f"""WITH {_REF}, k AS (SELECT DISTINCT name, qualifier FROM r WHERE path IN (SELECT path FROM x)), m AS (SELECT p_partkey AS name, q AS qualifier, p_size FROM part, (VALUES ('A'), ('N'), ('R')) t(q))
SELECT name, qualifier FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = m.name AND (k.qualifier = m.qualifier OR (m.p_size <= 5 AND k.qualifier = 'N')))""")
def unused_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without a qualified reference; of some owners, a general one (such as ``.values``) counts for all."""
    counts = qualified_reference_counts(spark, sf_dir)
    kinds = spark.sql("SELECT * FROM (VALUES ('A'), ('N'), ('R')) AS t(qualifier)")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_size")
    members = part.crossJoin(F.broadcast(kinds))
    every = counts.where("qualifier = 'N'").select("name").join(part.where("p_size <= 5").select("name"), "name", "left_semi")
    return y.unreferenced(members, counts, ["name", "qualifier"]).join(every, "name", "left_anti").select("name", "qualifier")


@query("duplicate_exports", "SELECT p_brand AS entry, p_type AS name, count(DISTINCT p_size) AS n_members, list_sort(list(DISTINCT p_size)) AS members FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def duplicate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entry"), F.col("p_type").alias("name"), "p_size", "p_partkey")
    return y.duplicates(rows, ["entry", "name"], "p_size", ["p_partkey"])


_ROUTE = """regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://[^/]*', '')"""
_KEY = """CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END"""


@query("route_collisions", f"""WITH a AS (SELECT page_id, rtrim(replace(regexp_replace({_ROUTE}, '[0-9]+', ':id', 'g'), '//', '/'), '/') AS p FROM pages),
k AS (SELECT page_id, array_to_string(list_transform(string_split({_KEY}, '/'), lambda s: CASE WHEN starts_with(s, ':') THEN ':' ELSE s END), '/') AS route FROM a)
SELECT route, count(*) AS n_routes, min(page_id) AS first_page FROM k GROUP BY route HAVING count(*) > 1""")
def route_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^https?://[^/]*", "")
    routes = table(spark, sf_dir, "pages").select("page_id", s.route_key(F.regexp_replace(bare, "[0-9]+", ":id")).alias("route"))
    return y.collisions(routes, ["route"], ["page_id"]).select("route", "n_routes", F.element_at("routes", 1)["page_id"].alias("first_page"))


@query("type_couplings", f"""WITH {_REF}, d AS (SELECT p_partkey % 200 AS name, p_partkey AS declared FROM part WHERE p_size < 10), u AS (SELECT name, count(*) AS n, min(declared) AS declared FROM d GROUP BY name HAVING count(*) = 1)
SELECT r.path, u.declared, count(*) AS n FROM r JOIN u ON r.name % 200 = u.name GROUP BY ALL""")
def type_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by a name that is declared exactly once."""
    d = table(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") % 200).alias("name"), F.col("p_partkey").alias("declared"))
    refs = references_of(spark, sf_dir).withColumn("name", F.col("name") % 200)
    return y.unique_targets(refs, d, ["name"], "declared").groupBy("path", "declared").agg(F.count("*").alias("n"))


@query("private_type_leaks", f"""WITH {_REF}, p AS (SELECT p_partkey AS name, p_size % 10 AS library FROM part WHERE p_size > 25), e AS (SELECT DISTINCT path FROM r WHERE path IN (SELECT path FROM x))
SELECT DISTINCT r.path, r.name, r.library FROM r JOIN p ON p.name = r.name AND p.library = r.library WHERE r.path IN (SELECT path FROM e)""")
def private_type_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of exported files that name a private type of their library."""
    private = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 10).cast("bigint").alias("library"))
    refs = references_of(spark, sf_dir).select("path", "name", "library").distinct()
    return refs.join(private, ["name", "library"], "left_semi").join(reachable_of(spark, sf_dir), "path", "left_semi").select("path", "name", "library")


@query("simple_deletions", "SELECT o_custkey AS path, o_orderkey AS name FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderkey % 7) AS n FROM orders) WHERE n = 1 AND o_orderkey % 7 = (o_orderkey + o_custkey % 2) % 7")
def simple_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), k.alias("name"), (k % 7).alias("start_line"), ((k + F.col("o_custkey") % 2) % 7).alias("end_line"))
    return y.alone_on_line(rows).select("path", "name")


@query("first_members", "SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def first_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.graph import first_in_order

    rows = first_in_order(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return rows.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")


@query("conditional_imports", """WITH b AS (SELECT o_custkey AS path, o_orderkey % 4 AS line, 0 AS col, o_orderkey AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'io' ELSE 'js' END AS variable, CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END AS expected FROM orders),
k AS (SELECT *, CASE WHEN variable IS NULL THEN 1 WHEN CASE variable WHEN 'io' THEN 'true' ELSE 'false' END = expected THEN 0 END AS rank FROM b)
SELECT path, line, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY path, line, col ORDER BY rank NULLS LAST, ordinal) AS r FROM k) WHERE r = 1 AND rank IS NOT NULL""")
def conditional_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (k % 4).alias("line"), F.lit(0).alias("col"), k.alias("ordinal"), F.when(k % 3 == 1, "io").when(k % 3 == 2, "js").alias("variable"), F.when(k % 5 == 0, "true").otherwise("false").alias("expected"))
    return y.selected_branches(b, spark.createDataFrame([("io", "true")], "variable string, value string")).select("path", "line", "ordinal")


@query("annotation_windows", """SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS window_md5 FROM conversations""")
def annotation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text")
    return y.lookback(lines, 2).select(F.col("path").alias("conv_id"), F.col("line").alias("turn"), F.md5("window").alias("window_md5"))


@query("sections_last_value", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def sections_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return y.sections(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")))


@query("scoped_resolution", """WITH c AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 2 END AS target, o_orderkey % 9 <> 0 AS complete FROM orders),
g AS (SELECT k, count(DISTINCT target) AS n, min(target) AS target, bool_and(complete) AS complete FROM c GROUP BY k)
SELECT k, CASE WHEN n = 1 THEN 'found' WHEN n = 0 AND complete THEN 'absent' ELSE 'unknown' END AS state, CASE WHEN n = 1 THEN target END AS target FROM g""")
def scoped_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(o % 4 != 0, o % 2).alias("target"), (o % 9 != 0).alias("complete"))
    return y.resolution(c, ["k"], "target")


_COMB = "[{'kind': CASE WHEN k % 3 = 0 THEN 'hide' ELSE 'show' END, 'names': [CAST(k % 2 AS VARCHAR), 'n' || (k % 5)]}, {'kind': CASE WHEN k % 5 = 0 THEN 'hide' ELSE 'show' END, 'names': ['n' || (k % 3)]}]"


@query("combinator_visibility", f"""WITH v AS (SELECT p_partkey AS k, 'n' || (p_partkey % 4) AS name, CASE WHEN p_partkey % 7 = 0 THEN 'p' END AS prefix FROM part),
c AS (SELECT *, {_COMB} AS combs FROM v),
t AS (SELECT *, list_contains(combs[1].names, name) AS a, list_contains(combs[2].names, name) AS b, combs[1].kind = 'show' AS s1, combs[2].kind = 'show' AS s2 FROM c)
SELECT k, CASE WHEN s2 THEN b ELSE (CASE WHEN s1 THEN a ELSE NOT a END) AND NOT b END AS last_wins, (a = s1) AND (b = s2) AS all_hold, prefix IS NULL AND (a = s1) AND (b = s2) AS extension FROM t""")
def combinator_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three readings of show and hide, side by side."""
    k = F.col("k")
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumns({"name": F.concat(F.lit("n"), (k % 4).cast("string")), "prefix": F.when(k % 7 == 0, "p")})
    n = lambda m: F.concat(F.lit("n"), (k % m).cast("string"))
    comb = lambda m, names: F.struct(F.when(k % m == 0, "hide").otherwise("show").alias("kind"), names.alias("names"))
    c = v.withColumn("combs", F.array(comb(3, F.array((k % 2).cast("string"), n(5))), comb(5, F.array(n(3)))))
    name, combs = F.col("name"), F.col("combs")
    return c.select("k", s.visible_last_show_wins(name, combs).alias("last_wins"), s.visible_all(name, combs).alias("all_hold"), s.extension_visible(name, combs, F.col("prefix")).alias("extension"))
