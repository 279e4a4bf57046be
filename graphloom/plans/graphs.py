"""Graph queries over the part graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.plans.bindings import GRAPH, entry_parts, part_graph
from graphloom.plans.registry import query
from graphloom.session import cut, table

_REACH = f"""WITH RECURSIVE {GRAPH},
r AS (SELECT p_partkey AS node FROM part WHERE p_size <= 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"""
_DEPTH = f"""WITH RECURSIVE {GRAPH},
d AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size <= 3 UNION SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 40),
s AS (SELECT node, min(depth) AS depth FROM d GROUP BY node)"""
_PAIRS = f"""WITH RECURSIVE {GRAPH},
t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst),
m AS (SELECT x.src AS node, least(x.src, min(x.dst)) AS component FROM t x JOIN t y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src)"""


@query("reachability", f"{_REACH} SELECT p_partkey, p_partkey IN (SELECT node FROM r) AS reachable FROM part")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = g.reachable(part_graph(spark, sf_dir), entry_parts(spark, sf_dir)).select(F.col("node").alias("p_partkey"), F.lit(True).alias("reachable"))
    return table(spark, sf_dir, "part").select("p_partkey").join(reached.hint("shuffle_hash"), "p_partkey", "left").fillna({"reachable": False})


@query("dead_nodes", f"{_REACH} SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = g.reachable(part_graph(spark, sf_dir), entry_parts(spark, sf_dir))
    return g.dead(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), reached, "p_partkey")


@query(
    "missing_entries",
    "SELECT DISTINCT p_size * 1000003 AS entry FROM part WHERE p_size <= 3 AND p_size * 1000003 NOT IN (SELECT p_partkey FROM part)",
)
def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entries = part.where("p_size <= 3").select((F.col("p_size") * 1000003).alias("entry")).distinct()
    return entries.join(part, F.col("entry") == F.col("p_partkey"), "left_anti")


@query(
    "reachability_both_ways",
    f"""WITH RECURSIVE {GRAPH},
k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE (src + dst) % 7 = 0),
r AS (SELECT p_partkey AS node FROM part WHERE p_size <= 3 UNION SELECT k.dst FROM r JOIN k ON k.src = r.node)
SELECT node FROM r""",
)
def reachability_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one kind are followed backwards too."""
    edges = part_graph(spark, sf_dir).withColumn("kind", F.when((F.col("src") + F.col("dst")) % 7 == 0, "augment").otherwise("import"))
    return g.reachable(g.with_reversed(edges, "kind", "augment"), entry_parts(spark, sf_dir)).select("node")


@query(
    "one_hop_scope",
    f"""WITH {GRAPH}, c AS (SELECT p_partkey AS node FROM part WHERE p_size = 1)
SELECT node FROM c UNION SELECT dst FROM e WHERE src IN (SELECT node FROM c) UNION SELECT src FROM e WHERE dst IN (SELECT node FROM c)""",
)
def one_hop_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.neighbourhood(part_graph(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey"))


@query("callers", f"WITH {GRAPH} SELECT dst AS node, count(DISTINCT src) AS n_callers, list_sort(list(DISTINCT src)) AS callers FROM e GROUP BY dst")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.callers(part_graph(spark, sf_dir))


@query("scc_cycles", f"{_PAIRS} SELECT node, component FROM m")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cycles(part_graph(spark, sf_dir), self_loops=False)


@query("self_loops", f"WITH {GRAPH} SELECT src AS node FROM e WHERE src = dst")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).where("src = dst").select(F.col("src").alias("node"))


@query(
    "re_export_cycles",
    f"""WITH RECURSIVE {GRAPH}, x AS (SELECT * FROM e WHERE (src * 31 + dst) % 10 < 8),
t AS (SELECT src, dst FROM x UNION SELECT t.src, x.dst FROM t JOIN x ON x.src = t.dst),
m AS (SELECT x.src AS node, least(x.src, min(x.dst)) AS component FROM t x JOIN t y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src)
SELECT component, list_sort(list(node)) AS members, count(*) AS n_members FROM m GROUP BY component""",
)
def re_export_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles over the edges of one kind alone, with their members."""
    exports = part_graph(spark, sf_dir).where((F.col("src") * 31 + F.col("dst")) % 10 < 8)
    return g.cycles(exports).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("n_members"))


_PACKAGES = """d AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey),
i AS (SELECT DISTINCT src, dst FROM d WHERE (src * 7 + dst) % 5 < 2 AND src <> dst)"""


@query(
    "package_cycles",
    f"""WITH RECURSIVE {_PACKAGES},
t AS (SELECT src, dst FROM i UNION SELECT t.src, i.dst FROM t JOIN i ON i.src = t.dst)
SELECT x.src AS node, least(x.src, min(x.dst)) AS component FROM t x JOIN t y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src""",
)
def package_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared dependencies that are also imported, merged; cycles of several packages."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    declared = (
        lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    )
    used = declared.where((F.col("src") * 7 + F.col("dst")) % 5 < 2)
    return g.cycles(used, self_loops=False)


@query("shortest_path_depth", f"{_DEPTH} SELECT s.node, CAST(s.depth AS BIGINT) AS depth, min(p.node) AS parent FROM s LEFT JOIN (e JOIN s p ON p.node = e.src) ON e.dst = s.node AND s.depth = p.depth + 1 GROUP BY s.node, s.depth")
def shortest_path_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.shortest_paths(part_graph(spark, sf_dir), entry_parts(spark, sf_dir))


@query(
    "chains_depth8",
    f"""WITH RECURSIVE {GRAPH},
c AS (SELECT p_partkey AS tip, [p_partkey] AS path, true AS visible, 0 AS hops FROM part WHERE p_size = 1
  UNION ALL SELECT e.dst, list_append(c.path, e.dst), c.visible AND (e.src + e.dst) % 3 <> 0, c.hops + 1 FROM c JOIN e ON e.src = c.tip WHERE c.hops < 8 AND NOT list_contains(c.path, e.dst))
SELECT path, CAST(hops AS BIGINT) AS hops, visible FROM c WHERE hops > 0""",
)
def chains_depth8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All re-export chains of up to eight hops, with what every hop lets through."""
    edges = part_graph(spark, sf_dir).withColumn("visible", (F.col("src") + F.col("dst")) % 3 != 0)
    return g.chains(edges, table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey"), 8)


@query(
    "owner_roots",
    """WITH RECURSIVE u AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE p_partkey - p_partkey % 5 END AS up FROM part),
v AS (SELECT node, CASE WHEN up % 25 = 0 OR up <> node THEN up ELSE up - up % 25 END AS up FROM u),
w AS (SELECT v.node, v.up FROM v WHERE v.up IN (SELECT p_partkey FROM part)),
c AS (SELECT node, node AS owner, 0 AS k FROM v UNION ALL SELECT c.node, w.up, c.k + 1 FROM c JOIN w ON w.node = c.owner AND w.up <> c.owner WHERE c.k < 10)
SELECT node AS p_partkey, arg_max(owner, k) AS owner FROM c GROUP BY node""",
)
def owner_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owning library by climbing part-of edges."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    up = F.when(k % 5 != 0, k - k % 5).when(k % 25 != 0, k - k % 25).otherwise(k)
    edges = part.select(k.alias("dst"), up.alias("src")).where("src != dst")
    edges = edges.join(part.select(k.alias("src")), "src", "left_semi")
    return g.climb(edges, part, "p_partkey")


_SUPERS = """h AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, false AS duty FROM part WHERE p_partkey > 1
  UNION ALL SELECT p_partkey, p_partkey // 3, true FROM part WHERE p_partkey > 2)"""


def supers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class hierarchy over all of part: each extends one class and implements one interface (duty)."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    extends = part.where("p_partkey > 1").select(k.alias("src"), F.shiftright(k, 1).alias("dst"), F.lit(False).alias("duty"))
    implements = part.where("p_partkey > 2").select(k.alias("src"), F.expr("p_partkey div 3").alias("dst"), F.lit(True).alias("duty"))
    return extends.unionByName(implements)


@query(
    "duty_closure",
    f"""WITH RECURSIVE {_SUPERS},
t AS (SELECT src, dst, duty FROM h UNION SELECT t.src, h.dst, t.duty OR h.duty FROM t JOIN h ON h.src = t.dst)
SELECT src, dst, bool_or(duty) AS duty FROM t GROUP BY src, dst""",
)
def duty_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive supertypes; the duty holds from any implements on, whatever comes before or after it."""
    return g.flagged_closure(supers(spark, sf_dir), "duty", any_hop=True)


@query(
    "newly_reachable",
    f"""WITH RECURSIVE {GRAPH},
r AS (SELECT p_partkey AS node FROM part WHERE p_size <= 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node),
d AS (SELECT p_partkey AS node FROM part WHERE p_size BETWEEN 10 AND 12 UNION SELECT e.dst FROM d JOIN e ON e.src = d.node)
SELECT node FROM r INTERSECT SELECT node FROM d""",
)
def newly_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entry points reach and changed nodes lead to."""
    edges, part = cut(part_graph(spark, sf_dir)), table(spark, sf_dir, "part")
    changed = g.reachable(edges, part.where("p_size BETWEEN 10 AND 12").select("p_partkey")).select("node")
    return g.reachable(edges, entry_parts(spark, sf_dir)).select("node").intersect(changed)


@query(
    "render_counts",
    f"""WITH RECURSIVE {_SUPERS}, x AS (SELECT src, dst FROM h WHERE NOT duty),
t AS (SELECT src, dst FROM x UNION SELECT t.src, x.dst FROM t JOIN x ON x.src = t.dst),
u AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
a AS (SELECT k AS node, n FROM u UNION ALL SELECT t.dst, u.n FROM u JOIN t ON t.src = u.k)
SELECT p_partkey, CAST(coalesce(sum(n), 0) AS BIGINT) AS renders FROM part LEFT JOIN a ON a.node = p_partkey GROUP BY p_partkey""",
)
def render_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct uses of a class, and those of the classes below it."""
    uses = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n"))
    passed = g.passed_on(supers(spark, sf_dir).where("NOT duty"), uses, "node", "n").withColumnRenamed("total", "n")
    total = uses.unionByName(passed).groupBy("node").agg(F.sum("n").alias("renders"))
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.join(total, F.col("p_partkey") == F.col("node"), "left").select("p_partkey", F.coalesce("renders", F.lit(0).cast("bigint")).alias("renders"))
