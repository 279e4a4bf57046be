import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as g

MAIN = [("main", "a"), ("a", "b"), ("dead", "b")]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def depth_of(rows, seeds):
    seen, front, d = {s: 0 for s in seeds}, list(seeds), 0
    while front:
        d += 1
        front = [b for a, b in rows if a in front and b not in seen]
        seen |= {b: d for b in front}
    return seen


@pytest.mark.parametrize("small", [g.SMALL, 0])
def test_reachable_files(spark, small):
    got = g.reachable(edges(spark, MAIN), nodes(spark, "main"), small=small)
    assert {r.node: r.depth for r in got.collect()} == {"main": 0, "a": 1, "b": 2}
    gone = g.dead(nodes(spark, "main", "a", "b", "dead", "safe").withColumnRenamed("node", "path"), got, "path")
    assert sorted(r.path for r in gone.collect()) == ["dead", "safe"]


@pytest.mark.parametrize("small", [g.SMALL, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, small, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), rng.randrange(25)) for _ in range(38)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,), (3,)], "n bigint")
    assert {r.node: r.depth for r in g.reachable(e, seeds, small=small).collect()} == depth_of(rows, [0, 3])
    reach = {x: set(depth_of(rows, [x])) for x in range(25)}
    want = {}
    for x in range(25):
        same = {y for y in reach[x] if x in reach[y]}
        if len(same) > 1 or (x, x) in rows:
            want[x] = min(same)
    assert {r.node: r.component for r in g.cycles(e, small=small).collect()} == want


def test_part_edges_are_followed_back(spark):
    e = spark.createDataFrame([("lib", "part", "import"), ("part2", "lib", "augment")], "src string, dst string, kind string")
    got = g.reachable(g.with_reversed(e, "kind", "augment"), nodes(spark, "lib"))
    assert sorted(r.node for r in got.collect()) == ["lib", "part", "part2"]


def test_neighbourhood_and_callers(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")])
    assert sorted(r.node for r in g.neighbourhood(e, nodes(spark, "b")).collect()) == ["a", "b", "c"]
    got = {r.node: (r.n_callers, r.callers) for r in g.callers(e).collect()}
    assert got == {"b": (1, ["a"]), "c": (1, ["b"]), "d": (1, ["c"])}


def test_chains_stop_at_repeats_and_at_depth(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]).withColumn("visible", F.col("dst") != "c")
    got = sorted((r.path, r.visible) for r in g.chains(e, nodes(spark, "a"), 8).collect())
    assert got == [(["a", "b"], True), (["a", "b", "c"], False)]
    line = edges(spark, [(str(i), str(i + 1)) for i in range(12)])
    assert max(r.hops for r in g.chains(line, nodes(spark, "0"), 8).collect()) == 8


def test_shortest_path_takes_the_smallest_parent(spark):
    e = edges(spark, [("s", "z"), ("s", "b"), ("z", "t"), ("b", "t")])
    got = {r.node: r.parent for r in g.shortest_paths(e, nodes(spark, "s")).collect()}
    assert got == {"s": None, "z": "s", "b": "s", "t": "b"}


def test_climb(spark):
    e = spark.createDataFrame([("lib", "p1"), ("p1", "p2"), ("aaa", "p2"), ("lib", "lib")], "src string, dst string")
    got = {r.node: r.owner for r in g.climb(e, nodes(spark, "lib", "p1", "p2", "x"), "node").collect()}
    assert got == {"lib": "lib", "p1": "lib", "p2": "aaa", "x": "x"}


def test_climb_ends_before_a_cycle_repeats(spark):
    """Ways up: 1 to 2 to 3 to 1, and 9 to 8 to 2."""
    e = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (8, 9), (2, 8)], "src long, dst long")
    got = {r.node: r.owner for r in g.climb(e, spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "node long"), "node").collect()}
    assert got == {1: 3, 2: 1, 3: 2, 9: 1}


def test_large_ids_keep_their_digits(spark):
    n = 2**53 + 1
    e = spark.createDataFrame([(n, n + 2), (n + 2, n + 4), (n + 4, n + 2)], "src long, dst long")
    for small in (g.SMALL, 0):
        seeds = spark.createDataFrame([(n,)], "node long")
        assert {(r.node - n, r.depth) for r in g.reachable(e, seeds, small=small).collect()} == {(0, 0), (2, 1), (4, 2)}
        assert {(r.node - n, r.component - n) for r in g.cycles(e, small=small).collect()} == {(2, 2), (4, 2)}


def test_flag_is_upgraded_by_a_longer_path(spark):
    e = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("a", "c", False)], "src string, dst string, duty boolean")
    got = {(r.src, r.dst): r.duty for r in g.flagged_closure(e, "duty").collect()}
    assert got == {("a", "b"): True, ("b", "c"): True, ("a", "c"): True}


def test_flagged_closure_has_no_limit_of_hops(spark):
    n = 100
    e = spark.createDataFrame([(i, i + 1, True) for i in range(n)], "src int, dst int, duty boolean")
    got = g.flagged_closure(e, "duty")
    assert got.count() == n * (n + 1) // 2 and got.where("src = 0 AND dst = 100 AND duty").count() == 1


def test_flag_of_any_hop(spark):
    """A mixes M, M implements I, I extends J: the duty holds from the implements on."""
    e = spark.createDataFrame([("A", "M", False), ("M", "I", True), ("I", "J", False)], "src string, dst string, duty boolean")
    got = {r.src + r.dst: r.duty for r in g.flagged_closure(e, "duty", any_hop=True).collect()}
    assert got == {"AM": False, "MI": True, "IJ": False, "AI": True, "MJ": True, "AJ": True}


def test_many_edges_are_walked_at_once(spark):
    """A circle of more edges than were walked in one task before; by joins it takes a round a hop."""
    n = 220_000
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    assert g.reachable(e, spark.range(1)).agg(F.max("depth")).first()[0] == n - 1
    assert g.cycles(e).groupBy("component").count().collect() == [(0, n)]


def test_part_graph_is_not_broadcast_and_keeps_parts_of_several_brands(spark, tmp_path):
    from graphloom.plans.bindings import part_graph

    spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, None), (5, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(7, i, p) for i, p in enumerate([1, 2, 3, 1, 9, 1, 4, 5])] + [(8, 0, 1), (8, 1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = part_graph(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("small", [g.SMALL, 0])
def test_closure_of_a_random_graph_and_what_is_passed_on(spark, small):
    """Both forms against plain loops."""
    rng = random.Random(4)
    rows = {(rng.randrange(14), rng.randrange(14)): rng.random() < 0.4 for _ in range(22)}
    e = spark.createDataFrame([(f"n{a}", f"n{b}", f) for (a, b), f in rows.items()], "src string, dst string, duty boolean")
    for any_hop in (True, False):
        have = {(*k, f) for k, f in rows.items()}
        while more := {(a, d, (f or h) if any_hop else (f and h)) for a, b, f in have for (c, d), h in rows.items() if c == b} - have:
            have |= more
        want = {(f"n{a}", f"n{b}"): (a, b, True) in have for a, b, _ in have}
        assert {(r.src, r.dst): r.duty for r in g.flagged_closure(e, "duty", any_hop=any_hop, small=small).collect()} == want
    amounts = spark.createDataFrame([(f"n{i}", i + 1) for i in range(16)], "k string, n long")
    total = {b: sum(int(x[1:]) + 1 for x, y in want if y == b) for _, b in want}
    assert {r.node: r.total for r in g.passed_on(e, amounts, "k", "n", small=small).collect()} == total


def test_pairs_of_a_closure_are_not_shuffled(spark):
    e = spark.range(1, 2000).select(F.col("id").alias("src"), F.shiftright("id", 1).alias("dst"), F.lit(False).alias("duty"))
    found = g.flagged_closure(e, "duty")
    assert found.count() == sum(i.bit_length() for i in range(1, 2000))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sources_of_many_pairs_are_taken_fewer_at_a_time(monkeypatch):
    monkeypatch.setattr(g, "PAIRS", 20)
    graph = g._Graph.__new__(g._Graph)
    graph.starts, graph.ends, graph.flags = np.array([*range(12), 11]), np.arange(1, 12), np.zeros(11, bool)
    found = [(a, b) for who, node, _ in graph.closure(np.arange(11), True) for a, b in zip(who.tolist(), node.tolist())]
    assert sorted(found) == [(a, b) for a in range(11) for b in range(a + 1, 12)]
