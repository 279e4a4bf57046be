"""Closures over directed edge tables.

Every operator has two forms that give the same rows. Up to ``small`` edges, which
are counted first, one task numbers the nodes and walks the edges as arrays. Beyond,
a fixpoint of joins runs: frontier, join, anti-join with what was seen, checkpoint
each round; its joins merge sorted sides, so no table goes by way of the driver.
Edges may be a multigraph; nodes may be of any orderable type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from graphloom.session import cut, get_file, new_file, put_file

#: Edges that one task holds at most, about 100 bytes each at its peak; those between other nodes than whole numbers count ten.
SMALL = 20_000_000
#: Pairs of a source and a node that a task of a closure holds at once, but for those of a single source.
PAIRS = 2_000_000


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def _fits(df: DataFrame, small: int) -> bool:
    most = small if isinstance(df.schema[0].dataType, IntegralType) else small // 10
    return df.limit(most + 1).count() <= most


def in_one_task(tables: list[DataFrame], schema: str, walk: Callable[..., list[pa.Array]]) -> DataFrame:
    """Run a walk over whole tables in one task; each table is tagged and unioned by position.

    The walk gets a list of columns for each table and returns the columns of the result."""
    width, n = max(len(t.columns) for t in tables), len(tables)
    kinds = {}
    tagged = None
    for k, t in enumerate(tables):
        cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(t.columns)]
        for i, f in enumerate(t.schema.fields):
            kinds.setdefault(i, f.dataType)
        cols += [F.lit(None).cast(kinds.get(i, t.schema.fields[0].dataType)).alias(f"c{i}") for i in range(len(t.columns), width)]
        part = t.select(F.lit(k).alias("t"), *cols)
        tagged = part if tagged is None else tagged.unionByName(part)

    arrow, sizes, union = to_arrow_schema(StructType.fromDDL(schema)), [len(t.columns) for t in tables], to_arrow_schema(tagged.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[list[pa.Array]]] = [[[] for _ in range(s)] for s in sizes]
        for b in batches:
            kind = b.column(0).to_numpy()
            for k in np.unique(kind).tolist():
                own = b if (kind == k).all() else b.filter(pa.array(kind == k))
                for i in range(sizes[k]):
                    held[k][i].append(own.column(i + 1))
        out = walk(*[[pa.chunked_array(c, union[i + 1].type) for i, c in enumerate(cols)] for cols in held])
        whole = pa.table([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
        yield from whole.to_batches(1 << 16)

    return tagged.coalesce(1).mapInArrow(run, schema)


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of some columns, and each column as places among them."""
    every = pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type).combine_chunks()
    every = pa.concat_arrays(every.chunks) if isinstance(every, pa.ChunkedArray) else every
    coded = every.dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(c) for c in columns])[:-1])


def _adjacent(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and the order of edges: ends[starts[i] : starts[i + 1]] are i's neighbours."""
    order = np.argsort(a, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order], order


def _out_of(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all edges out of some nodes: the node's place among them, and the edge's place."""
    n = starts[nodes + 1] - starts[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    return which, np.arange(len(which)) + np.repeat(starts[nodes] - (np.cumsum(n) - n), n)


def _merge(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def _type(edges: DataFrame) -> str:
    return edges.schema["a"].dataType.simpleString()


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """``node`` and ``depth`` (hops from the nearest seed) of all that the seeds lead to, themselves included."""
    e = cut(_edges(edges, src, dst))  # made once: it is counted, then walked
    start = seeds.select(F.col(seeds.columns[0]).alias("a")).where("a IS NOT NULL").distinct()
    if _fits(e, small) and _fits(start, small):

        def walk(edge_columns, seed_columns):
            values, (a, b, front) = _numbered(*edge_columns, *seed_columns)
            starts, ends, _ = _adjacent(a, b, len(values))
            depth, level = np.full(len(values), -1), 0
            while len(front):
                depth[front] = level
                found = ends[_out_of(starts, front)[1]]
                front, level = np.unique(found[depth[found] < 0]), level + 1
            at = np.flatnonzero(depth >= 0)
            return [values.take(pa.array(at)), pa.array(depth[at])]

        return in_one_task([e, start], f"node {_type(e)}, depth bigint", walk)
    seen = cut(start.select(F.col("a").alias("node"), F.lit(0).cast("bigint").alias("depth")))
    front, level = seen, 0
    while True:
        level += 1
        step = front.join(_merge(e), F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = cut(step.join(_merge(seen), "node", "left_anti").withColumn("depth", F.lit(level).cast("bigint")))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def with_reversed(edges: DataFrame, kind: str, value: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges plus the reverse of those of one kind, which are followed both ways."""
    swap = {src: F.col(dst).alias(src), dst: F.col(src).alias(dst)}
    back = edges.where(F.col(kind) == value).select(*(swap.get(c, F.col(c)) for c in edges.columns))
    return edges.unionByName(back)


def dead(nodes: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """Nodes that no seed leads to."""
    return nodes.join(reached.select(F.col("node").alias(key)).hint("shuffle_hash"), key, "left_anti")


def neighbourhood(edges: DataFrame, changed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Changed nodes and all one hop away, in either direction."""
    c = changed.select(F.col(changed.columns[0]).alias("node")).distinct()
    ahead = edges.join(c, edges[src] == c["node"], "left_semi").select(F.col(dst).alias("node"))
    behind = edges.join(c, edges[dst] == c["node"], "left_semi").select(F.col(src).alias("node"))
    return c.unionByName(ahead).unionByName(behind).distinct()


def callers(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct in-neighbours of each node: their number, and in order."""
    return edges.select(src, dst).distinct().groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("n_callers"), F.array_sort(F.collect_list(src)).alias("callers"))


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst", self_loops: bool = True, small: int = SMALL) -> DataFrame:
    """``node`` and ``component`` (smallest member) of every node on a cycle: strongly
    connected components of several nodes, and self loops if wanted."""
    e = cut(_edges(edges, src, dst))
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    e = e.where("a != b")
    kind = _type(e)
    if _fits(e, small):
        found = in_one_task([e], f"node {kind}, component {kind}", _components)
    else:
        found = _coloured(e)
    if not self_loops:
        return found
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def _components(edge_columns):
    """Strongly connected components of several nodes: what is on no cycle is peeled off first, Tarjan's walk takes the rest."""
    values, (a, b) = _numbered(*edge_columns)
    n = len(values)
    alive = np.ones(n, bool)
    for x, y in ((a, b), (b, a)):
        starts, ends, _ = _adjacent(x, y, n)
        into = np.bincount(y[alive[x]], minlength=n)
        gone = np.flatnonzero(alive & (into == 0))
        while len(gone):
            alive[gone] = False
            met, less = np.unique(ends[_out_of(starts, gone)[1]], return_counts=True)
            into[met] -= less
            gone = met[alive[met] & (into[met] == 0)]
    both = alive[a] & alive[b]
    starts, ends, _ = _adjacent(a[both], b[both], n)
    at, ends = starts.tolist(), ends.tolist()
    last = at[1:]
    index, low, on = [-1] * n, [0] * n, bytearray(n)
    stack: list[int] = []
    count, nodes, of = 0, [], []
    for root in np.flatnonzero(alive).tolist():
        if index[root] >= 0:
            continue
        work = [root]
        while work:
            v = work[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = 1
            k, end, lo = at[v], last[v], low[v]
            while k < end:
                w = ends[k]
                k += 1
                if index[w] < 0:
                    work.append(w)
                    break
                if on[w] and index[w] < lo:
                    lo = index[w]
            at[v], low[v] = k, lo
            if work[-1] != v:
                continue
            work.pop()
            if work and lo < low[work[-1]]:
                low[work[-1]] = lo
            if lo == index[v]:
                size = len(nodes)
                while True:
                    w = stack.pop()
                    on[w] = 0
                    nodes.append(w)
                    of.append(v)
                    if w == v:
                        break
                if len(nodes) == size + 1:
                    del nodes[size:], of[size:]
    nodes, of = np.array(nodes, np.int64), np.array(of, np.int64)
    # The smallest member names the component: places are put in order of values.
    order = pc.sort_indices(values.take(pa.array(nodes))).to_numpy()
    nodes, of = nodes[order], of[order]
    _, first, inverse = np.unique(of, return_index=True, return_inverse=True)
    return [values.take(pa.array(nodes)), values.take(pa.array(nodes[first[inverse]]))]


def _coloured(e: DataFrame) -> DataFrame:
    """Trim nodes without in- or out-edges; then colour each node by the smallest
    node that leads to it, and take what leads back to that one within the colour."""
    found = None
    while True:
        while True:
            keep = cut(e.join(_merge(e.select(F.col("b").alias("a")).distinct()), "a", "left_semi").join(_merge(e.select(F.col("a").alias("b")).distinct()), "b", "left_semi").select("a", "b"))
            same = keep.count() == e.count()
            e = keep
            if same:
                break
        if e.isEmpty():
            break
        colour = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("c", F.col("node")))
        while True:
            offers = e.join(_merge(colour), F.col("a") == F.col("node")).groupBy("b").agg(F.min("c").alias("offer"))
            nxt = cut(colour.join(_merge(offers), F.col("node") == F.col("b"), "left").select("node", F.least("c", F.coalesce("offer", "c")).alias("c"), (F.col("offer") < F.col("c")).alias("moved")))
            colour = nxt.select("node", "c")
            if nxt.where("moved").isEmpty():
                break
        # reverse edges within a colour
        x, y = colour.alias("x"), colour.alias("y")
        inner = cut(e.join(_merge(x), F.col("a") == F.col("x.node")).join(_merge(y), F.col("b") == F.col("y.node")).where("x.c = y.c").select("a", "b"))
        roots = colour.where("node = c").select("node")
        back = reachable(inner, roots, "b", "a", small=0).select("node")
        done = cut(back.join(_merge(colour), "node").select("node", F.col("c").alias("component")))
        several = done.groupBy("component").count().where("count > 1").select("component")
        part = done.join(several, "component", "left_semi").select("node", "component")
        found = part if found is None else found.unionByName(part)
        gone = done.select(F.col("node").alias("a"))
        e = cut(e.join(_merge(gone), "a", "left_anti").join(_merge(gone.withColumnRenamed("a", "b")), "b", "left_anti").select("a", "b"))
    if found is None:
        found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # the smallest member names the component
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def chains(edges: DataFrame, seeds: DataFrame, depth: int = 8, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every path without repeats of up to ``depth`` hops from the seeds: ``path``, ``hops`` and whether it is visible.

    Edges may carry a boolean ``visible``; a chain is visible if all its hops are.
    The number of paths is bounded by the depth alone, so the rows are a feature
    of the result, as its callers ask for all of them.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), (F.col("visible") if "visible" in edges.columns else F.lit(True)).alias("v")).distinct()
    e = cut(e)  # made once: every round joins it
    level = seeds.select(F.col(seeds.columns[0]).alias("tip")).distinct().select("tip", F.array("tip").alias("path"), F.lit(True).alias("visible"))
    out = None
    for hops in range(1, depth + 1):
        level = level.join(e, F.col("tip") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        level = cut(level.select(F.col("b").alias("tip"), F.concat("path", F.array("b")).alias("path"), (F.col("visible") & F.col("v")).alias("visible")))
        if level.isEmpty():
            break
        part = level.select("path", F.lit(hops).cast("bigint").alias("hops"), "visible")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else level.select("path", F.lit(0).cast("bigint").alias("hops"), "visible")


def shortest_paths(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``depth`` and ``parent``: the smallest predecessor one hop nearer to a seed."""
    e = cut(_edges(edges, src, dst))
    d = cut(reachable(e, seeds, "a", "b"))
    a, b = d.alias("p"), d.alias("q")
    parents = e.join(_merge(a), F.col("a") == F.col("p.node")).join(_merge(b), F.col("b") == F.col("q.node")).where("q.depth = p.depth + 1")
    first = parents.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
    return d.join(_merge(first), "node", "left")


def climb(edges: DataFrame, nodes: DataFrame, key: str, child: str = "dst", parent: str = "src") -> DataFrame:
    """Each node's root by way of its smallest parent, by pointer doubling. A way that
    comes to a cycle goes round it and ends at the last node before the first that repeats."""
    up = cut(edges.groupBy(F.col(child).alias("c")).agg(F.min(parent).alias("p")).where("p != c"))
    ring = cut(cycles(up, "c", "p", self_loops=False).select("node"))
    # On a cycle, the node before the one where it is entered; nodes of cycles count as roots till then.
    last = up.join(ring, F.col("c") == F.col("node"), "left_semi").join(ring, F.col("p") == F.col("node"), "left_semi").select(F.col("p").alias("entry"), F.col("c").alias("last"))
    free = up.join(ring, F.col("c") == F.col("node"), "left_anti")
    every = nodes.select(F.col(key).alias("node")).union(free.select("c")).distinct()
    hop = cut(every.join(free, F.col("node") == F.col("c"), "left").select("node", F.coalesce("p", "node").alias("owner")))
    while True:
        y = hop.select(F.col("node").alias("n2"), F.col("owner").alias("o2"))
        nxt = cut(hop.join(y, F.col("owner") == F.col("n2"), "left").select("node", F.coalesce("o2", "owner").alias("owner"), (F.coalesce("o2", "owner") != F.col("owner")).alias("moved")))
        hop = nxt.select("node", "owner")
        if nxt.where("moved").isEmpty():
            break
    hop = hop.join(last, F.col("owner") == F.col("entry"), "left").select("node", F.coalesce("last", "owner").alias("owner"))
    return hop.join(nodes.select(F.col(key).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(key), "owner")


def flagged_closure(edges: DataFrame, flag: str, src: str = "src", dst: str = "dst", any_hop: bool = False, small: int = SMALL) -> DataFrame:
    """All (src, dst) pairs with a path between, of any length, and whether some path
    carries the flag: on every edge, or with ``any_hop`` on one edge at least. The
    flag can only be upgraded. Sources are spread over tasks that all read one file of
    edges, so pairs are neither shuffled nor written; beyond ``small`` edges, each round
    goes a hop on from the pairs that were new, until nothing changes."""
    e = cut(_flagged(edges, flag, src, dst))
    if _fits(e, small):
        ranges, uri = _filed(e)
        kind = _type(e)
        arrow = to_arrow_schema(StructType.fromDDL(f"a {kind}, b {kind}, f boolean"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = None
            for lo, hi in ((lo, hi) for b in batches for lo, hi in zip(b["lo"].to_pylist(), b["hi"].to_pylist())):
                graph = graph or _graph_of(uri)
                for who, node, f in graph.closure(np.arange(lo, hi), any_hop):
                    for at in range(0, len(who), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        yield pa.record_batch([graph.values.take(pa.array(x[part])).cast(k.type) for x, k in zip((who, node), arrow)] + [pa.array(f[part])], schema=arrow)

        seen = ranges.mapInArrow(run, f"a {kind}, b {kind}, f boolean")
    else:
        seen = _closed_by_joins(e, any_hop)
    return seen.select(F.col("a").alias(src), F.col("b").alias(dst), F.col("f").alias(flag))


def passed_on(edges: DataFrame, amounts: DataFrame, key: str, amount: str, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """``node`` and ``total``: the amounts of all keys that lead to it by a path of any length, each once.

    Up to ``small`` edges, a task adds up what its range of sources passes on before anything is shuffled."""
    e = cut(_flagged(edges.select(src, dst, F.lit(True).alias("f")), "f", src, dst))
    own = amounts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("n"))
    if not _fits(e, small):
        pairs = _closed_by_joins(e, False)
        return pairs.join(_merge(own), F.col("a") == F.col("k")).groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("total"))
    ranges, uri = _filed(e)
    kind = _type(e)
    parts = ranges.rdd.getNumPartitions()
    arrow = to_arrow_schema(StructType.fromDDL(f"node {kind}, n bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, total = None, None
        for b in batches:
            graph = graph or _graph_of(uri)
            if total is None:
                total, led = np.zeros(len(graph.values), np.int64), np.zeros(len(graph.values), bool)
            place = pc.index_in(b["k"].cast(graph.values.type), graph.values)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            at, n = place.drop_null().to_numpy().astype(np.int64), b["n"].to_numpy()[known]
            many = np.zeros(len(graph.values), np.int64)
            np.add.at(many, at, n)
            for who, node, _ in graph.closure(np.unique(at), False):
                np.add.at(total, node, many[who])
                led[node] = True
        if total is not None:
            met = np.flatnonzero(led)
            for lo in range(0, len(met), 1 << 16):
                some = met[lo : lo + (1 << 16)]
                yield pa.record_batch([graph.values.take(pa.array(some)).cast(arrow[0].type), pa.array(total[some])], schema=arrow)

    # Keys near each other pass on to the same nodes, so ranges of them have short sums.
    sums = own.repartitionByRange(parts, "k").mapInArrow(run, f"node {kind}, n bigint")
    return sums.groupBy("node").agg(F.sum("n").alias("total"))


def _flagged(edges: DataFrame, flag: str, src: str, dst: str) -> DataFrame:
    kept = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.coalesce(flag, F.lit(False)).alias("f")).where("a IS NOT NULL AND b IS NOT NULL")
    return kept.groupBy("a", "b").agg(F.bool_or("f").alias("f"))


def _closed_by_joins(e: DataFrame, any_hop: bool) -> DataFrame:
    new = seen = e
    step = e.select(F.col("a").alias("m"), F.col("b").alias("to"), F.col("f").alias("g"))
    both = F.col("f") | F.col("g") if any_hop else F.col("f") & F.col("g")
    while True:
        found = new.join(_merge(step), F.col("b") == F.col("m")).select("a", F.col("to").alias("b"), both.alias("f")).groupBy("a", "b").agg(F.bool_or("f").alias("f"))
        known = seen.select("a", "b", F.col("f").alias("g"))
        new = cut(found.join(_merge(known), ["a", "b"], "left").where("g IS NULL OR (f AND NOT g)").select("a", "b", "f"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new).groupBy("a", "b").agg(F.bool_or("f").alias("f")))


def _filed(e: DataFrame) -> tuple[DataFrame, str]:
    """Ranges (lo, hi) of sources over many tasks, and the file of the graph: one task numbers the nodes, sources first."""
    spark = e.sparkSession
    uri = new_file(spark, "edges")

    def write(edge_columns):
        values, (a, b) = _numbered(*edge_columns[:2])
        # places in order of first appearance: those of a come first, so sources are 0 to the number of them
        starts, ends, order = _adjacent(a, b, len(values))
        flags = edge_columns[2].to_numpy().astype(bool)[order]
        out = pa.BufferOutputStream()
        held = {"starts": pa.array(starts), "ends": pa.array(ends), "flags": pa.array(flags), "values": values}
        for name, column in held.items():
            with pa.ipc.new_stream(out, pa.schema([(name, column.type)])) as w:
                w.write_table(pa.table({name: column}))
        put_file(uri, out.getvalue())
        return [pa.array([int(a.max()) + 1 if len(a) else 0])]

    sources = in_one_task([e], "n bigint", write).first()["n"]
    spans = max(1, min(-(-sources // 64), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = spark.range(0, spans, 1, spans).select(F.expr(f"id * {sources} div {spans}").alias("lo"), F.expr(f"(id + 1) * {sources} div {spans}").alias("hi"))
    return ranges, uri


_READ: dict[str, _Graph] = {}


def _graph_of(uri: str) -> _Graph:
    """A graph's file, read once by a worker for all its tasks."""
    if uri not in _READ:
        _READ.clear()
        _READ[uri] = _Graph(get_file(uri))
    return _READ[uri]


class _Graph:
    """Numbered nodes and their edges, as a file of _filed holds them."""

    def __init__(self, data: pa.Buffer):
        source = pa.BufferReader(data)
        starts, ends, flags, values = (pa.ipc.open_stream(source).read_all().column(0).combine_chunks() for _ in range(4))
        self.starts, self.ends, self.flags, self.values = starts.to_numpy(), ends.to_numpy(), flags.to_numpy(zero_copy_only=False), values

    def closure(self, sources: np.ndarray, any_hop: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Source, node and flag of all pairs: some sources at a time, fewer where they have many pairs."""
        todo, size = [sources], 4096
        while todo:
            some = todo.pop()
            if len(some) > size:
                todo.append(some[size:])
                some = some[:size]
            found = self._walk(some, any_hop)
            if found is None:
                size = max(1, len(some) // 4)
                todo.append(some)
            else:
                yield found

    def _walk(self, sources: np.ndarray, any_hop: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Pairs as numbers (the source's place, then the node), twice with the flag as last bit; None if they are too many."""
        n = len(self.starts) - 1
        front = np.arange(len(sources)) * n + sources
        held = np.zeros(len(sources), bool) if any_hop else np.ones(len(sources), bool)
        seen = np.empty(0, np.int64)
        while len(front):
            which, edge = _out_of(self.starts, front % n)
            f = held[which] | self.flags[edge] if any_hop else held[which] & self.flags[edge]
            pairs = np.unique((front[which] // n * n + self.ends[edge]) * 2 + f)
            pairs = pairs[np.append(pairs[1:] >> 1 != pairs[:-1] >> 1, True)] if len(pairs) else pairs  # of both flags, the one that is set
            at = np.searchsorted(seen, pairs & ~1)
            old = np.append(seen, -2)[np.minimum(at, len(seen))]
            there = old >> 1 == pairs >> 1
            better = there & (pairs > old)
            seen[at[better]] |= 1
            new = pairs[~there]
            seen = np.insert(seen, at[~there], new)
            if len(seen) > PAIRS and len(sources) > 1:
                return None
            going = pairs[~there | better]
            front, held = going >> 1, (going & 1).astype(bool)
        pair = seen >> 1
        return sources[pair // n], pair % n, (seen & 1).astype(bool)


def first_in_order(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
