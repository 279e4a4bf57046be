"""Packing of related documents into sequences of a fixed length.

Documents are encoded once and held as packed ids. Their profiles are log counts of
hashed ids under the corpus's inverse frequencies, taken to ``DIM`` directions (those
that hold most of a sample) and compared by cosine. A graph over the whole corpus
joins every document with its ``NEIGHBOURS`` nearest. Candidates come from ``TABLES``
tables: each sorts all documents by the nearest of its sampled pivots and then by a
signed random projection, and each document is compared with ``HALF`` before and
after it or more, in whatever cell; the best of all tables stay. The graph is
approximate: README has its measured recall.
Paths are made of the graph's links, the nearest first: a link is taken if both
documents have fewer than two so far and aren't the ends of one path. Which links
these are follows from the graph alone: as long as there are more than ``GROUP``,
those that are the nearest to both paths they would join are taken in rounds over
all tasks, which the order above would take too; one task takes the rest. Paths are
in the order of their first document's cell in the first table. Windows are filled
along the paths; a document may be cut anywhere, and the fill goes on over paths, so
within a range of the order every window but the last is full. The last is split at
powers of two, which need no padding. The result depends on the rows, their files and
the number of shuffle partitions alone.

Defined results: a null text counts as empty and is its end id alone; rows that
repeat are documents each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import get, lean, materialise, put, release, scratch
from graphloom.llm.tokens import encoder

NEIGHBOURS, FEATURES, DIM = 8, 512, 64
TABLES, HALF, PIVOTS, CODE_BITS = 8, 256, 2048, 24
#: Links that one task takes at most; numbers of documents keep their cell above INDEX_BITS.
GROUP, INDEX_BITS = 1 << 22, 40
#: Documents sampled for directions, pivots and bounds, at most; 1 KB each on the driver.
SAMPLE = 200_000
_HASH = np.random.default_rng(5).integers(0, FEATURES, 1 << 17)
_PLANES = np.random.default_rng(7).standard_normal((DIM, TABLES * CODE_BITS)).astype(np.float32)

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def counts_of(ids: np.ndarray) -> np.ndarray:
    """Counts of hashed ids."""
    return np.bincount(_HASH[ids & (len(_HASH) - 1)], minlength=FEATURES)


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part and at (a row's place in its task), doc_id and packed ids with the end id; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.concatenate([x, end]).tobytes() for x in enc.many(b["text"].to_pylist())]
            n = len(ids)
            yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), b["doc_id"], pa.array(ids, pa.binary())], ["part", "at", "doc_id", "packed"])
            at += n

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(lean(run), "part int, at bigint, doc_id bigint, packed binary"), "packed")


def all_counts(packed: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.stack([counts_of(np.frombuffer(x.as_buffer(), dtype).astype(np.int64)) for x in packed])


def frequencies(held: DataFrame, tokenizer: str) -> np.ndarray:
    """Inverse frequency of each feature over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                df, n = df + (all_counts(c["packed"], encoder(tokenizer).dtype) > 0).sum(0), n + c.num_rows
        yield pa.record_batch([pa.array(np.arange(FEATURES)), pa.array(df), pa.array(np.full(FEATURES, n))], ["f", "df", "n"])

    rows = held.select("packed").mapInArrow(lean(run), "f bigint, df bigint, n bigint")
    got = sorted(rows.groupBy("f").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect())
    return (np.log((1 + got[0]["n"]) / (1 + np.array([r["df"] for r in got]))) + 0.1).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log1p(counts).astype(np.float32) * idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def directions(x: np.ndarray) -> np.ndarray:
    """The directions that hold most of a sample, but for the first, which all documents share."""
    values, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, np.argsort(-values)[1 : DIM + 1]].astype(np.float32)


def tie(index: np.ndarray) -> np.ndarray:
    """16 bits of a hash, so that equal documents can be spread over ranges."""
    return ((index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def linked(node: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists of the undirected graph over sorted ``node``, the nearest first, as for walk."""
    n = len(node)
    a, b = np.searchsorted(node, a), np.searchsorted(node, b)
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    _, first = np.unique(a * n + b, return_index=True)
    keep = np.sort(first)
    a, b = a[keep], b[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b.astype(np.int32)


def walk(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Path after path over a graph: ends[starts[i] : starts[i + 1]] are i's neighbours, the nearest first."""
    n = len(starts) - 1
    seen, out, m = np.zeros(n, bool), np.empty(n, np.int32), 0
    for first in np.argsort(np.diff(starts), kind="stable").tolist():
        at = first
        while at >= 0 and not seen[at]:
            seen[at] = True
            out[m] = at
            m += 1
            near = ends[starts[at] : starts[at + 1]]
            free = near[~seen[near]]
            at = int(free[0]) if len(free) else -1
    return out


class Space:
    """The space in which documents are compared, and the order of each table; made from a sample."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, index: np.ndarray, total: int, parts: int):
        self.idf, self.basis = idf, directions(unit(weighted(x, idf)))
        cells = max(1, min(total // HALF, PIVOTS))
        y = self.of(x)
        turn = np.random.default_rng(13).permutation(len(y))
        self.pivots = [self._chain(y[np.take(turn, np.arange(t * cells, (t + 1) * cells) % len(y))]) for t in range(TABLES)]
        codes = np.sort(self.codes(y, index), axis=0)
        self.per = max(1, -(-parts // TABLES))
        self.bounds = [codes[(np.arange(1, self.per) * len(y)) // self.per, t] for t in range(TABLES)]

    @staticmethod
    def _chain(y: np.ndarray) -> np.ndarray:
        """Pivots in the order of paths through them, so that cells next to each other are alike."""
        y = np.unique(y, axis=0)
        sim = y @ y.T
        np.fill_diagonal(sim, -2)
        near = np.argsort(-sim, axis=1)[:, : min(NEIGHBOURS, len(y) - 1)].astype(np.int32)
        return y[walk(np.arange(len(y) + 1) * near.shape[1], near.ravel())]

    def of(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(weighted(counts, self.idf)) @ self.basis)

    def codes(self, y: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Each table's sort key: the nearest pivot, a signed random projection, a tie."""
        bits = (y @ _PLANES > 0).reshape(len(y), TABLES, CODE_BITS) @ (1 << np.arange(CODE_BITS)[::-1])
        cell = np.stack([np.argmax(y @ v.T, axis=1) for v in self.pivots], axis=1)
        return (cell.astype(np.int64) << (CODE_BITS + 16)) + (bits << 16) + tie(index)[:, None]

    def nodes(self, codes: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Numbers of documents, whose upper bits are their cell in the first table."""
        return (codes[:, 0] >> (CODE_BITS + 16) << INDEX_BITS) + index


def space_of(held: DataFrame, tokenizer: str, starts: dict[int, int], total: int) -> Space:
    idf = frequencies(held, tokenizer)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.minimum(all_counts(b["packed"], encoder(tokenizer).dtype), 65535).astype("<u2")
                index = np.array([starts[p] for p in b["part"].to_pylist()]) + b["at"].to_numpy()
                yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), pa.array(index)], ["x", "i"])

    wanted = min(max(PIVOTS * TABLES, 20 * parts), SAMPLE)
    some = held.where(F.pmod(F.xxhash64("part", "at"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / total)))
    got = sorted((r["i"], r["x"]) for r in some.select("part", "at", "packed").mapInArrow(lean(sample), "x binary, i bigint").collect())
    got = got or [(0, bytes(2 * FEATURES))]
    x = np.frombuffer(b"".join(v for _, v in got), "<u2").reshape(-1, FEATURES)
    return Space(idf, x, np.array([i for i, _ in got]), total, parts)


def neighbours(held: DataFrame, tokenizer: str, starts: dict[int, int], space: Space) -> DataFrame:
    """node and near, its NEIGHBOURS nearest of all tables: structs of the cosine (10,000 for 1) and of ~node, largest first."""
    shared = held.sparkSession.sparkContext.broadcast(space)  # at most PIVOTS * TABLES * DIM numbers

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                n = c.num_rows
                y = space.of(all_counts(c["packed"], encoder(tokenizer).dtype))
                index = np.array([starts[p] for p in c["part"].to_pylist()]) + c["at"].to_numpy()
                codes = space.codes(y, index)
                node = space.nodes(codes, index)
                vec = [v.tobytes() for v in np.rint(y * (127 / np.maximum(np.abs(y).max(1, keepdims=True), 1e-9))).astype(np.int8)]
                for t in range(TABLES):
                    place = t * space.per + np.searchsorted(space.bounds[t], codes[:, t], side="right")
                    yield pa.record_batch([pa.array(place.astype(np.int32)), pa.array(codes[:, t]), pa.array(node), pa.array(vec, pa.binary())], ["place", "code", "node", "vec"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Half a block at a time, compared with itself and the halves before and after it."""

        def halves() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, size = [], 0
            for b in batches:
                node = b["node"].to_numpy()
                vec = unit(np.frombuffer(b"".join(b["vec"].to_pylist()), np.int8).reshape(-1, DIM).astype(np.float32))
                at = 0
                while at < len(node):
                    held.append((node[at : at + HALF - size], vec[at : at + HALF - size]))
                    at, size = at + len(held[-1][0]), size + len(held[-1][0])
                    if size == HALF:
                        yield tuple(map(np.concatenate, zip(*held)))
                        held, size = [], 0
            if size:
                yield tuple(map(np.concatenate, zip(*held)))

        def of(mid: tuple, around: list[tuple]) -> pa.RecordBatch:
            node, other = mid[0], np.concatenate([h[0] for h in around])
            sim = mid[1] @ np.concatenate([h[1] for h in around]).T
            sim[node[:, None] == other] = -2
            k = min(NEIGHBOURS, len(other) - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.empty((len(node), 0), np.int64)
            s = np.rint(np.take_along_axis(sim, best, 1) * 10_000).astype(np.int32)  # the same from each side
            near = pa.StructArray.from_arrays([pa.array(s.ravel()), pa.array(~other[best].ravel())], ["s", "b"])
            return pa.record_batch([pa.array(node), pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * k), near)], ["node", "near"])

        before, mid = None, None
        for h in halves():
            if mid is not None:
                yield of(mid, [x for x in (before, mid, h) if x is not None])
            before, mid = mid, h
        if mid is not None:
            yield of(mid, [x for x in (before, mid) if x is not None])

    rows = held.select("part", "at", "packed").mapInArrow(lean(sketch), "place int, code bigint, node bigint, vec binary")
    rows = rows.repartitionById(TABLES * space.per, "place").sortWithinPartitions("place", "code", "node")
    found = rows.select("node", "vec").mapInArrow(lean(nearest), "node bigint, near array<struct<s: int, b: bigint>>")
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), False), 1, NEIGHBOURS)
    return found.groupBy("node").agg(best.alias("near"))


def joined(s: np.ndarray, h: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins fragments of paths (their ends x and y, the same of a single document, and n documents) by links u to v.

    Returns for each fragment the first document of its path, the place in it of its document x, and 1 or -1: the way from x to y."""
    node, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = back[: len(x)], back[len(x) :]
    partner = np.empty(len(node), np.int64)
    partner[x], partner[y] = y, x
    of = np.empty(len(node), np.int64)
    of[x] = of[y] = np.arange(len(x))
    room, other = np.where(partner == np.arange(len(node)), 2, 1).tolist(), partner.tolist()
    one, two = [-1] * len(node), [-1] * len(node)
    order = np.lexsort((v, u, h, s))[::-1]
    for lo in range(0, len(order), 1 << 18):
        some = order[lo : lo + (1 << 18)]
        for a, b in zip(np.searchsorted(node, u[some]).tolist(), np.searchsorted(node, v[some]).tolist()):
            if room[a] and room[b] and other[a] != b:
                room[a] -= 1
                room[b] -= 1
                one[a], two[a] = b, one[a]
                one[b], two[b] = a, one[b]
                p, q = other[a], other[b]
                other[p], other[q] = q, p
    partner, of, size, left = partner.tolist(), of.tolist(), n.tolist(), x.tolist()
    first, start, way = [0] * len(size), [0] * len(size), [1] * len(size)
    seen = bytearray(len(size))
    for begin in np.flatnonzero(room).tolist():  # the ends of paths, the smaller one first
        if seen[of[begin]]:
            continue
        at, came, upto = begin, -1, 0
        while at >= 0:
            k = of[at]
            seen[k], first[k] = 1, begin
            if left[k] == at:
                start[k] = upto
            else:
                start[k], way[k] = upto + size[k] - 1, -1
            upto += size[k]
            out = partner[at]
            came, at = out, (one[out] if one[out] != came else two[out])
    return node[np.array(first, np.int64)], np.array(start, np.int64), np.array(way, np.int64)


def paths(near: DataFrame, most: int | None = None) -> DataFrame:
    """node, its path's first document and its place in the path; ``near`` should be materialised. Any ``most`` gives the same rows."""
    most = GROUP if most is None else most
    node, b = F.col("node"), F.bitwise_not("near.b")
    frags = near.select(node.alias("f"), node.alias("x"), node.alias("y"), F.lit(1).cast("bigint").alias("n"))
    links = near.select("node", F.explode("near").alias("near")).select(F.col("near.s").alias("s"), F.least(node, b).alias("u"), F.greatest(node, b).alias("v"))
    links = links.select("s", F.hash("u", "v").alias("h"), "u", "v", F.col("u").alias("fu"), F.col("v").alias("fv"))
    levels: list[DataFrame] = []
    count = near.agg(F.sum(F.size("near")).alias("n")).first()["n"] or 0
    while count > most:
        level = materialise(_merged(frags, links), "level")
        moved = level.where("x2 is not null").select("f", "into", "x2", "y2")
        rest = links
        for at, frag in (("u", "fu"), ("v", "fv")):
            rest = rest.join(moved.withColumnRenamed("f", frag).hint("merge"), frag, "left").where(F.col("into").isNull() | (F.col(at) == F.col("x2")) | (F.col(at) == F.col("y2")))
            rest = rest.withColumn(frag, F.coalesce("into", frag)).drop("into", "x2", "y2")
        rest = materialise(rest.where("fu != fv").select("s", "h", "u", "v", "fu", "fv"), "links")
        release(links)
        links, count = rest, rest.count()
        frags = level.where("f = into").select("f", F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y"), F.coalesce("n2", "n").alias("n"))
        levels.append(level)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("s", pa.int32()), ("h", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("f", pa.int64())]))
        link = held["n"].is_null().to_numpy()
        a, b = held["a"].to_numpy(), held["b"].to_numpy()
        n, f = (held[c].fill_null(0).to_numpy()[~link] for c in ("n", "f"))
        s, h = (held[c].fill_null(0).to_numpy()[link] for c in ("s", "h"))
        del held
        first, start, way = joined(s, h, a[link], b[link], a[~link], b[~link], n)
        for lo in range(0, len(f), 1 << 16):
            yield pa.record_batch([pa.array(x[lo : lo + (1 << 16)]) for x in (f, first, start, way)], ["f", "first", "at", "way"])

    own = frags.join(links.select(F.explode(F.array("fu", "fv")).alias("f")).hint("merge"), "f", "left_semi") if levels else frags
    none, no = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    rows = links.select("s", "h", "u", "v", none, none).unionAll(own.select(no, no, "x", "y", "n", "f")).toDF("s", "h", "a", "b", "n", "f")
    found = rows.coalesce(1).mapInArrow(lean(finish), "f bigint, first bigint, at bigint, way bigint")
    if levels:
        turned = F.col("x") > F.col("y")
        alone = [F.least("x", "y"), F.when(turned, F.col("n") - 1).otherwise(0), F.when(turned, -1).otherwise(1)]
        taken = materialise(found, "taken")
        found = frags.join(taken.hint("merge"), "f", "left").select("f", *[F.coalesce(c, other).alias(c) for c, other in zip(("first", "at", "way"), alone)])
    # Each level is written before the next one is read: one plan over all rounds fills the driver, with the tables that it broadcasts.
    held = [links, *([taken] if levels else [])]
    for level in reversed(levels):
        whole = materialise(found, "placed")
        release(*held)
        inner = F.col("off") + F.when(F.col("flip"), F.col("n") - 1).otherwise(0)
        found = level.select("f", "into", "off", "flip", "n").join(whole.withColumnRenamed("f", "into").hint("merge"), "into")
        found = found.select("f", "first", (F.col("at") + F.col("way") * inner).alias("at"), F.when(F.col("flip"), -F.col("way")).otherwise(F.col("way")).alias("way"))
        held = [whole, level]
    out = materialise(found.select(F.col("f").alias("node"), "first", F.col("at").alias("place")), "paths")
    release(*held)
    return out


def _merged(frags: DataFrame, links: DataFrame) -> DataFrame:
    """A round: fragments whose nearest links are the same one are joined by it.

    All fragments, each with the one it goes into (itself, if it stays), its offset there and whether it is turned; x2, y2 and n2
    are the ends and the size of the new one."""
    best = links.select(F.explode(F.array("fu", "fv")).alias("f"), F.struct("s", "h", "u", "v", "fu", "fv").alias("k")).groupBy("f").agg(F.max("k").alias("k"))
    met = best.groupBy("k").count().where("count = 2").select("k.u", "k.v", "k.fu", "k.fv")
    met = met.join(frags.toDF("fu", "ux", "uy", "un").hint("merge"), "fu").join(frags.toDF("fv", "vx", "vy", "vn").hint("merge"), "fv")
    u, v = F.col("u"), F.col("v")
    head = F.struct(F.col("fu").alias("f"), F.lit(0).cast("bigint").alias("off"), (F.col("uy") != u).alias("flip"))
    tail = F.struct(F.col("fv").alias("f"), F.col("un").alias("off"), (F.col("vx") != v).alias("flip"))
    x2, y2 = F.when(F.col("uy") == u, F.col("ux")).otherwise(F.col("uy")), F.when(F.col("vx") == v, F.col("vy")).otherwise(F.col("vx"))
    met = met.select(F.col("fu").alias("into"), x2.alias("x2"), y2.alias("y2"), (F.col("un") + F.col("vn")).alias("n2"), F.explode(F.array(head, tail)).alias("c"))
    met = met.select("c.f", "into", "c.off", "c.flip", "x2", "y2", "n2")
    kept = [F.coalesce("into", "f").alias("into"), F.coalesce("off", F.lit(0).cast("bigint")).alias("off"), F.coalesce("flip", F.lit(False)).alias("flip")]
    return frags.join(met.hint("merge"), "f", "left").select("f", "x", "y", "n", *kept, "x2", "y2", "n2")


def places(near: DataFrame, starts: dict[int, int], total: int, parts: int, folder: str) -> None:
    """Write each document's path, its place there and the range of their order it is in: a file for each part of ``starts``."""
    near = materialise(near, "near")
    found = paths(near)
    release(near)
    names, first = np.array([*starts]), np.array([*starts.values()])
    share = min(1.0, 100 * parts / total)
    some = found.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = sorted((r["first"], r["place"]) for r in some.select("first", "place").collect())
    bounds = [some[i * len(some) // parts] for i in range(1, parts)] if some else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b["node"].to_numpy() & ((1 << INDEX_BITS) - 1)
            which = np.searchsorted(first, index, side="right") - 1
            within = [bisect_right(bounds, x) for x in zip(b["first"].to_pylist(), b["place"].to_pylist())]
            yield pa.record_batch([pa.array(names[which].astype(np.int32)), pa.array(index - first[which]), b["first"], b["place"], pa.array(within, pa.int32())], ["part", "at", "first", "place", "range"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], -1
        for b in batches:
            own = b["part"].to_numpy()
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1):
                if not len(cut):
                    continue
                if held and own[cut[0]] != part:
                    put(f"{folder}/{part}", np.concatenate(held).tobytes())
                    held = []
                part = int(own[cut[0]])
                held.append(np.stack([b[c].to_numpy()[cut].astype(np.int64) for c in ("first", "place", "range")], axis=1))
        if held:
            put(f"{folder}/{part}", np.concatenate(held).tobytes())
        yield pa.record_batch([pa.array([1])], ["n"])

    rows = found.mapInArrow(lean(run), "part int, at bigint, first bigint, place bigint, range int")
    rows.repartitionById(parts, "part").sortWithinPartitions("part", "at").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    release(found)


class Filler:
    """Fills windows with documents in the order in which they come."""

    def __init__(self, window: int, base: int):
        self.window, self.next = window, base
        self.open: list[tuple] = []
        self.used = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.window - self.used)
            self.open.append((doc_id, start, ids[start : start + take], len(ids)))
            self.used += take
            start += take
            if self.used == self.window:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        """Split what is left into powers of two, largest first."""
        rest = self.open
        while self.used:
            room = 1 << (self.used.bit_length() - 1)
            self.used -= room
            head: list[tuple] = []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                head.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self._close(head)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pieces of documents with their place: sequence_id and offset, and their ids
    (little-endian unsigned 32-bit). A sequence is shorter than ``window`` only at
    a power of two."""
    held = encode(docs, tokenizer, end_id)
    counts = {r["part"]: r["count"] for r in held.groupBy("part").count().orderBy("part").collect()}
    total = sum(counts.values())
    if not total:
        return held.sparkSession.createDataFrame([], PIECES)
    starts = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = space_of(held, tokenizer, starts, total)
    folder = scratch(held.sparkSession, "places")
    places(neighbours(held, tokenizer, starts, space), starts, total, parts, folder)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b["part"].to_numpy(), b["at"].to_numpy()
            out = np.empty((len(at), 3), np.int64)
            for one in np.unique(part).tolist():
                if one not in known:
                    known = {one: np.frombuffer(get(f"{folder}/{one}"), np.int64).reshape(-1, 3)}
                own = part == one
                out[own] = known[one][at[own]]
            yield pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32)), b["doc_id"], b["packed"]], ["first", "place", "range", "doc_id", "packed"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = encoder(tokenizer).dtype
        fill = Filler(window, TaskContext.get().partitionId() << 32)
        out: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, null, data in zip(b["doc_id"], b["doc_id"].isna(), b["packed"]):
                ids = np.frombuffer(data, dtype)
                out.extend(fill.add(None if null else int(doc_id), ids))
                size += len(ids)
                if size > 1_000_000 and out:
                    yield _frame(out)
                    out, size = [], 0
        out.extend(fill.finish())
        if out:
            yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    rows = held.mapInArrow(lean(placed), "first bigint, place bigint, range int, doc_id bigint, packed binary").repartitionById(parts, "range")
    return rows.sortWithinPartitions("first", "place").select("doc_id", "packed").mapInPandas(lean(run), PIECES)
