"""Near-duplicate classes with DartMinHash signatures and banded joining.

Darts are thrown at the plane of weight and rank of every element (a shingle of
five words), the same darts for an element wherever it occurs: the plane is cut
into cells of area one, and a cell's hash gives its number of darts (Poisson with
mean one) and where they land. A dart counts if it lands under the element's
weight; each counted dart belongs to one of k coordinates, and the earliest of a
coordinate is its signature. Two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. Only darts up to a rank of
about (k ln k + 2k) / (sum of weights) are thrown, k ln k + 2k on average for
any document; where a coordinate stays empty, the rank is doubled.

Signatures are cut into bands. Documents that share a band meet in a bucket, where
whole signatures are compared: a pair whose coordinates agree so rarely that a
similarity of ``least`` has a chance of less than 10^-5 is no candidate. Candidates are
compared by their whole shingle sets; those with a similarity of at least ``least``
are links, and classes are the components of the links. Within a bucket not all
candidates are formed: members are compared with one centre first, then, in buckets
of several classes still, members of different classes with 8, 64, 512, ... more
centres, until each was one. No bucket has a cap; a large one is cut into chunks of
about ``CHUNK`` members, each of which meets the centres of the round.

Documents with the same words in the same order are one node throughout.

Defined results: a null or empty text, or one without words, has no shingles and
shares its class with the others without words alone; a text of fewer than five
words is one shingle; rows that share a doc_id and differ in text are rows each;
a null doc_id is kept and is the name of no class unless all of the class are
null; an empty table gives an empty table; ``classes`` ignores other columns,
``keep_one`` returns them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.decontaminate import Hashes, roll, words
from graphloom.llm.shared import HOT_SHARE, SALTS, lean, materialise, release, salted_left_join

#: Chance to miss a pair of similarity s: (1 - s ** ROWS) ** BANDS; 5e-5 at 0.8.
BANDS, ROWS = 25, 5
#: Members of a bucket in one task's hands, on average; centres of a round are up to a quarter.
CHUNK = 4096
#: Up to so many nodes, the texts to compare are picked by a broadcast of their ids (about 60 bytes each).
BROADCAST_NODES = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def throw(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts below rank theta[doc] and the element's weight: document, rank and hash of each."""
    docs, ranks, names = [], [], []
    layer = 0
    while True:
        # Layer v holds the weights [2^v - 1, 2^(v+1) - 1); its cells are 2^v wide and 2^-v high.
        low, wide = 2.0**layer - 1, 2.0**layer
        sel = np.flatnonzero(weights > low)
        if not len(sel):
            break
        n = np.ceil(theta[doc[sel]] * wide).astype(np.int64)
        who = np.repeat(sel, n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        cell = mix(elements[who] + mix(step.astype(np.uint64) * np.uint64(64) + np.uint64(layer)))
        k = np.searchsorted(_POISSON, _unit(cell))
        who, step, cell = np.repeat(who, k), np.repeat(step, k), np.repeat(cell, k)
        j = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
        name = mix(cell + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        rank = (step + _unit(mix(name + np.uint64(1)))) / wide
        at = low + _unit(mix(name + np.uint64(2))) * wide
        ok = (rank < theta[doc[who]]) & (at < weights[who])
        docs.append(doc[who[ok]])
        ranks.append(rank[ok])
        names.append(name[ok])
        layer += 1
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(docs, np.int64), cat(ranks, float), cat(names, np.uint64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k coordinates of each weighted set (elements, weights); sets must not be empty."""
    out = np.zeros((len(sets), k), np.uint64)
    filled = np.zeros((len(sets), k), bool)
    total = np.array([w.sum() for _, w in sets])
    theta = (k * math.log(k) + 2 * k) / total
    todo = np.arange(len(sets))
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        doc = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        d, rank, name = throw(elements, weights, doc, theta[todo])
        spot = d * k + (mix(name + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, spot))
        spot, name = spot[order], name[order]
        first = np.concatenate([[True], spot[1:] != spot[:-1]]) if len(spot) else np.empty(0, bool)
        spot, name = spot[first], name[first]
        rows = todo[spot // k]
        out[rows, spot % k] = name
        filled[rows, spot % k] = True
        todo = todo[~filled[todo].all(1)]
        theta[todo] *= 2
    return out


def shingles(w: list[bytes], hashes: Hashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; of all words if there are fewer."""
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    return np.unique(roll(h, min(n, len(w))))


def digest(w: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(w), digest_size=16).digest()


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash a band."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + sig[:, r::ROWS][:, :BANDS]) * _M1
    return out.astype(np.int64)


def short(sig: np.ndarray) -> list[bytes]:
    """A byte a coordinate, to estimate similarities by."""
    return [row.tobytes() for row in (mix(sig) >> np.uint64(56)).astype(np.uint8)]


def floor_of(least: float) -> int:
    """Coordinates that agree in all but one in 10^5 pairs of similarity ``least``, and more."""
    k = BANDS * ROWS
    return max(0, math.floor(k * least - 4.5 * math.sqrt(k * least * (1 - least))))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = Hashes()
    for b in batches:
        digests, bands, shorts = [], [], []
        held: list[np.ndarray] = []
        at: list[int] = []

        def flush() -> None:
            if held:
                sig = signatures([(x, np.ones(len(x))) for x in held], BANDS * ROWS)
                for i, row, few in zip(at, bands_of(sig), short(sig)):
                    bands[i], shorts[i] = row, few
                held.clear()
                at.clear()

        size = 0
        for i, text in enumerate(b["text"]):
            w = words(text)
            digests.append(digest(w))
            bands.append(None)
            shorts.append(None)
            s = shingles(w, hashes)
            if len(s):
                held.append(s)
                at.append(i)
                size += len(s) + 1000
            if size > 100_000:
                flush()
                size = 0
        flush()
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "digest": digests, "bands": bands, "sig": shorts})


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, node, the bucket's least node and size, and the node's signature, of every band whose bucket holds several nodes."""
    every = nodes.select("node", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "node")
    sizes = materialise(every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "buckets")
    members = salted_left_join(every, sizes.withColumn("size", F.col("n")), "bucket", "n", ["node"]).where("size is not null")
    members = materialise(members.join(nodes.select("node", "sig"), "node"), "members")
    release(sizes)
    return members


def _candidates(rows: DataFrame, floor: int) -> DataFrame:
    """Pairs (centre, node) of a bucket with ``floor`` coordinates in common or more, of different components.

    ``rows`` have bucket, size, node, component, sig, turn and centre: whether they are one of this round's.
    A member meets the centres of smaller turn.
    """
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.lit(1)).cast("int")
    every = F.sequence(F.lit(0), chunks - 1)
    own = F.array(F.pmod(F.xxhash64("node", F.lit(1)), chunks).cast("int"))
    rows = rows.select("bucket", "node", "component", "sig", "turn", "centre", F.explode(F.when(F.col("centre"), every).otherwise(own)).alias("chunk"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # All but the last group of the rows so far are whole.
            t = pa.Table.from_batches([*held, b])
            key = np.stack([t["bucket"].to_numpy(), t["chunk"].to_numpy().astype(np.int64)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield of(t.slice(0, last), np.concatenate([[0], cuts]))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield of(t, np.array([0, t.num_rows]))

    def of(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        node, component, turn, centre = (t[c].to_numpy() for c in ("node", "component", "turn", "centre"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
        left, right = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in (np.flatnonzero(centre[lo:hi]) + lo).tolist() if hi - lo > 1 else ():
                them = np.flatnonzero((turn[lo:hi] > turn[i]) & (component[lo:hi] != component[i])) + lo
                if len(them):
                    them = them[(sig[them] == sig[i]).sum(1) >= floor]
                    left.append(np.full(len(them), node[i]))
                    right.append(node[them])
        a, b = np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["centre", "node"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(compare), "centre bigint, node bigint").distinct()


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (centre, node) whose shingle sets have a Jaccard similarity of at least ``least``."""
    counts = materialise(pairs.groupBy("centre").agg(F.count("*").alias("n")), "centres")
    sizes = counts
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bar = max(200, total // HOT_SHARE)
    # A centre of very many nodes is read by several tasks.
    sizes = sizes.withColumn("salts", F.when(F.col("n") >= bar, SALTS).otherwise(1))
    centres = sizes.select(F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hot = F.broadcast(sizes.where("salts > 1").select("centre", "salts"))
    members = pairs.join(hot, "centre", "left").select("node", "centre", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    uses = centres.select("node", F.lit(None).cast("bigint").alias("centre"), "salt").unionByName(members)
    # All uses of a node, as one list: a centre's 64 salts and, as a member, the candidates among a round's centres.
    uses = uses.groupBy("node").agg(F.collect_list(F.struct("centre", "salt")).alias("uses"))
    uses = materialise(uses.join(nodes.select("node", F.col("rep").alias("doc_id"), F.col("digest").alias("own")), "node"), "uses")
    want = F.broadcast(uses) if uses.count() <= BROADCAST_NODES else uses
    texts = docs.alias("d").join(want.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.text", "w.node", "w.own", "w.uses")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            out, size = [], 0
            for text, node, own, uses in zip(b["text"], b["node"], b["own"], b["uses"]):
                w = words(text)
                if digest(w) != bytes(own):  # another text of the same doc_id
                    continue
                data = shingles(w, hashes).tobytes()
                for u in uses:
                    centre, salt = u["centre"], u["salt"]
                    out.append((node if centre is None else centre, salt, None if centre is None else node, data))
                    size += len(data)
                if size > 4 << 20:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["centre", "salt", "node", "data"]).astype({"node": "Int64"})

    sets = materialise(texts.mapInPandas(lean(emit), "centre bigint, salt int, node bigint, data binary"), "sets", 1000)
    own = sets.where("node is null").select("centre", "salt", F.col("data").alias("other"))
    both = sets.where("node is not null").join(own, ["centre", "salt"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["data"], b["other"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                ok.append(both >= least * (len(p) + len(q) - both) and both > 0)
            yield b.loc[ok, ["centre", "node"]]

    links = materialise(both.select("centre", "node", "data", "other").mapInPandas(lean(compare), "centre bigint, node bigint").distinct(), "links", 500)
    release(counts, uses, sets)
    return links


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of the class, a row a document."""
    return _classes(docs, least)[0].select("doc_id", "class_id")


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and class_id of every row, and the two tables that this reads."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialise(docs.mapInPandas(lean(_sketch), "doc_id bigint, digest binary, bands array<bigint>, sig binary"), "sketches", 2000)
    nodes = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _members(nodes)

    floor = floor_of(least)
    first = members.withColumns({"component": F.col("node"), "centre": F.col("node") == F.col("least"), "turn": F.col("node")})
    pairs = materialise(_candidates(first, floor), "pairs")
    found = _links(docs, nodes, pairs, least)
    labels = materialise(components(found, "centre", "node"), "labels")
    release(pairs)
    done, more = 0, 8
    while True:
        # Buckets whose members are of several classes still.
        placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("size").alias("n"))
        mixed = materialise(mixed.where((F.col("lo") != F.col("hi")) & (F.col("n") > max(done, 2))).select("bucket", "n", F.lit(True).alias("mixed")), "mixed")
        if mixed.isEmpty():
            release(mixed)
            break
        rest = salted_left_join(placed.drop("least"), mixed, "bucket", "n", ["node"]).where("mixed").drop("mixed")
        # Each member has its turn in a bucket's order by hash: done to done + more of them, on average, are this round's centres.
        turn = F.shiftrightunsigned(F.xxhash64("bucket", "node"), 11) * F.lit(2.0**-53)
        upto = lambda n: F.lit(float(n)) / F.col("size") if n < 1 << 40 else F.lit(2.0)
        rest = rest.withColumn("turn", turn).withColumn("centre", (F.col("turn") >= upto(done)) & (F.col("turn") < upto(done + more)))
        pairs = materialise(_candidates(rest, floor), "pairs")
        if not pairs.isEmpty():
            more_links = _links(docs, nodes, pairs, least)
            if not more_links.isEmpty():
                old, found = found, materialise(found.unionByName(more_links), "links")
                release(old, labels)
                labels = materialise(components(found, "centre", "node"), "labels")
            release(more_links)
        release(mixed, pairs)
        done, more = done + more, min(more * 8, CHUNK // 4)

    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = materialise(named.join(names, "component").select("digest", "n", "class_id"), "named")
    release(members, found, labels, nodes)
    return salted_left_join(rows.select("doc_id", "digest"), named, "digest", "n", ["doc_id"]), rows, named


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each class, the one of the smallest doc_id; all columns kept.

    The texts are moved only if the ids to drop are too many to broadcast. Rows
    of a null doc_id can't be told apart and stay; of rows that share the kept
    doc_id, the one of the smallest text stays.
    """
    placed, *under = _classes(docs, least)
    placed = materialise(placed.select("doc_id", "class_id"), "placed")
    release(*under)
    drop = materialise(placed.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_gl_drop")).distinct(), "drop")
    gone = F.broadcast(drop) if drop.count() <= 1_000_000 else drop
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gl_drop"], "left_anti")
    twice = placed.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_gl_drop"))
    twice = materialise(twice, "twice")
    release(placed)
    if twice.isEmpty():
        return kept
    same = docs["doc_id"].cast("bigint") == twice["_gl_drop"]
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    one = kept.join(twice, same, "left_semi").withColumn("_gl_r", F.row_number().over(order)).where("_gl_r = 1").drop("_gl_r")
    return kept.join(twice, same, "left_anti").unionByName(one)
