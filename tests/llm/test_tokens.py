import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bitplanes, packing, token_counts
from graphloom.llm.shared import scratch
from graphloom.llm.tokens import Encoder

from .conftest import p

PARTS = ["a", "The", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "Ö", "x1", "²", "'s", "<|endoftext|>", "%", "İ", "ß", "中", "é", "​", "9", "\r\n", "!?"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_words_give_the_library_s_ids(name, texts):
    enc = Encoder(p(name), max_words=50)
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    for t in [*made, *(t for _, t in texts if t)]:
        assert enc.ids(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t
    assert enc.encode(None) == b""
    every = [None, "", *made, *(t for _, t in texts)]
    for chars in (1, 300, 10**9):
        assert [x.tolist() for x in enc.many(every, chars)] == [enc.ids(t).tolist() for t in every]
    assert list(enc.many([])) == []


def test_counts_and_cache(spark, docs, no_docs, texts):
    cache = scratch(spark, "t") + "/cache"
    enc = Encoder(p("byte_bpe_50k.json"))
    want = sorted(((i, len((t or "").encode()), len(enc.ids(t)), len(enc.ids(t)) > 512) for i, t in texts), key=str)
    for _ in range(2):  # the second time from the cache alone
        got = token_counts.token_counts(docs, p("byte_bpe_50k.json"), cache)
        assert sorted(map(tuple, got.collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in texts})
    assert token_counts.token_counts(no_docs, p("byte_bpe_50k.json"), scratch(spark, "t") + "/c").count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, kind):
    x = np.array(ids, "<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(x, kind), len(x), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_shard_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 60_000, n).astype("<u4")) for i, n in enumerate([0, 5, 70, 1, 0, 33])]
    data, n_docs, n_ids = bitplanes.write_shard(iter(docs), kind, block=16)
    assert (n_docs, n_ids) == (6, 109)
    assert [(i, x.tolist()) for i, x in bitplanes.read_shard(data)] == [(i, x.tolist()) for i, x in docs]
    with pytest.raises(ValueError):
        list(bitplanes.read_shard(data[:-1]))


def test_bitplane_files(spark, docs, no_docs, texts):
    enc = Encoder(p("byte_bpe_50k.json"))
    manifest = bitplanes.write_ids(docs, p("byte_bpe_50k.json"), scratch(spark, "t"), end_id=0, block=1000)
    rows = [(i, np.append(enc.ids(t).astype("<u4"), 0).astype("<u4")) for i, t in texts]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = bitplanes.read_ids(manifest).orderBy("start").collect()
    at = 0
    for r, (i, ids) in zip(got, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids.tolist())
        at += len(ids)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in bitplanes.digest_ids(manifest).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    none = bitplanes.write_ids(no_docs, p("byte_bpe_50k.json"), scratch(spark, "t"))
    assert bitplanes.digest_ids(none).count() == 0


def test_bitplane_shards_roll_and_are_the_same_again(spark):
    enc = Encoder(p("byte_bpe_50k.json"))
    rows = [(i, f"text {i * 37 % 1000} of {i}") for i in range(40_000)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    seen = []
    for df in (made, made.repartition(5)):
        manifest = bitplanes.write_ids(df, p("byte_bpe_50k.json"), scratch(spark, "t"), block=4096, roll=15_000)
        files = sorted((r.shard, r.n_docs, zlib.crc32(bitplanes.get(r.path))) for r in manifest.collect())
        seen.append(files)
        got = bitplanes.digest_ids(manifest).orderBy("start").collect()
        assert [r.doc_id for r in got] == list(range(40_000))
        assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert seen[0] == seen[1] and len(seen[0]) > 12
    for i in (0, 7_777, 39_999):
        ids = np.append(enc.ids(rows[i][1]).astype("<u4"), 0).astype("<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_holds_each_id_once(spark, docs, no_docs, texts):
    enc = Encoder(p("word_bpe_49k.json"))
    got = packing.pack(docs, p("word_bpe_49k.json"), end_id=2, window=64).toPandas()
    want = sorted(((i, enc.ids(t).tolist() + [2]) for i, t in texts), key=str)
    pieces = {}
    for seq, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        ends = (part.offset + part.length).tolist()
        assert part.offset.tolist() == [0, *ends[:-1]]
        assert ends[-1] == 64 or (ends[-1] < 64 and ends[-1] & (ends[-1] - 1) == 0)
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces.setdefault((None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), int(r.doc_tokens)), []).append((int(r.start), ids))
    whole = []
    for (i, n), v in pieces.items():
        v.sort()
        copies = len([1 for s, _ in v if s == 0])
        starts = {}
        for s, ids in v:
            starts.setdefault(s, []).append(ids)
        if copies == 1:
            assert [s for s, _ in v] == [sum(len(x) for _, x in v[:k]) for k in range(len(v))]
            whole.append((i, [x for _, ids in v for x in ids]))
        else:  # the row that is there twice
            assert sum(len(ids) for _, ids in v) == copies * n
            whole += [w for w in want if w[0] == i]
    assert sorted(whole, key=str) == want
    assert packing.pack(no_docs, p("word_bpe_49k.json")).count() == 0


def exact_neighbours(y):
    sim = y @ y.T
    np.fill_diagonal(sim, -2)
    return np.argsort(-sim, axis=1, kind="stable")[:, : packing.NEIGHBOURS], sim


def test_paths_visit_all_and_follow_neighbours():
    rng = np.random.default_rng(2)
    topics = rng.random((3, packing.FEATURES)) ** 8 * 20
    x = np.array([np.log1p(rng.poisson(topics[i % 3])) for i in range(60)], np.float32)
    near, sim = exact_neighbours(packing.unit(x - x.mean(0)))
    a = np.repeat(np.arange(60), near.shape[1])
    order = packing.walk(*packing.linked(np.arange(60) + 5, a + 5, near.ravel() + 5, np.rint(sim[a, near.ravel()] * 10_000))).tolist()
    assert sorted(order) == list(range(60))
    assert sum(a % 3 == b % 3 for a, b in zip(order, order[1:])) >= 50
    assert packing.walk(*packing.linked(np.arange(1), *[np.empty(0, int)] * 3)).tolist() == [0]


def recall(held, tokenizer):
    """Share of each document's nearest by brute force that the graph has."""
    counts = {r["part"]: r["count"] for r in held.groupBy("part").count().orderBy("part").collect()}
    starts = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
    space = packing.space_of(held, tokenizer, starts, sum(counts.values()))
    rows = sorted(held.collect(), key=lambda r: (r.part, r.at))
    y = space.of(np.stack([packing.counts_of(np.frombuffer(r.packed, "<u2").astype(int)) for r in rows]))
    mask = (1 << packing.INDEX_BITS) - 1
    got = {r.node & mask: {~x.b & mask for x in r.near} for r in packing.neighbours(held, tokenizer, starts, space).collect()}
    hits = []
    for lo in range(0, len(y), 1000):
        sim = y[lo : lo + 1000] @ y.T
        sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -2
        best = np.argpartition(-sim, packing.NEIGHBOURS, axis=1)[:, : packing.NEIGHBOURS]
        for i, row in enumerate(best):
            least = sim[i, row].min() - 1e-3  # ties and rounding count as found
            hits.append(sum(sim[i, j] >= least for j in got[lo + i]) / packing.NEIGHBOURS)
    return float(np.mean(hits))


def test_packing_graph_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert recall(packing.encode(docs, p("word_bpe_49k.json"), 2), p("word_bpe_49k.json")) >= 0.9


def test_packing_joins_near_copies_across_the_whole_corpus(spark):
    rng = random.Random(4)
    words = [a + b for a in "bcdfgklmnprst" for b in ("an", "el", "ir", "ost", "um", "ade", "ick", "ore")]
    rows = []
    for i in range(2500):
        text = rng.choices(words, k=60)
        near = text.copy()
        for j in rng.sample(range(60), 3):
            near[j] = rng.choice(words)
        rows += [(i, " ".join(text)), (i + 10_000, " ".join(near))]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(made, p("word_bpe_49k.json"), end_id=2, window=1 << 24).where("start = 0").orderBy("sequence_id", "offset").select("doc_id").collect()
    order = [r.doc_id % 10_000 for r in got]
    assert sorted(order) == sorted([*range(2500)] * 2)
    assert sum(a == b for a, b in zip(order, order[1:])) >= 0.9 * 2500


def paths_by_hand(links):
    """Links of (s, h, u, v), the largest first, each taken if both have room and it closes no circle; the smaller end of a path first."""
    met, root = {a: [] for _, _, *ends in links for a in ends}, {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for _, _, u, v in sorted(set(links), reverse=True):
        if len(met[u]) < 2 and len(met[v]) < 2 and find(u) != find(v):
            met[u].append(v)
            met[v].append(u)
            root[find(u)] = find(v)
    out = {}
    for first in sorted(a for a in met if len(met[a]) < 2):
        if first not in out:
            path = [first]
            while more := [b for b in met[path[-1]] if b not in path[-2:]]:
                path.append(more[0])
            out |= {a: (first, i) for i, a in enumerate(path)}
    return out


def test_packing_paths_in_rounds_are_those_of_one_task(spark):
    rng = np.random.default_rng(6)
    at = rng.random((300, 3))
    near, sim = exact_neighbours(-((at[:, None] - at) ** 2).sum(2))
    s = np.rint(sim * 40).astype(int)  # many are equal
    s[:60, :60] = 0  # as of copies
    rows = [(i, [(int(s[i, j]), ~int(j)) for j in near[i]]) for i in range(300)] + [(300, []), (301, [(5, ~302)]), (302, [])]
    made = packing.materialise(spark.createDataFrame(rows, "node bigint, near array<struct<s: int, b: bigint>>"), "near")
    ends = [(x, min(i, ~b), max(i, ~b)) for i, v in rows for x, b in v]
    h = {(r.u, r.v): r.h for r in spark.createDataFrame([e[1:] for e in ends], "u bigint, v bigint").selectExpr("u", "v", "hash(u, v) h").collect()}
    want = paths_by_hand([(x, h[u, v], u, v) for x, u, v in ends]) | {300: (300, 0)}
    for most in (10**9, 500):
        assert {r.node: (r.first, r.place) for r in packing.paths(made, most).collect()} == want


def test_packing_paths_have_no_plan_over_all_rounds(spark, monkeypatch):
    """Whatever is written is one round's work and broadcasts nothing; before, the last plan joined all rounds."""
    rng = np.random.default_rng(6)
    at = rng.random((300, 3))
    near, sim = exact_neighbours(-((at[:, None] - at) ** 2).sum(2))
    rows = [(i, [(int(sim[i, j] * 1000), ~int(j)) for j in near[i]]) for i in range(300)]
    made = packing.materialise(spark.createDataFrame(rows, "node bigint, near array<struct<s: int, b: bigint>>"), "near")
    plans, write = [], packing.materialise

    def noted(df, what, *more):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, what, *more)

    monkeypatch.setattr(packing, "materialise", noted)
    assert packing.paths(made, 700).count() == 300
    assert sum(what == "level" for what, _ in plans) > 2
    assert max(plan.count("SortMergeJoin") for _, plan in plans) <= 6 and not any("Broadcast" in plan for _, plan in plans)


def test_packing_is_the_same_however_much_one_task_takes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    for most in (packing.GROUP, 100):
        monkeypatch.setattr(packing, "GROUP", most)
        got = packing.pack(docs, p("word_bpe_49k.json")).select("doc_id", "start", "length", "sequence_id", "offset").collect()
        seen.append(sorted(map(tuple, got)))
    assert seen[0] == seen[1] and len(seen[0]) >= docs.count() > 100


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cutting_a_batch_costs_little_more_than_splitting_it(name):
    import pyarrow as pa
    import pyarrow.compute as pc

    enc, rng = Encoder(p(name)), random.Random(3)
    texts = [" ".join(rng.choice(["it's", "word", "other,", "7", "end."]) + rng.choice("abc") for _ in range(400)) for _ in range(500)]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: enc._pieces(texts)) < 12 * least(lambda: pc.split_pattern(pa.array(texts, pa.large_string()), " "))
    for got, text in zip(enc.many(["", " ", *texts[:20]]), ["", " ", *texts[:20]]):
        assert got.tolist() == enc.tok.encode(text, add_special_tokens=False).ids
