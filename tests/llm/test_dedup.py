import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import dart_minhash as dm
from graphloom.llm.components import components
from graphloom.llm.decontaminate import Hashes, words


def brute(rows, least=0.8, n=5):
    """Class of each row by all pairs of shingle sets."""
    sets, by = [], defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = words(t)
        s = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
        sets.append(s)
        for x in s:
            by[x].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter((a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :])
    empty = [k for k, s in enumerate(sets) if not s]
    links = [(a, b) for (a, b), c in shared.items() if c >= least * (len(sets[a]) + len(sets[b]) - c)] + list(zip(empty, empty[1:]))
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    out = []
    for m in members.values():
        ids = [rows[k][0] for k in m if rows[k][0] is not None]
        out += [(rows[k][0], min(ids) if ids else None) for k in m]
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 80, 200]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_all_pairs(spark, seed):
    rows = made(seed, 150)
    got = dm.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edge_cases(spark, docs, no_docs, texts):
    got = sorted(map(tuple, dm.classes(docs).collect()), key=str)
    assert got == brute(texts)
    assert dm.classes(no_docs).count() == 0
    kept = dm.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, 7, 8, 9, None, 10, 11], key=str)
    assert dm.keep_one(no_docs).count() == 0


def test_a_bucket_of_several_classes_is_worked_off(spark, monkeypatch):
    """With one row a band nearly all meet: centres after the first are needed."""
    monkeypatch.setattr(dm, "ROWS", 1)
    rows = made(3, 60)
    # the sketch runs in another process: it is given as computed here
    hashes = Hashes()
    import pandas as pd

    sketch = pd.concat(dm._sketch(iter([pd.DataFrame({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})])))
    table = spark.createDataFrame([(int(i), bytes(d), [int(x) for x in b], bytes(g)) for i, d, b, g in sketch.itertuples(index=False)], "doc_id bigint, digest binary, bands array<bigint>, sig binary")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = dm.materialise
    monkeypatch.setattr(dm, "materialise", lambda df, what, *a: table if what == "sketches" else real(df, what, *a))
    assert sorted(map(tuple, dm.classes(docs).collect()), key=str) == brute(rows)
    assert hashes is not None


def weighted(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = {int(k): float(rng.choice([0.3, 1.0, 2.5, 9.0])) for k in rng.integers(0, 2**63, 200)}
    b = {k: (v if rng.random() < 0.6 else v * 2) for k, v in a.items() if rng.random() < 0.85}
    pack = lambda d: (np.array(list(d), np.uint64), np.array(list(d.values())))
    k = 2048
    sig = dm.signatures([pack(a), pack(b), pack(a)], k)
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - weighted(a, b)) < 0.05
    one = dm.signatures([(np.array([5], np.uint64), np.ones(1))], 64)
    assert len(set(one[0].tolist())) > 1  # each coordinate has its own dart


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
