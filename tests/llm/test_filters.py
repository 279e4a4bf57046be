import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import backoff_lm, decontaminate, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, width=13):
    out = []
    for doc_id, t in docs:
        w = split(t)
        hit, found = set(), set()
        for item, text in items:
            v = split(text)
            n = min(width, len(v))
            for i in range(max(1, len(v) - n + 1) if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item) if item is not None else "null")
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "ça", "Dé", "e5", "f"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([20, 5, 1, 13, 14, 40])] + [(None, "x y z x y z"), (7, None), (8, "!!"), (1, text(6))]
    docs = [(i, text(rng.choice([0, 3, 30, 90]))) for i in range(25)]
    docs += [(50 + i, text(30) + (t or "") + text(30)) for i, (_, t) in enumerate(items)] + [(90, None), (91, ""), (None, items[0][1]), (92, items[0][1].upper()), (92, items[0][1].upper())]
    return docs, items


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_report_matches_brute_force(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n_hit int, h string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rid int")
    got = decontaminate.report(d, b, max_broadcast=limit)
    assert sorted(((r[0], r[1], r[2], list(r[3])) for r in got.collect()), key=str) == brute(docs, items)
    assert decontaminate.report(d.limit(0), b, max_broadcast=limit).count() == 0
    clean = decontaminate.report(d, b.limit(0), max_broadcast=limit if limit > 3 else 0 - 1)
    assert clean.agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_clean_drops_documents_and_cuts_spans(spark, limit):
    item = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(600))
    rows = [(1, item, 5), (2, filler, 5), (3, f"{filler}. {item.upper()}, {filler}", 5), (4, None, None), (5, "", 5), (6, "q1 q2", 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(d, b, max_broadcast=limit).collect()}
    assert got == {2: filler, 3: f"{filler}. , {filler}", 4: None, 5: "", 6: "q1 q2"}
    assert decontaminate.clean(d, b, max_broadcast=limit).columns == d.columns


def test_a_large_item_set_digest():
    assert decontaminate.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()


def lm_brute(docs, train, order, mu):
    """Scores by plain recursion over dictionaries."""
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w]
    seqs = {k: ["<s>", *low(t), "</s>"] for k, (_, t) in enumerate(docs)}
    grams = [Counter() for _ in range(order + 1)]
    for k, s in seqs.items():
        if train[k]:
            for n in range(1, order + 1):
                grams[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
    one = {g: c for g, c in grams[1].items() if g != ("<s>",)} if order else {}
    total, types = sum(one.values()), len(one)

    def prob(h, w):
        if not h:
            return (one.get((w,), 0) + 0.1) / (total + 0.1 * (types + 1))
        c = grams[len(h)].get(tuple(h), 0)
        return (grams[len(h) + 1].get((*h, w), 0) + mu * prob(h[1:], w)) / (c + mu)

    out = []
    for k, (i, _) in enumerate(docs):
        s = seqs[k]
        base = sum(math.log10(prob([], w)) for w in s[1:])
        score = sum(math.log10(prob(s[max(0, j - order + 1) : j], s[j])) for j in range(1, len(s)))
        out.append((i, len(s) - 1, sum(one.get((w,), 0) > 0 for w in s[1:]), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "blocks", "entries"), [(2, 300, 40), (3, 10**6, 10**6), (1, 100, 100)])
def test_lm_matches_plain_recursion(spark, texts, order, blocks, entries):
    docs = [(i, t) for i, t in texts if not t or len(t) < 5000]
    rows = [(i, t, 3, (i or 1) % 3 != 0) for i, t in docs]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, block int, fold boolean")
    got = backoff_lm.score_texts(d, F.col("fold"), order=order, mu=2.0, block_chars=blocks, bucket_entries=entries)
    got = sorted(((*r[:4], round(r[4], 6), round(r[5], 6)) for r in map(tuple, got.collect())), key=str)
    assert got == lm_brute(docs, [r[3] for r in rows], order, 2.0)


def test_lm_probabilities_add_up(spark):
    """Over the vocabulary, the unseen word and the end, what follows a word sums to one."""
    vocab = ["a", "b", "c"]
    rows = [(1, "a b a c", True), (2, "b a", True)] + [(10 + k, f"a {w}".strip(), False) for k, w in enumerate([*vocab, "new", ""])]
    got = {r.doc_id: r for r in backoff_lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, f boolean"), F.col("f")).collect()}
    # p(a w </s>) / p(w </s> | ...) isn't observed alone, so compare by the model's own formula
    one = {"a": 3, "b": 2, "c": 1, "</s>": 2}
    base = lambda w: (one.get(w, 0) + 0.1) / (8 + 0.1 * 5)
    two = {("a", "b"): 1, ("a", "c"): 1, ("a", "</s>"): 1}
    p = lambda w: (two.get(("a", w), 0) + 4 * base(w)) / (3 + 4)
    assert abs(sum(map(p, [*vocab, "</s>", "new"])) - 1) < 1e-9
    assert got[14].n_tokens == 2 and got[13].n_known == 2


def test_lm_empty(spark, no_docs):
    assert backoff_lm.score_texts(no_docs, F.lit(True)).count() == 0
    d = no_docs.sparkSession.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = backoff_lm.score_texts(d, F.lit(False)).first()
    assert (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 3)


def test_discriminant_learns_and_is_stable():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 24)), rng.normal(0, 3, (200, 24))])
    y = np.r_[np.ones(300), np.zeros(200)]
    m = quality.fit(x, y)
    s = m.score(x)
    assert ((s >= 0.5) == y).mean() > 0.95 and ((s >= 0) & (s <= 1)).all()
    # against the textbook density with the same shrunk covariance
    z = np.clip((x - m.centre) / m.scale, -8, 8)
    full = []
    for mean, f, d in zip(m.means, m.factors, m.log_dets):
        inv = f.T @ f
        full.append(-0.5 * np.einsum("ij,jk,ik->i", z - mean, inv, z - mean) - 0.5 * d)
        assert abs(np.linalg.slogdet(inv)[1] + d) < 1e-6
    assert np.allclose(full[1] - full[0], m.margin(x))
    assert quality.fit(np.empty((0, 24)), np.empty(0)).score(np.zeros((2, 24))).tolist() == [0.5, 0.5]
    assert quality.fit(x[:3], np.ones(3)).score(x[:1]).tolist() == [1.0]


def test_quality_on_tables(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 1, "x"), (4, 1, "x"), (11, 0, "x"), (5, 0, "x"), (None, 1, "x"), (7, None, "x"), (999, 0, "x")], "doc_id bigint, quality int, text string")
    model = quality.learn(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in texts), key=str)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[5] == by[6]  # null is empty
    kept = quality.keep(docs, model, 0.7)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.score >= 0.7), key=str)
    assert quality.score(no_docs, model).count() == 0
    assert quality.learn(no_docs, labels, F.lit(True)).share == 0.5


def test_quality_query_on_held_out_labels(spark):
    """The query's scores, against labels that it hasn't seen."""
    from graphloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL")
    got = rows.selectExpr("count(*) AS n", "avg(cast((score >= 0.5) = (quality = 1) AS int)) AS right").first()
    assert got["n"] > 50 and got["right"] >= 0.95
