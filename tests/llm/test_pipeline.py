import corpus_pipeline
import numpy as np
import pandas as pd
from graphloom.llm import decontaminate, packing, quality, queries
from graphloom.llm.tokens import Encoder
from pyspark.sql import functions as F

from .test_dedup import brute

DIR = "/root/testdata/sf0.001"


def test_pipeline_matches_its_parts_by_brute_force(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    bench = pd.read_parquet(f"{DIR}/benchmark.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    model = quality.learn(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"), fold)
    x = np.array([quality.statistics(t) for t in docs.text])
    rows = [(int(i), t) for i, t, s in zip(docs.doc_id, docs.text, model.score(x)) if s >= 0.7]
    rows = [(i, t) for (i, t), (j, c) in zip(rows, sorted(brute(rows), key=lambda r: r[0])) if j == c]
    known = decontaminate.Windows([(str(i), decontaminate.words(t)) for i, t in zip(bench.item_id, bench.text)], 13)
    kept = {}
    for i, t in rows:
        w = decontaminate.words(t)
        hit, _ = known.scan(w, decontaminate._hashed(w, decontaminate.Hashes()))
        if not (hit.sum() and 20 * hit.sum() >= len(w)):
            kept[i] = decontaminate.without(t, hit)
    enc = Encoder(queries.tokenizer("word_bpe_49k.json"))
    want = {i: [*enc.ids(t).tolist(), 2] for i, t in kept.items()}
    got = {}
    for r in corpus_pipeline.run(spark, DIR).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
    assert packing.GROUP > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "related_packing"]


def test_every_llm_query_is_registered_and_runs_small(spark):
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in e.queries()
