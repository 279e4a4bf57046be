"""One query for each operator of the subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.shared import scratch
    from graphloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), scratch(spark, "count-cache") + "/cache")


@query
def op3_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.bitplanes import digest_ids, write_ids
    from graphloom.llm.shared import scratch

    return digest_ids(write_ids(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), scratch(spark, "planes"), end_id=0))


@query
def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.shared import scratch
    from graphloom.llm.warc import read_warc, write_warc

    return read_warc(write_warc(_table(spark, sf_dir, "pages"), scratch(spark, "warc"))).drop("url")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.llm.decontaminate import report

    rows = report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.llm.quality import learn, score

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, _table(spark, sf_dir, "labels"), fold != 2)
    return score(docs, model).select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.llm.backoff_lm import score_texts

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    rows = score_texts(_table(spark, sf_dir, "documents"), fold != 0)
    return rows.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.llm.hamming import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=10)


ORACLES["op6_hamming_topk"] = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] IS DISTINCT FROM z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM c AS q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


@query
def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.perspectives import rotate

    return rotate(_table(spark, sf_dir, "conversations"))


def _op10_oracle() -> str:
    from graphloom.llm.perspectives import ORACLE

    return ORACLE


ORACLES["op10_perspective_rotation"] = _op10_oracle()


@query
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.dart_minhash import classes

    return classes(_table(spark, sf_dir, "documents"))


@query
def op2_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.llm.packing import pack

    rows = pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, window=4096)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
