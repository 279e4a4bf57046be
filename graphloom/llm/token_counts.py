"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes empty;
nothing that could alter a count is folded) within the partition of the cache
that carries the digest of the tokenizer's file. Stored counts are joined by
key; of the misses, one text a key is encoded, and their counts are appended.

Defined results: a null text counts as empty and has 0 tokens; rows that repeat
each get their row; a null id is kept; an empty table gives an empty table;
other columns are ignored. A task or job that runs again may append a key
twice, which readers fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise, open_fs, salted_left_join
from graphloom.llm.tokens import encoder, file_digest

CACHE = "digest binary, n_tokens bigint, tokenizer string"


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row a digest."""
    fs, path = open_fs(cache)
    if fs.get_file_info(path).type.name == "NotFound":
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    ``cache`` is the URI of a Parquet folder that all executors share; it is
    made at the first append.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # One row a digest: how many rows hold it, and one row that stands for them; combined before the shuffle.
    keys = materialise(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "keys")
    misses = materialise(keys.join(read_cache(spark, cache, version), "digest", "left_anti").select("digest", "doc_id"), "misses")
    if not misses.isEmpty():
        same = F.col("r.digest") == F.col("m.digest")
        todo = rows.alias("r").join(misses.alias("m"), same & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc, done = encoder(tokenizer), set()
            for b in batches:
                digests, texts = [], []
                for digest, text in zip(b["digest"].to_pylist(), b["text"]):
                    if digest not in done:  # repeated rows
                        done.add(digest)
                        digests.append(digest)
                        texts.append(text.as_py())
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(map(len, enc.many(texts)), pa.int64())], ["digest", "n_tokens"])

        found = todo.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens bigint")
        found.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = keys.select("digest", "n").join(read_cache(spark, cache, version), "digest")
    every = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    counts = materialise(counts, "counts")
    out = salted_left_join(every, counts, "digest", "n", ["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
