"""Token ids as bit or byte planes: a sharded binary format with an index.

A shard holds whole documents in ascending doc_id order. Its ids are cut into
blocks of a fixed number; each block is transposed into planes (plane p of a
bit block is bit p of every id, of a byte block byte p), planes that are all
zero are left out, and each other plane is compressed with zstandard.

    magic | planes of block 0 | planes of block 1 | ... | index (zstd JSON + arrays) | index length (8 bytes) | magic

The index has, for each block, its number of ids and each plane's length, and
for each document its id and number of ids. A shard is closed at ``roll`` bytes, so
a task holds no more than that and one block, or one document's planes, if those are
larger. It is written under a temporary name and renamed. Its name and content
follow from the rows and the number of ranges, so a task that runs again
replaces the same file.

Defined results: a null text counts as empty (the end id alone); null ids sort
first; rows that repeat are kept, in order of id, then text; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import get, materialise, put, ranged
from graphloom.llm.tokens import encoder

MAGIC = b"GLPLANE1"
MANIFEST = "shard bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first; zero planes are empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [raw[:, p] for p in range(4)]
    else:
        planes = [np.packbits((raw[:, p // 8] >> (p % 8)) & 1, bitorder="little") for p in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for p, data in enumerate(planes):
        if not data:
            continue
        plane = np.frombuffer(data, np.uint8)
        if kind == "byte":
            out[:, p] = plane
        else:
            out[:, p // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (p % 8)
    return out.reshape(-1).view("<u4")


def write_shards(docs: Iterator[tuple[int | None, np.ndarray]], kind: str = "byte", block: int = 65536, level: int = 3, roll: int = 64 << 20) -> Iterator[tuple[bytes, int, int]]:
    """Each shard's bytes, its number of documents and of ids."""
    z = zstandard.ZstdCompressor(level=level)
    body, blocks, ids, counts, packed_size = [MAGIC], [], [], [], 0
    held: list[np.ndarray] = []
    size = 0

    def flush(n: int) -> None:
        nonlocal size, packed_size
        whole = np.concatenate(held) if len(held) > 1 else held[0]
        for at in range(0, n, block):
            take = whole[at : min(at + block, n)]
            packed = [z.compress(p) if p else b"" for p in to_planes(take, kind)]
            body.extend(packed)
            blocks.append([len(take), *map(len, packed)])
            packed_size += sum(blocks[-1][1:])
        held[:] = [whole[n:]] if len(whole) > n else []
        size -= n

    def close() -> tuple[bytes, int, int]:
        nonlocal body, blocks, ids, counts, packed_size
        if size:
            flush(size)
        index = z.compress(json.dumps({"kind": kind, "block": block, "blocks": blocks, "doc_ids": ids, "counts": counts}, separators=(",", ":")).encode())
        out = b"".join([*body, index, len(index).to_bytes(8, "little"), MAGIC]), len(ids), sum(counts)
        body, blocks, ids, counts, packed_size = [MAGIC], [], [], [], 0
        return out

    for doc_id, x in docs:
        ids.append(doc_id)
        counts.append(len(x))
        held.append(x)
        size += len(x)
        if size >= block:
            flush(size - size % block)
        if packed_size + 2 * size + 16 * len(ids) >= roll:
            yield close()
    if ids:
        yield close()


def write_shard(docs: Iterator[tuple[int | None, np.ndarray]], kind: str = "byte", block: int = 65536, level: int = 3) -> tuple[bytes, int, int]:
    """All documents as one shard."""
    return next(write_shards(docs, kind, block, level, 1 << 62))


def read_shard(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a shard, in order, one block at a time."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a whole shard")
    n = int.from_bytes(data[-16:-8], "little")
    index = json.loads(zstandard.ZstdDecompressor().decompress(data[-16 - n : -16]))
    z, at, have, k = zstandard.ZstdDecompressor(), 8, np.empty(0, "<u4"), 0
    for doc_id, count in zip(index["doc_ids"], index["counts"]):
        parts, got = [have], len(have)
        while got < count:
            m, *lengths = index["blocks"][k]
            planes = []
            for length in lengths:
                planes.append(z.decompress(data[at : at + length]) if length else b"")
                at += length
            parts.append(from_planes(planes, m, index["kind"]))
            got, k = got + m, k + 1
        whole = np.concatenate(parts) if len(parts) > 1 else have
        yield doc_id, whole[:count]
        have = whole[count:]


def write_ids(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = 0, kind: str = "byte", block: int = 65536, roll: int = 64 << 20) -> DataFrame:
    """Encode every text, write shards in ascending doc_id order under ``out``; returns the manifest.

    Partitions are ranges of doc_id, each one shard or more; the manifest has a row a shard.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ties are split by a hash, so rows that share an id can't fill one partition.
    rows = rows.withColumn("tie", F.xxhash64("text"))
    key = [F.col("doc_id").isNotNull().cast("int"), F.coalesce("doc_id", F.lit(0).cast("bigint")), F.col("tie")]
    rows = ranged(rows, key, "there int, id bigint, tie bigint").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4")

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in batches:
                for doc_id, null, ids in zip(b["doc_id"], b["doc_id"].isna(), enc.many(b["text"])):
                    yield None if null else int(doc_id), np.concatenate([ids.astype("<u4"), end])

        for k, (data, n_docs, n_ids) in enumerate(write_shards(each(), kind, block, roll=roll)):
            path = f"{out}/part-{shard:06d}-{k:05d}.planes"
            put(path, data)
            yield pd.DataFrame({"shard": [(shard << 32) + k], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [len(data)]})

    return materialise(rows.mapInPandas(write, MANIFEST), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of every document, from the files.

    ``start`` counts the ids of all documents before: a running sum over the
    manifest, which has one small row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    return _decode(shards, "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>", lambda ids: ids.astype(np.int64), "ids")


def digest_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    return _decode(shards, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32")


def _decode(shards: DataFrame, schema: str, value, name: str) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base in zip(b["path"], b["base"]):
                at, out = int(base), []
                for doc_id, ids in read_shard(get(path)):
                    out.append((doc_id, at, len(ids), value(ids)))
                    at += len(ids)
                    if len(out) >= 1000:
                        yield _frame(out, name)
                        out = []
                if out:
                    yield _frame(out, name)

    # One shard a task at most: the files are what is large, not their rows.
    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    return shards.select("path", "base").repartition(max(n, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInPandas(read, schema)


def _frame(rows: list[tuple], name: str) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", name])
    return df.astype({"doc_id": "Int64"})
