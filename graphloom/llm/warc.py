"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id over ranges, so shard k holds the k-th range and
the archives are the same whatever ran first, given the number of ranges (the
session's shuffle partitions). Of records whose payloads are
equal, the one of the smallest page_id is a ``response``; the others are
``revisit`` records that carry headers only. Each record is its own gzip
member; a file is closed once its compressed size reaches ``roll_bytes``. Dates
are a parameter; record ids, HTTP headers and digests are made anew.

A task writes its files under temporary names, renames them, and then writes
its manifest; readers see only files that a manifest names, so a task that was
lost half-way leaves nothing to be read.

Defined results: a null html is an empty payload; a null url is written as
``urn:none``; a null page_id sorts first, is the first of its group and is
written without a page number; rows that repeat are kept, and of rows that share
the smallest page_id and payload the first is the response; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import get, materialise, put, ranged, salted_left_join

MANIFEST = "shard bigint, path string, n_records bigint, n_bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_URN = "<urn:uuid:67726170-686c-8f6d-{:04x}-{:012x}>"


def record_id(page_id: int | None) -> str:
    """A record's id; it holds the page_id, so that references lead back to it."""
    if page_id is None:
        return "<urn:uuid:00000000-0000-8000-8000-000000000000>"
    n = page_id & (2**64 - 1)
    return _URN.format(n >> 48, n & (2**48 - 1))


def page_of(urn: str) -> int | None:
    a, b, c, d, e = urn.strip("<>").removeprefix("urn:uuid:").split("-")
    if a == "00000000":
        return None
    n = int(d + e, 16)
    return n - 2**64 if n >= 2**63 else n


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed. A revisit needs no payload: its size and digest are given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    target = "".join(c if c > " " else "%20" for c in url) if url else "urn:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc.gz file, member by member."""
    at, step = 0, 1 << 16
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data) if z.unused_data else min(at, len(data))
        raw = b"".join(parts)
        head, _, after = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = after[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
            raise ValueError("a record's block doesn't match its digest")
        yield fields, block


def write_warc(pages: DataFrame, out: str, min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record a row under ``out``; returns the manifest, a row a file."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "same": F.unhex(F.sha2("payload", 256))})
    # The first page of each payload that several rows have; the rest need no look-up.
    groups = rows.where(F.col("size") >= min_revisit_bytes).groupBy("same").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    groups = materialise(groups.where("n > 1").select("same", "n", F.when(F.col("nulls") == 0, F.col("first")).alias("first"), F.lit(True).alias("found")), "payloads")
    rows = salted_left_join(rows, groups, "same", "n", ["page_id", "url"])
    # A copy's payload isn't moved, unless a twin row shares the smallest page_id.
    copy = F.coalesce("found", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "copy": copy}).withColumn("payload", F.when(~F.col("copy"), F.col("payload")))
    order = [F.col("page_id").asc_nulls_first(), F.xxhash64("same"), F.col("same"), F.coalesce("url", F.lit(""))]
    key = [F.col("page_id").isNotNull().cast("int"), F.coalesce("page_id", F.lit(0).cast("bigint")), F.xxhash64("same")]
    rows = rows.select("page_id", "url", "payload", "size", "digest", "copy", "found", "first", "same")
    rows = ranged(rows, key, "there int, id bigint, tie bigint").sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size, count, before, done = TaskContext.get().partitionId(), [], 0, 0, None, []

        def roll() -> None:
            nonlocal held, size, count
            path = f"{out}/part-{shard:06d}-{len(done):05d}.warc.gz"
            put(path, b"".join(held))
            done.append((shard, path, count, size))
            held, size, count = [], 0, 0

        for b in batches:
            for page, null, url, data, n, hexed, copy, found, first, fnull, same in zip(b["page_id"], b["page_id"].isna(), b["url"], b["payload"], b["size"], b["digest"], b["copy"], b["found"], b["first"], b["first"].isna(), b["same"]):
                page = None if null else int(page)
                twin = found is True and (page, same) == before
                before = (page, same)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                one = gzip_member(record(page, url, data, int(n), digest, None if fnull else int(first), bool(copy) or twin, date), level)
                held.append(one)
                size, count = size + len(one), count + 1
                if size >= roll_bytes:
                    roll()
        if held:
            roll()
        if done:
            put(f"{out}/manifest-{shard:06d}.json", json.dumps(done).encode())
        yield pd.DataFrame(done, columns=["shard", "path", "n_records", "n_bytes"])

    return materialise(rows.mapInPandas(write, MANIFEST), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row a record of the files that the manifest names; digests are checked against the payloads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                out = []
                for head, block in read_records(get(path)):
                    revisit = head["WARC-Type"] == "revisit"
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    if not revisit and (len(body) != size or base32_sha1(body) != digest):
                        raise ValueError("a payload doesn't match its digest")
                    out.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None))
                yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInPandas(read, RECORDS)
