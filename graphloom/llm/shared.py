"""Files and tables in the folder that all executors share.

The folder is the one named in ``spark.checkpoint.dir``; a folder of our own is
set only where that is unset (local tests). Files are written under temporary
names and renamed, so a task that runs again replaces its own work.
"""

from __future__ import annotations

import atexit
import ctypes
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext, suppress
from functools import wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold 1/HOT_SHARE of all rows or more.
HOT_SHARE = 1000
SALTS = 64


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; also set as the checkpoint folder."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not uri:
        have = sc._jsc.sc().getCheckpointDir()
        uri = have.get() if have.isDefined() else None
    if not uri:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        uri = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(uri)
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    return uri.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for one call; removed when the driver's Python ends."""
    uri = f"{shared_root(spark)}/graphloom-{what}-{uuid.uuid4().hex[:12]}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    atexit.register(remove, uri)
    return uri


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    fs, path = open_fs(uri)
    with suppress(OSError):
        fs.delete_dir(path)


def put(uri: str, data: bytes) -> None:
    """Write a whole file; it is there entirely or not at all."""
    fs, path = open_fs(uri)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives back to the system what it has freed: workers stay for the next stages."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch of the jobs run meanwhile; wide rows would fill a worker's memory otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch(spark, what)}/t"
    with batches_of(spark, batch_rows) if batch_rows else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (out, path.removesuffix("/t"))
    return out


#: Tables written by materialise, by the identity of the frame that reads them.
_PLACES: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read any more."""
    for t in tables:
        found = _PLACES.pop(id(t), None)
        if found:
            remove(found[1])


def salted_left_join(rows: DataFrame, table: DataFrame, key: str, count: str, spread: list[str]) -> DataFrame:
    """Left join of rows to a table with one row a key, where few keys may hold most rows.

    ``table[count]`` is the number of ``rows`` with that key. Keys with at least
    1/HOT_SHARE of all rows are at most HOT_SHARE in number, so the table of them
    can be broadcast at any size of the input; their rows are spread over SALTS
    by ``spread``. ``table`` should be materialised. Drops ``count``.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    bar = max(1000, total // HOT_SHARE)
    hot = table.where(F.col(count) >= bar).select(key, F.lit(True).alias("_gl_hot"))
    assert hot.count() <= HOT_SHARE
    salt = F.when(F.col("_gl_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_gl_salt", salt).drop("_gl_hot")
    salts = F.when(F.col(count) >= bar, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = table.withColumn("_gl_salt", F.explode(salts)).drop(count)
    return left.join(right, [key, "_gl_salt"], "left").drop("_gl_salt")


def ranged(rows: DataFrame, order: list[Column], order_type: str, parts: int | None = None) -> DataFrame:
    """Rows spread over ranges of ``order``, partition k holding the k-th range; the same rows in each on every run.

    ``order`` are columns of the types in ``order_type`` ("a int, b bigint"), none null. Bounds
    are quantiles of the keys whose hash is small, about 100 a range, so they depend on the rows and
    on the number of ranges alone (by default the session's number of shuffle partitions). Rows of
    equal keys are in one range.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in order_type.split(",")]
    key = F.struct(*[c.alias(n) for c, n in zip(order, names)])
    most = min(1.0, 100 * parts / max(1, rows.count()))
    some = rows.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(most * (1 << 30)))
    found = sorted((tuple(r["k"]), r["count"]) for r in some.groupBy("k").count().collect())
    total, upto, bounds = sum(n for _, n in found), 0, []
    for k, n in found:
        if upto * parts >= (len(bounds) + 1) * total:
            bounds.append(k)
        upto += n
    known = F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in bounds])), f"array<struct<{order_type.replace(' ', ':').replace(',:', ',')}>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) <= key), at + s).otherwise(at))
    return rows.repartitionById(parts, place if bounds else F.lit(0))
