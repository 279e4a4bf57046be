"""Session helpers shared by tests, bench and scripts."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine is tested under.

    On a cluster, callers bring their own session; nothing in the library
    depends on the values set here.
    """
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables; a file or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``; one of our own is set only where there is none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a table to the reliable checkpoint folder: its lineage ends here."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_file(spark: SparkSession, what: str) -> str:
    """URI of a file to be, in the checkpoint folder that all executors share."""
    return f"{_checkpoint_dir(spark)}/graphloom-{what}-{uuid.uuid4().hex}"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith(("/", "file:")) else fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes | pa.Buffer) -> None:
    """Write a whole file; it is there entirely or not at all."""
    place, path = _at(uri)
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with place.open_output_stream(part) as f:
        f.write(data)
    place.move(part, path)


def get_file(uri: str) -> bytes:
    place, path = _at(uri)
    with place.open_input_file(path) as f:
        return f.read()
