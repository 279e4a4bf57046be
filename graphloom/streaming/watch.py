"""Watch a folder: each micro-batch re-runs a batch analysis over all of it.

Analyses are of whole trees, so a change anywhere can alter any row; the batch
result is the truth, and a stream's only state is which files it has seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, root: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], glob: str = "*.dart", interval: str | None = None) -> StreamingQuery:
    """Run ``analyse`` over files(path, source) whenever files come or change.

    With an ``interval`` the query goes on at that pace; without one it works off
    what is there and ends. A batch that runs again gives the same result.
    """
    from graphloom.sources.readers import source_tree

    changes = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            emit(analyse(source_tree(spark, root, glob)), number)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
