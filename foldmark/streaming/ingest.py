"""Streaming ingestion: keyed state as a streaming aggregation, and micro-batches committed as runs.

A micro-batch is what a group commit is for a log: its rows become visible together, once. The checkpoint and the manifest's
batch id make a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.model import MUTATION
from foldmark.sources.table import KVTable


def streaming_fold(log: DataFrame) -> DataFrame:
    """Newest value of each key over a stream; run it in update or complete mode. Order of arrival doesn't matter."""
    return log.groupBy("key").agg(F.max_by("val", "seq").alias("val"), F.max("seq").alias("seq"))


def mutation_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of mutation files (seq, op, key, val). files_per_batch bounds what one micro-batch takes, so a burst waits in
    the folder and not in memory: the backpressure of this engine."""
    reader = spark.readStream.schema(MUTATION)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def ingest(log: DataFrame, table: KVTable, checkpoint: str, processing_time: str | None = None, compact: dict | None = None):
    """Write each micro-batch of a mutation stream as a run. Without processing_time all that is there is taken, then it stops.

    The manifest keeps each batch's number under the checkpoint's name: a batch that is replayed after a failure is not
    written again. Batches may hold older mutations than those before them. compact: arguments of
    KVTable.compact_if_due(), which is called after each batch.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.apply(batch, number, checkpoint)
            if compact is not None:
                table.compact_if_due(**compact)

    writer = log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()


def drain(query) -> None:
    """Stop a running ingestion once all that has arrived is committed."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
