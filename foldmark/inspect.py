"""python -m foldmark.inspect log|runs|filter PATH: what is in a log folder, a table or a stored Bloom filter."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession


def inspected(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """log: the records of the files under path, up to the first bad one of each; runs: the runs of a table's newest version;
    filter: parameters of the filters stored in the files under path, and how many of their bits are set."""
    from pyspark.sql import functions as F

    from foldmark.operators.skipping import bloom_decoded
    from foldmark.sources import wal
    from foldmark.sources.table import KVTable

    if kind == "runs":
        return KVTable(spark, path).inspected()
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if kind == "log":
        return wal.inspected(files)
    if kind == "filter":
        words = bloom_decoded(files.select(F.col("content").alias("filter")))
        return words.groupBy("k", "m").agg(F.sum(F.bit_count("bits")).alias("bits_set"))
    raise ValueError(f"{kind}: log, runs or filter are known")


if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit(__doc__)
    inspected(SparkSession.builder.getOrCreate(), *sys.argv[1:]).show(1000, truncate=False)
