"""Sorted runs: generations, flush, tiered reads, compaction, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmark.model import FLUSH_BYTES, PUT, not_deleted


def flush(log: DataFrame, gen: str = "gen") -> DataFrame:
    """file_seq, op, key, val: each generation's newest entry of each key, deletes kept, op always put."""
    rows = log.groupBy(gen, "key").agg(F.max_by("val", "seq").alias("val"))
    return rows.select(F.col(gen).cast("long").alias("file_seq"), F.lit(PUT).cast("byte").alias("op"), "key", "val")


def compact(runs: DataFrame, drop_deleted: bool = False) -> DataFrame:
    """One run of each key's entry with the highest file_seq. drop_deleted is safe only if runs are all there are."""
    newest = F.max_by(F.struct("op", "val"), "file_seq").alias("e")
    out = runs.groupBy("key").agg(newest, F.max("file_seq").alias("file_seq")).select("file_seq", "e.op", "key", "e.val")
    return out.filter(not_deleted()) if drop_deleted else out


def purged(runs: DataFrame) -> DataFrame:
    """How many entries of each run a compaction drops as overwritten."""
    newest = F.max("file_seq").over(Window.partitionBy("key"))
    return runs.withColumn("newest", newest).groupBy("file_seq").agg(F.count_if(F.col("file_seq") < F.col("newest")).alias("purged"))


def tiered_get(runs: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Live value of each key over all tiers, newest first."""
    runs = runs if probes is None else runs.join(probes.select("key").distinct(), "key", "left_semi")
    return runs.groupBy("key").agg(F.max_by("val", "file_seq").alias("val")).filter(not_deleted())


def buffer_bytes(log: DataFrame, gen: str = "gen") -> DataFrame:
    """What the write buffer counts for each generation: key and value of each key's first insert only."""
    first = log.groupBy(gen, "key").agg(F.min_by(F.octet_length("val"), "seq").alias("n"))
    return first.groupBy(gen).agg(F.sum(F.octet_length("key") + F.col("n")).alias("bytes"))


def rotations(log: DataFrame, by: str, limit: int = FLUSH_BYTES) -> DataFrame:
    """log with gen: a new one begins after the mutation by which first inserts of the current one reach limit.

    The count starts anew with each generation, so each writer (a value of by) is folded in order by one task; a task goes over its
    writers' rows batch by batch and holds no more than the keys of one generation. A column gen is replaced.
    """
    import pyarrow as pa

    log = log.drop("gen")
    names = log.columns

    def fold(batches):
        writer, gen, size, seen = object(), 0, 0, set()
        for b in batches:
            out = []
            for who, key, val in zip(b[by].to_pylist(), b["key"].to_pylist(), b["val"].to_pylist()):
                if who != writer:
                    writer, gen, size, seen = who, 0, 0, set()
                out.append(gen)
                if key not in seen:
                    seen.add(key)
                    size += len(key) + len(val)
                if size >= limit:
                    gen, size, seen = gen + 1, 0, set()
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(out, pa.int64())], [*names, "gen"])

    return log.repartition(by).sortWithinPartitions(by, "seq").mapInArrow(fold, log.withColumn("gen", F.lit(0).cast("long")).schema)


def write_run(run: DataFrame, path: str, rows: int, partitions: int | None = None, bloom: bool = True, codec: str = "zstd") -> None:
    """Write a run as Parquet in key order: ranges prune by min and max, misses by the Bloom filter, sized by the row count."""
    ordered = run.repartitionByRange(partitions, "key") if partitions else run.repartitionByRange("key")
    writer = ordered.sortWithinPartitions("key").write.option("compression", codec)
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, rows)))
    writer.parquet(path)


def amplification(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Log, run and live bytes and entries in one row (roadmap operator)."""
    size = F.octet_length("key") + F.octet_length("val")
    a = log.agg(F.count(F.lit(1)).alias("log_entries"), F.sum(size + 12).alias("log_bytes"))
    b = runs.agg(F.count(F.lit(1)).alias("run_entries"), F.sum(size + 7).alias("run_bytes"))
    c = compact(runs, True).agg(F.count(F.lit(1)).alias("live_entries"), F.sum(size + 7).alias("live_bytes"))
    return a.join(b).join(c)
