"""Helpers that several corpus operators use: tables, staged tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Seconds to wait for the figures of a written table, which a busy driver may drop, before they are read from the table.
FIGURES_WAIT = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="foldmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the staged tables that are there, oldest first.
_staged: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: lost executors cost no recomputation of what lies before, the planner sees the real
    size, and what was decided once (samples, range bounds) stays decided. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldmark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _kept(spark, df, path)


def measured(df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
    """staged(df) and figures that are taken while it is written, without another job: bytes, as small() measures them, and
    what the aggregates `more` give."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/foldmark-{name}-{uuid.uuid4().hex}"
    exprs = [_bytes(df).alias("bytes"), *[c.alias(k) for k, c in more.items()]]
    df.observe(seen, *exprs).write.parquet(path)
    out, until = _kept(spark, df, path), time.monotonic() + FIGURES_WAIT
    while not (there := seen._jo.future().isCompleted()) and time.monotonic() < until:
        time.sleep(0.005)
    return out, (there and seen.get) or out.agg(*exprs).first().asDict()


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """df staged, and all tables that were staged since the mark (see mark()) gone: what led to df is not needed again."""
    out = staged(df, name)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in _staged[since:-1]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _staged[since:-1]
    return out


def mark() -> int:
    return len(_staged)


def small(df: DataFrame, most: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows take at most `most` bytes, else df as it is, which joins by a shuffle.

    The bytes are measured, which reads df: hand in a staged table, or the `size` that measured() has found.
    """
    total = df.agg(_bytes(df).alias("bytes")).first()[0] if size is None else size
    return F.broadcast(df) if total <= most else df


def _bytes(df: DataFrame) -> Column:
    """The bytes of df's rows: 16 and 8 for each column of a row, and what strings, binaries and arrays hold besides."""
    sizes = [F.count(F.lit(1)) * (16 + 8 * len(df.columns))]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.sum(F.octet_length(F.col(f"`{name}`"))))
        elif kind.startswith("array"):
            sizes.append(F.sum(F.greatest(F.size(F.col(f"`{name}`")), F.lit(0))) * 8)
    return sum(F.coalesce(x, F.lit(0)) for x in sizes)


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, after each task of which its Python worker gives freed memory back. Idle workers stay
    for a minute, so what they hold would count in the stages that follow."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and, where the C library can, its heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def bare(df: DataFrame, taken: set[str], prefix: str = "__") -> str:
    """A column name that neither df nor taken has, compared without case."""
    have = {c.lower() for c in df.columns} | {c.lower() for c in taken}
    name = prefix
    while name.lower() in have:
        name += "_"
    return name


def free(df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    """Names for new columns: those given, with underscores after one that df has already."""
    out: list[str] = []
    for name in names:
        out.append(bare(df, set(out), name))
    return tuple(out)
