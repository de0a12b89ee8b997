"""State of a mutation log: fold, lookups, overlays, snapshots, scans, replay.

The fold is one aggregation on the key with partial sums before its only shuffle. A predicate on the key reaches the
scan below it; the test for deletes stands above it, since an older value must not come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.model import not_deleted

#: Rows of probes that may be broadcast.
BROADCAST_PROBES = 100_000


def fold(log: DataFrame, order: str = "seq") -> DataFrame:
    """key, val and order of each key's newest mutation, deletes included."""
    return log.groupBy("key").agg(F.max_by("val", order).alias("val"), F.max(order).alias(order))


def fold_by_rank(log: DataFrame, order: list[Column], key: list[str]) -> DataFrame:
    """The whole newest row of each key, for wide rows and composite keys."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    name = "__rank"
    while name in map(str.lower, log.columns):
        name += "_"
    return log.withColumn(name, rank).filter(F.col(name) == 1).drop(name)


def live(log: DataFrame, order: str = "seq") -> DataFrame:
    return fold(log, order).filter(not_deleted())


def deleted(log: DataFrame, order: str = "seq") -> DataFrame:
    return fold(log, order).filter(~not_deleted())


def get(log: DataFrame, key: bytes | str) -> DataFrame:
    """No row or one. The filter on the key is pushed below the fold into the scan."""
    return live(log.filter(F.col("key") == F.lit(key.encode() if isinstance(key, str) else bytes(key))))


def _probes(probes: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(probes) if few else probes


def multi_get(log: DataFrame, probes: DataFrame, few: bool = False) -> DataFrame:
    """key, val (null if absent) and found for each probe row. few: the caller has checked the number of probes against
    BROADCAST_PROBES; the log is then cut to the probed keys before the fold, without a shuffle of the rest."""
    probes = probes.drop("val", "found")
    own = log.join(_probes(probes.select("key").distinct(), few), "key", "left_semi")
    return probes.join(live(own).select("key", "val"), "key", "left").withColumn("found", F.col("val").isNotNull())


def _present(probes: DataFrame, log: DataFrame, few: bool) -> DataFrame:
    """The live keys among probes. The log is cut to them before the fold."""
    return live(log.join(_probes(probes.select("key").distinct(), few), "key", "left_semi")).select("key")


def contains(probes: DataFrame, log: DataFrame, few: bool = False) -> DataFrame:
    return probes.join(_present(probes, log, few), "key", "left_semi")


def absent(probes: DataFrame, log: DataFrame, few: bool = False) -> DataFrame:
    return probes.join(_present(probes, log, few), "key", "left_anti")


def few_probes(probes: DataFrame) -> bool:
    """Whether probes are few enough to be broadcast, by a count that stops at the bound."""
    return probes.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES


def key_order(state: DataFrame) -> DataFrame:
    """key and pos, its place in byte order from 1. Keys are dealt out by ranges, and the counts of the ranges, a row for
    each partition, give where each begins; so no task sees all keys, whatever they begin with."""
    from foldmark.sources.scratch import written

    keys = written(state.select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "key-ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    begin = keys.groupBy("part").count().select("part", (F.sum("count").over(upto) - F.col("count")).alias("begin"))
    pos = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return keys.join(F.broadcast(begin), "part").select("key", (F.col("begin") + pos).alias("pos"))


def key_shard(key: Column, shards: int) -> Column:
    """The shard of a key by rendezvous hashing (roadmap operator): that for which the MD5 of shard and key is greatest. With one
    shard more, keys move only into that one."""
    weight = lambda i: F.struct(F.md5(F.concat(i.cast("string").cast("binary"), F.lit(b":"), key)).alias("w"), i.alias("i"))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), weight))["i"]


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (key, val, seq) with a batch of mutations on top."""
    return fold(state.select("seq", "key", "val").unionByName(batch.select("seq", "key", "val")))


def overlay(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Two tiers (key, val): a key in the newer one hides the older, even if it is deleted there."""
    return newer.select("key", "val").unionByName(older.join(newer, "key", "left_anti").select("key", "val"))


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """State as of a sequence number (roadmap operator)."""
    return live(log.filter(F.col("seq") <= seq))


def scan(log: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Live keys with start <= key < end in byte order (roadmap operator); None leaves a side open."""
    if start is not None:
        log = log.filter(F.col("key") >= F.lit(bytes(start)))
    if end is not None:
        log = log.filter(F.col("key") < F.lit(bytes(end)))
    return live(log).orderBy("key")


def unexpired(state: DataFrame, expires: str, now: int) -> DataFrame:
    """Rows of a state whose expiry lies after now; null never expires (roadmap operator). After the fold only."""
    return state.filter(F.col(expires).isNull() | (F.col(expires) > now))


def secondary_index(state: DataFrame, attribute: Column) -> DataFrame:
    """(attribute, key) of live rows (roadmap operator)."""
    return state.select(attribute.alias("attribute"), "key")


def replay(requests: DataFrame) -> DataFrame:
    """Requests (seq, op, key, val): each get's value as of its place in the log, null if not found.

    A window on the key; puts and deletes before a get are seen, later ones are not.
    """
    from foldmark.model import DELETE, GET, PUT

    value = F.when(F.col("op") == PUT, F.col("val")).when(F.col("op") == DELETE, F.lit("").cast("binary"))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = requests.withColumn("seen", seen).filter(F.col("op") == GET)
    return rows.select("seq", "key", F.when(F.octet_length("seen") > 0, F.col("seen")).alias("val"))
