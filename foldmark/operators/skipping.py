"""Data skipping: Bloom filters and sparse indexes of sorted runs, as DataFrame operations.

Parquet's own filters and statistics do this in production (see runs.write_run); these give the same bits as the stored
format and serve for inspection and export.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.functions.bytes import fnv1a
from foldmark.model import BLOCK_BYTES


#: Words of a filter that may be broadcast.
BROADCAST_WORDS = 1 << 20


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits m and hashes k for n keys at false-positive rate p; n < 1 counts as 1 and p outside (0, 1) as 0.01."""
    n, p = (n if n > 0 else 1), (p if 0 < p < 1 else 0.01)
    m = math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2))) or 64
    return m, max(1, round(m / n * math.log(2)) & 0xFF)


def bloom_positions(key: Column, m: int, k: int) -> Column:
    """The k positions of a key: (low + i * high) mod m of its FNV-1a hash."""
    return F.flatten(F.transform(F.array(fnv1a(key)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h["lo"] + i * h["hi"], F.lit(m).cast("long")))))


def bloom_build(keys: DataFrame, m: int, k: int, by: list[str] | None = None) -> DataFrame:
    """word and bits (64 of them, as a long) of a filter over column key, for each group of by. Partial ORs come first."""
    p = keys.select(*(by or []), F.explode(bloom_positions(F.col("key"), m, k)).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    return p.groupBy(*(by or []), F.call_function("div", F.col("p"), F.lit(64).cast("long")).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bloom_probe(probes: DataFrame, words: DataFrame, m: int, k: int) -> DataFrame:
    """probes with maybe: false if the key is surely absent. words: a filter's words, m / 64 rows at most."""
    p = probes.withColumn("p", F.explode(bloom_positions(F.col("key"), m, k))).withColumn("word", F.call_function("div", F.col("p"), F.lit(64).cast("long")))
    hit = F.coalesce(F.expr("getbit(bits, CAST(p % 64 AS INT)) = 1"), F.lit(False))
    words = F.broadcast(words) if m // 64 <= BROADCAST_WORDS else words
    return p.join(words, "word", "left").groupBy(*probes.columns).agg(F.bool_and(hit).alias("maybe"))


def bloom_encode(words: dict[int, int], m: int, k: int) -> bytes:
    """k in one byte, m in eight, then each 64-bit word, all big-endian."""
    return bytes([k]) + m.to_bytes(8, "big") + b"".join((words.get(i, 0) & (1 << 64) - 1).to_bytes(8, "big") for i in range(-(-m // 64)))


def bloom_decode(data: bytes) -> tuple[dict[int, int], int, int]:
    if len(data) < 9 or (len(data) - 9) % 8 or (len(data) - 9) // 8 < -(-int.from_bytes(data[1:9], "big") // 64):
        raise ValueError("a Bloom filter of wrong length")
    return {i: int.from_bytes(data[9 + 8 * i : 17 + 8 * i], "big") for i in range((len(data) - 9) // 8)}, int.from_bytes(data[1:9], "big"), data[0]


def bloom_encoded(words: DataFrame, m: int, k: int) -> DataFrame:
    """One row, filter (binary): bloom_encode() of a filter's words, by built-in functions. A filter is one value, so its words
    meet in one row."""
    every = words.sparkSession.range(-(-m // 64)).select(F.col("id").alias("word")).join(words, "word", "left")
    one = F.array_sort(F.collect_list(F.struct("word", F.lpad(F.hex(F.coalesce("bits", F.lit(0).cast("long"))), 16, "0").alias("h"))))
    head = F.concat(F.lpad(F.hex(F.lit(k).cast("long")), 2, "0"), F.lpad(F.hex(F.lit(m).cast("long")), 16, "0"))
    return every.agg(F.unhex(F.concat(head, F.array_join(F.transform(one, lambda x: x["h"]), ""))).alias("filter"))


def bloom_decoded(filters: DataFrame, column: str = "filter") -> DataFrame:
    """k, m, word and bits of encoded filters, a row for each word; a filter of wrong length fails."""
    n = F.octet_length(column)
    whole = (n >= 9) & ((n - 9) % 8 == 0)
    digits = F.when(whole, F.hex(column)).otherwise(F.raise_error(F.lit("a Bloom filter of wrong length")).cast("string"))
    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * (1 << 16)
    rows = filters.select(digits.alias("h"))
    m = number(F.substring("h", 3, 16)) * (1 << 16) + F.conv(F.substring("h", 11, 8), 16, 10).cast("long")
    words = F.regexp_extract_all(F.substr("h", F.lit(19)), F.lit("[0-9A-F]{16}"), F.lit(0))
    rows = rows.select(F.conv(F.substring("h", 1, 2), 16, 10).cast("int").alias("k"), m.alias("m"), F.posexplode(words).alias("word", "w"))
    low, high = F.conv(F.substring("w", 9, 8), 16, 10).cast("long"), F.conv(F.substring("w", 1, 8), 16, 10).cast("long")
    return rows.select("k", "m", "word", F.shiftleft(high, 32).bitwiseOR(low).alias("bits"))


def entry_offsets(run: DataFrame, by: list[str]) -> DataFrame:
    """The byte at which each entry of a sorted run starts: 7 bytes, key and value for each entry before it.
    One window for each run; runs are of bounded size."""
    size = 7 + F.octet_length("key") + F.octet_length("val")
    before = F.sum(size).over(Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def sparse_index(entries: DataFrame, by: list[str], block: int = BLOCK_BYTES) -> DataFrame:
    """The anchors among entries with offsets: the first, then each that starts block bytes or more after the last anchor.
    The choice is greedy, so each run is folded in order by one task; runs are of bounded size and many."""
    schema = entries.select(*by, "key", "offset").schema

    def pick(pdf):
        pdf = pdf.sort_values("offset", kind="stable")
        offsets, at, keep = pdf["offset"].to_numpy(), 0, []
        while at < len(offsets):
            keep.append(at)
            at = int(np.searchsorted(offsets, offsets[at] + block, "left"))
        return pdf.iloc[keep]

    return entries.select(*by, "key", "offset").groupBy(*by).applyInPandas(pick, schema)


def sparse_probe(probes: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """probes with block, the offset of the last anchor whose key is at most theirs; null below the first. An as-of
    lookup by one window over both sides."""
    both = probes.select(*by, "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("side")).unionByName(anchors.select(*by, "key", "offset", F.lit(0).alias("side")))
    w = Window.partitionBy(*by).orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block", F.last("offset", ignorenulls=True).over(w)).filter("side = 1").select(*by, "key", "block")
