"""Functions on bytes as column expressions: FNV-1a, CRC32 of log records, big-endian numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's 64-bit offset basis by halves, and its prime 2**40 + 435.
FNV_LOW, FNV_HIGH, FNV_PRIME_LOW = 0x84222325, 0xCBF29CE4, 435
LOW32 = 0xFFFFFFFF


def fnv1a(data: Column) -> Column:
    """FNV-1a 64 as a struct of its low and high 32 bits, each a long. Halves keep all products under 2**63, so it
    holds under ANSI arithmetic."""
    hexed = F.hex(data.cast("binary"))
    n = F.call_function("div", F.length(hexed), F.lit(2)).cast("int")
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substr(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(FNV_LOW).cast("long").alias("lo"), F.lit(FNV_HIGH).cast("long").alias("hi"))

    def step(a: Column, b: Column) -> Column:
        low = a["lo"].bitwiseXOR(b)
        product = low * FNV_PRIME_LOW
        high = (a["hi"] * FNV_PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(LOW32))
        return F.struct(product.bitwiseAND(F.lit(LOW32)).alias("lo"), high.alias("hi"))

    return F.aggregate(each, start, step)


def fnv1a_hex(data: Column) -> Column:
    h = F.transform(F.array(fnv1a(data)), lambda x: F.concat(F.lpad(F.hex(x["hi"]), 8, "0"), F.lpad(F.hex(x["lo"]), 8, "0")))
    return h[0]


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def from_big_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned number in bytes at, at + 1, ... (from 0) of a binary column, for sizes up to 7."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def record_crc(op: Column, key: Column, val: Column) -> Column:
    """CRC32 (IEEE) over opcode, key length, value length, key and value of a log record."""
    return F.crc32(F.concat(big_endian(op, 1), big_endian(F.octet_length(key), 2), big_endian(F.octet_length(val), 4), key, val))


def record_bytes(op: Column, key: Column, val: Column) -> Column:
    """A whole log record: magic, checksum, opcode, lengths, key, value."""
    head = F.concat(big_endian(op, 1), big_endian(F.octet_length(key), 2), big_endian(F.octet_length(val), 4))
    return F.concat(F.unhex(F.lit("A1")), big_endian(record_crc(op, key, val), 4), head, key, val)
