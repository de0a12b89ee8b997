"""The data model: opaque byte keys and values, and the mutation log they are changed by.

A delete is a put of an empty value; a value is never null. The newest mutation of a key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ECHO, PUT, GET, DELETE = 1, 2, 3, 4
FRAME_MAGIC, RECORD_MAGIC = 0xA1, 0xA1
FRAME_HEADER, RECORD_HEADER = 8, 12
MAX_KEY, MAX_FRAME = 65_535, 4 << 20
FLUSH_BYTES, BLOCK_BYTES = 4 << 20, 4096

MUTATION = "seq long, op byte, key binary, val binary"
RUN = "file_seq long, op byte, key binary, val binary"
#: What a table's runs hold: late mutations are told from new ones by seq.
TABLE_RUN = RUN + ", seq long"


def mutations(df: DataFrame, seq: Column, key: Column, val: Column, op: Column | None = None) -> DataFrame:
    """A mutation log; null values and those of deletes become empty."""
    op = F.when(F.octet_length(F.coalesce(val, F.lit(""))) == 0, DELETE).otherwise(PUT) if op is None else op
    empty = F.when(op == DELETE, F.lit("").cast("binary")).otherwise(F.coalesce(val.cast("binary"), F.lit("").cast("binary")))
    return df.select(seq.cast("long").alias("seq"), op.cast("byte").alias("op"), key.cast("binary").alias("key"), empty.alias("val"))


def checked(log: DataFrame) -> DataFrame:
    """The log, failing on keys over 65,535 bytes or null, and on key and value over 4 MiB together."""
    size = F.octet_length("key")
    bad = F.col("key").isNull() | (size > MAX_KEY) | (size + F.octet_length("val") > MAX_FRAME)
    return log.withColumn("key", F.when(bad, F.raise_error(F.lit("key or frame is too long")).cast("binary")).otherwise(F.col("key")))


def not_deleted(val: str = "val") -> Column:
    return F.octet_length(val) > 0
