"""Request frames: magic 0xA1, opcode, key length (2), value length (4), big-endian; then key and value."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.functions.bytes import big_endian, from_big_endian
from foldmark.model import ECHO, FRAME_HEADER, FRAME_MAGIC, GET, MAX_FRAME
from foldmark.operators.state import replay
from foldmark.sources import pieces
from foldmark.sources.pieces import Feed

ACK = bytes([FRAME_MAGIC, 0, 0, 0, 0, 0, 0, 0])
NOT_FOUND = bytes([FRAME_MAGIC, 0, 0xFF, 0xFF, 0, 0, 0, 0])


class ShortBuffer(ValueError):
    """A header needs eight bytes."""


class BadMagic(ValueError):
    """A frame does not begin with the magic byte."""


def parse_header(data: bytes) -> tuple[int, int, int]:
    """(opcode, key length, value length)."""
    if len(data) < FRAME_HEADER:
        raise ShortBuffer(len(data))
    magic, op, klen, vlen = struct.unpack_from(">BBHI", data)
    if magic != FRAME_MAGIC:
        raise BadMagic(hex(magic))
    return op, klen, vlen


def encode_frame(op: int, key: bytes = b"", val: bytes = b"") -> bytes:
    return struct.pack(">BBHI", FRAME_MAGIC, op, len(key), len(val)) + key + val


def frames(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """The requests of one connection's bytes, up to a bad magic, an oversized or an incomplete frame, where it closes."""
    return list(read(Feed([data], len(data))))


def read(feed: Feed) -> Iterator[tuple[int, bytes, bytes]]:
    """As frames(), one after the other."""
    while feed.left >= FRAME_HEADER:
        data, at = feed.peek(FRAME_HEADER)
        magic, op, klen, vlen = struct.unpack_from(">BBHI", data, at)
        size = FRAME_HEADER + klen + vlen
        if magic != FRAME_MAGIC or klen + vlen > MAX_FRAME or size > feed.left:
            return
        data, at = feed.peek(size)
        key_at = at + FRAME_HEADER
        feed.skip(size)
        yield op, data[key_at : key_at + klen], data[key_at + klen : at + size]


def headers(df: DataFrame, frame: str = "frame") -> DataFrame:
    """df with op, key_len, val_len and valid of a binary column, by built-in functions."""
    ok = (F.octet_length(frame) >= FRAME_HEADER) & (F.hex(F.substring(frame, 1, 1)) == "A1")
    part = lambda at, n: F.when(ok, from_big_endian(F.col(frame), at, n))
    return df.withColumns({"op": part(1, 1), "key_len": part(2, 2), "val_len": part(4, 4), "valid": ok})


def parsed(df: DataFrame, frame: str = "frame") -> DataFrame:
    """df with op, key and val of whole frames; others are dropped, as a connection closes without a response."""
    df = headers(df, frame).filter("valid")
    df = df.filter((F.col("key_len") + F.col("val_len") <= MAX_FRAME) & (F.octet_length(frame) == FRAME_HEADER + F.col("key_len") + F.col("val_len")))
    cut = lambda at, n: F.substr(F.col(frame), at.cast("int"), n.cast("int"))
    return df.withColumn("key", cut(F.lit(FRAME_HEADER + 1), F.col("key_len"))).withColumn("val", cut(FRAME_HEADER + 1 + F.col("key_len"), F.col("val_len"))).drop("key_len", "val_len", "valid")


def responses(requests: DataFrame) -> DataFrame:
    """seq and response of requests (seq, op, key, val): echo gives the frame back, put and delete an ack, get the key and
    value as of its place or not-found, an unknown opcode not-found. Value bytes of gets and deletes are ignored."""
    whole = F.concat(F.lit(bytes([FRAME_MAGIC])), big_endian(F.col("op"), 1), big_endian(F.octet_length("key"), 2), big_endian(F.octet_length("val"), 4), "key", "val")
    plain = requests.filter(F.col("op") != GET).select("seq", F.when(F.col("op") == ECHO, whole).when(F.col("op").isin(2, 4), F.lit(ACK)).otherwise(F.lit(NOT_FOUND)).alias("response"))
    found = F.concat(F.lit(bytes([FRAME_MAGIC, GET])), big_endian(F.octet_length("key"), 2), big_endian(F.octet_length("val"), 4), "key", "val")
    return plain.unionByName(replay(requests).select("seq", F.coalesce(found, F.lit(NOT_FOUND)).alias("response")))


def decoded(streams: DataFrame) -> DataFrame:
    """The requests of connections' byte streams, (path, content) or (path, part, content): path, place, op, key, val. A connection
    closes at a wrong magic byte, an oversized or an incomplete frame, and what comes after is not read. One task reads a stream, as
    framing is sequential, in pieces; many are read side by side."""
    rows = lambda path, feed: ((path, i, *frame) for i, frame in enumerate(read(feed)))
    return pieces.decoded(streams, rows, "path string, place long, op int, key binary, val binary")


def frame_bytes(op, key, val):
    """A request as a binary column."""
    return F.concat(F.lit(bytes([FRAME_MAGIC])), big_endian(op, 1), big_endian(F.octet_length(key), 2), big_endian(F.octet_length(val), 4), key, val)
