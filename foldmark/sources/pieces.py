"""Byte streams of any length, logs or connections, in pieces, and what Python decodes from them in batches.

Framing is sequential, so one task reads a stream; it holds a batch of pieces, the frame at hand and a batch of rows, however long
the stream is. A stream is one row (path, content), as of a file, or many rows (path, part, content) in order of part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A part holds the records of 2**10 numbers, a piece 2**13 bytes.
PART_BITS, PIECE_BITS = 10, 13
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20
_ARROW = {"string": "string", "long": "int64", "int": "int32", "byte": "int8", "binary": "binary", "boolean": "bool"}


def joined(records: DataFrame, by: str, record: str = "record", order: str = "seq") -> DataFrame:
    """(path, part, content) of streams: the records of each value of `by` one after the other, by built-in functions. Only those of
    a part come together in a row."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(record).alias("r"))))
    part = F.coalesce(F.shiftright(F.col(order).cast("long"), PART_BITS), F.lit(-1 << 62))  # null is before all numbers, as in array_sort
    content = F.unhex(F.array_join(F.transform(each, lambda x: x["r"]), ""))
    return records.groupBy(F.col(by).cast("string").alias("path"), part.alias("part")).agg(content.alias("content"))


def pieces(streams: DataFrame) -> DataFrame:
    """(path, part, piece, size, content) of streams (path, content) or (path, part, content), each in one task and in order; size is
    the whole stream's."""
    if "part" in streams.columns:
        whole = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sized = streams.select("path", "part", "content", F.sum(F.octet_length("content").cast("long")).over(whole).alias("size")).sortWithinPartitions("path", "part")
    else:
        sized = streams.select("path", F.lit(0).cast("long").alias("part"), "content", F.octet_length("content").cast("long").alias("size"))
    last = F.shiftright(F.greatest(F.octet_length("content") - 1, F.lit(0)), PIECE_BITS)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("content"), F.shiftleft(i, PIECE_BITS) + 1, F.lit(1 << PIECE_BITS)))
    return sized.select("path", "part", "size", F.posexplode(cut).alias("piece", "content"))


class Feed:
    """The bytes of a stream that comes in pieces. It holds one piece, or as many as give the bytes asked for."""

    def __init__(self, pieces: Iterable[bytes], size: int):
        self._pieces, self._data, self._at = iter(pieces), b"", 0
        self.place, self.left = 0, size

    def peek(self, n: int) -> tuple[bytes, int]:
        """(data, at): the next n bytes, of those left, are data[at : at + n]."""
        if self._at + n > len(self._data):
            held = [self._data[self._at :]] if self._at < len(self._data) else []
            have = sum(map(len, held))
            while have < n:
                held.append(piece := next(self._pieces))
                have += len(piece)
            self._data, self._at = b"".join(held), 0
        return self._data, self._at

    def skip(self, n: int) -> None:
        self._at += n
        self.place += n
        self.left -= n


def feeds(batches: Iterable) -> Iterator[tuple[str, Feed]]:
    """(path, feed) of each stream in Arrow batches of pieces(). A feed ends when the next one is taken."""

    def numbered():
        n, last, place = 0, None, None
        for b in batches:
            for path, part, piece, size, content in zip(*(b.column(c).to_pylist() for c in ("path", "part", "piece", "size")), b.column("content")):
                if place is None or path != last or (part, piece) <= place:
                    n += 1
                last, place = path, (part, piece)
                yield n, path, size, content.as_py()

    for _, rows in groupby(numbered(), lambda r: r[0]):
        _, path, size, content = next(rows)
        yield path, Feed(_chained(content, rows), size)


def _chained(first: bytes, rows: Iterator[tuple]) -> Iterator[bytes]:
    yield first
    for *_, content in rows:
        yield content


def batched(rows: Iterable[tuple], schema: str) -> Iterator:
    """Arrow batches of rows, each of at most BATCH_ROWS rows, and ended by the row that brings its binary values to BATCH_BYTES."""
    import pyarrow as pa

    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    types = [pa.type_for_alias(_ARROW[k]) for k in kinds]
    binary = [i for i, k in enumerate(kinds) if k == "binary"]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], list(names))
    held, size = [], 0
    for row in rows:
        held.append(row)
        for i in binary:
            size += len(row[i])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def decoded(streams: DataFrame, rows: Callable[[str, Feed], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that a function of path and feed gives for each stream."""

    def run(batches):
        return batched((row for path, feed in feeds(batches) for row in rows(path, feed)), schema)

    return pieces(streams).mapInArrow(run, schema)
