import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldmark.functions.bytes import fnv1a_hex, record_bytes
from foldmark.model import DELETE, ECHO, GET, PUT
from foldmark.operators import skipping
from foldmark.sources import frames, wal


@pytest.mark.parametrize("data, want", [("A101000400000008", (ECHO, 4, 8)), ("0001000400000008", frames.BadMagic), ("A1010004", frames.ShortBuffer), ("", frames.ShortBuffer)])
def test_header(data, want):
    if isinstance(want, tuple):
        assert frames.parse_header(bytes.fromhex(data)) == want
    else:
        with pytest.raises(want):
            frames.parse_header(bytes.fromhex(data))


def test_frames_stop_where_the_connection_closes():
    ok = frames.encode_frame(ECHO, b"test", b"payload")
    assert frames.frames(ok + ok) == [(ECHO, b"test", b"payload")] * 2
    assert frames.frames(ok + b"\x00" + ok) == [(ECHO, b"test", b"payload")]
    assert frames.frames(ok + ok[:-1]) == [(ECHO, b"test", b"payload")]
    big = frames.encode_frame(PUT, b"k", b"v" * (4 << 20))
    assert frames.frames(big + ok) == []
    assert len(frames.frames(frames.encode_frame(PUT, b"k", b"v" * ((4 << 20) - 1)) + ok)) == 2


def test_responses(spark):
    req = [(1, ECHO, b"test", b"payload"), (2, GET, b"a", b"ignored"), (3, PUT, b"a", b"1"), (4, GET, b"a", b""), (5, DELETE, b"a", b"x"), (6, GET, b"a", b""), (7, 9, b"a", b""), (8, PUT, b"a", b""), (9, GET, b"a", b""), (10, PUT, b"", b"e"), (11, GET, b"", b"")]
    got = {r.seq: bytes(r.response) for r in frames.responses(spark.createDataFrame([(s, o, bytearray(k), bytearray(v)) for s, o, k, v in req], "seq long, op byte, key binary, val binary")).collect()}
    assert got[1] == frames.encode_frame(ECHO, b"test", b"payload")
    assert [got[i] for i in (2, 6, 7, 9)] == [frames.NOT_FOUND] * 4
    assert [got[i] for i in (3, 5, 8, 10)] == [frames.ACK] * 4
    assert got[4] == frames.encode_frame(GET, b"a", b"1") and got[11] == frames.encode_frame(GET, b"", b"e")


def test_parsed_frames(spark):
    good = frames.encode_frame(PUT, b"k\xff", b"v")
    rows = frames.parsed(spark.createDataFrame([(bytearray(x),) for x in (good, b"\x00" + good[1:], good[:5], good + b"x")], "frame binary")).collect()
    assert [(r.op, bytes(r.key), bytes(r.val)) for r in rows] == [(PUT, b"k\xff", b"v")]


LOG = [(PUT, b"key1", b"val1"), (DELETE, b"key1", b""), (PUT, b"", b"e"), (GET, b"g", b"put by recovery"), (PUT, b"\xff\x00", b"\x80" * 40)]


def test_log_round_trip_and_every_torn_tail(spark, tmp_path):
    data = b"".join(wal.encode_record(*r) for r in LOG)
    ends = [end for *_, end in wal.records(data)]
    assert ends[-1] == len(data) and wal.valid_prefix(b"") == 0
    for cut in range(len(data) + 1):
        assert wal.valid_prefix(data[:cut]) == max([0, *[e for e in ends if e <= cut]])
    flipped = data[:-1] + bytes([data[-1] ^ 0xFF])
    assert wal.valid_prefix(flipped) == ends[-2] and wal.truncated(flipped) == data[: ends[-2]]
    with pytest.raises(wal.BadMagic):
        list(wal.records(data[: ends[1]] + b"\x00" * 12))
    (tmp_path / "a.wal").write_bytes(data)
    (tmp_path / "torn.wal").write_bytes(data[:-3])
    rows = wal.read_wal(spark, str(tmp_path)).collect()
    assert len(rows) == 9
    got = [(r.op, bytes(r.key), bytes(r.val)) for r in sorted(rows, key=lambda r: r.seq) if r.file.endswith("a.wal")]
    assert got == [(DELETE if o == DELETE else PUT, k, v) for o, k, v in LOG]


def test_huge_length_costs_nothing():
    assert list(wal.records(b"\xa1" + bytes(4) + b"\x02\x00\x01\xff\xff\xff\xff" + b"k")) == []


def test_records_by_functions(spark):
    rows = [(i, o, bytearray(k), bytearray(v)) for i, (o, k, v) in enumerate([*LOG, (PUT, b"k" * 65535, b"")])]
    df = spark.createDataFrame(rows, "seq long, op byte, key binary, val binary").select("seq", record_bytes(F.col("op"), F.col("key"), F.col("val")).alias("r"))
    assert {r.seq: bytes(r.r) for r in df.collect()} == {i: wal.encode_record(o, bytes(k), bytes(v)) for i, o, k, v in rows}
    assert zlib.crc32(b"123456789") == 3421780262


def test_fnv(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b""),), (bytearray(b"\xff\x00\x80"),)], "key binary").select("key", fnv1a_hex(F.col("key")).alias("h"))

    def plain(b):
        h = 14695981039346656037
        for x in b:
            h = (h ^ x) * 1099511628211 % (1 << 64)
        return f"{h:016X}"

    got = {bytes(r.key): r.h for r in df.collect()}
    assert got[b"hello"] == "A430D84680AABD0B" and all(h == plain(k) for k, h in got.items())


def test_bloom(spark):
    assert [skipping.bloom_size(n, 0.01) for n in (100, 1000, 4000, 10000)] == [(959, 7), (9586, 7), (38341, 7), (95851, 7)]
    assert skipping.bloom_size(0, 7) == skipping.bloom_size(1, 0.01)
    m, k = skipping.bloom_size(2000, 0.01)
    keys = spark.range(2000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).cast("binary").alias("key"))
    words = skipping.bloom_build(keys, m, k)
    assert skipping.bloom_probe(keys, words, m, k).filter("NOT maybe").count() == 0
    miss = spark.range(2000, 4000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).cast("binary").alias("key"))
    assert skipping.bloom_probe(miss, words, m, k).filter("maybe").count() <= 0.02 * 2000
    held = {r.word: r.bits for r in words.collect()}
    data = skipping.bloom_encode(held, m, k)
    assert len(data) == 9 + 8 * -(-m // 64)
    assert skipping.bloom_decode(data) == ({i: held.get(i, 0) & (1 << 64) - 1 for i in range(-(-m // 64))}, m, k)
    with pytest.raises(ValueError):
        skipping.bloom_decode(data[:-1])
    stored = skipping.bloom_encoded(words, m, k)
    assert bytes(stored.first()["filter"]) == data
    back = skipping.bloom_decoded(stored).collect()
    assert {(r.k, r.m) for r in back} == {(k, m)} and {r.word: r.bits for r in back} == {i: held.get(i, 0) for i in range(-(-m // 64))}
    with pytest.raises(PySparkException):
        skipping.bloom_decoded(spark.createDataFrame([(bytearray(data[:-1]),)], "filter binary")).collect()


def test_streams_and_inspection(spark):
    ok = frames.encode_frame(PUT, b"k", b"v")
    rows = frames.decoded(spark.createDataFrame([("a", bytearray(ok + ok + ok[:-1])), ("b", bytearray(b"")), ("c", bytearray(b"\x00" + ok))], "path string, content binary")).collect()
    assert sorted((r.path, r.place, r.op) for r in rows) == [("a", 0, PUT), ("a", 1, PUT)]
    data = b"".join(wal.encode_record(*r) for r in LOG)
    bad = data[:-1] + bytes([data[-1] ^ 1])
    seen = wal.inspected(spark.createDataFrame([("x", bytearray(bad)), ("y", bytearray(b"\x00" * 12))], "path string, content binary")).orderBy("path", "place").collect()
    assert [r.valid for r in seen] == [True] * 4 + [False, False] and [r.offset for r in seen][:2] == [0, 20] and seen[-1].magic == 0


def test_inspection_of_files(spark, tmp_path):
    from foldmark.inspect import inspected
    from foldmark.sources.table import KVTable

    (tmp_path / "f").write_bytes(skipping.bloom_encode({0: 7}, 128, 3))
    assert tuple(inspected(spark, "filter", str(tmp_path / "f")).first()) == (3, 128, 3)
    log = wal.WriteAheadLog(spark, str(tmp_path / "log"))
    log.append(PUT, b"k", b"v")
    log.close()
    log.tear(b"\xa1" * 12)
    assert [r.valid for r in inspected(spark, "log", f"{tmp_path}/log/log-*").orderBy("place").collect()] == [True, False]
    KVTable.open(spark, str(tmp_path / "t"), log.path)
    assert inspected(spark, "runs", str(tmp_path / "t")).first().entries == 1
    with pytest.raises(ValueError):
        inspected(spark, "x", str(tmp_path))
