import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldmark.model import DELETE, GET, PUT
from foldmark.plans import catalogue
from foldmark.sources import frames, pieces, wal

REQUESTS = [(PUT, b"k%d" % i, b"v" * (20_000 if i % 900 == 0 else i % 7)) for i in range(5000)]


@pytest.fixture(scope="module")
def streams(spark):
    """Two connections: one of all requests, one that breaks off within a long frame."""
    rows = [(f, i, bytearray(frames.encode_frame(*r))) for f, own in (("a", REQUESTS), ("b", REQUESTS[:2701])) for i, r in enumerate(own)]
    rows[-1] = (*rows[-1][:2], rows[-1][2][:-1])
    return pieces.joined(spark.createDataFrame(rows, "c string, seq long, record binary").repartition(3), "c").cache()


def test_no_row_holds_a_whole_stream(streams):
    longest = sum(len(frames.encode_frame(*r)) for r in REQUESTS[:1024])
    assert streams.filter("path = 'a'").count() == 5
    assert streams.agg(F.max(F.octet_length("content"))).first()[0] <= longest
    assert pieces.pieces(streams).agg(F.max(F.octet_length("content"))).first()[0] == 8192


def test_parts_give_the_stream_in_order(streams):
    rows = frames.decoded(streams).collect()
    got = {p: [(r.place, r.op, bytes(r.key), bytes(r.val)) for r in rows if r.path == p] for p in "ab"}
    assert got == {"a": [(i, *r) for i, r in enumerate(REQUESTS)], "b": [(i, *r) for i, r in enumerate(REQUESTS[:2700])]}


def test_whole_streams_of_one_path_stay_apart(spark):
    data = bytearray(b"".join(frames.encode_frame(*r) for r in REQUESTS))
    rows = frames.decoded(spark.createDataFrame([("a", data), ("a", data[:-1]), ("a", bytearray())], "path string, content binary").coalesce(1)).collect()
    assert [r.place for r in rows] == [*range(5000), *range(4999)]


def test_numbers_below_zero_and_none_come_first(spark):
    rows = [("a", n, bytearray(frames.encode_frame(GET, b"%d" % (n or 0)))) for n in (5000, None, -1, -5000, 1023, -(1 << 63))]
    got = frames.decoded(pieces.joined(spark.createDataFrame(rows, "c string, seq long, record binary"), "c")).orderBy("place").collect()
    assert [int(r.key) for r in got] == [0, -(1 << 63), -5000, -1, 1023, 5000]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64])
def test_frames_across_borders_of_pieces(n):
    ok = b"".join(frames.encode_frame(PUT, b"key%d" % i, b"v" * i) for i in range(30))
    for data in (ok, ok[:-1], ok + b"\x00" * 9, ok + frames.encode_frame(PUT, b"k", b"v" * (4 << 20)), b"", ok + b"\xa1"):
        cut = [data[i : i + n] for i in range(0, min(len(data), 2000), n)] + [data[2000:]]
        assert list(frames.read(pieces.Feed(cut, len(data)))) == frames.frames(data)


def test_python_holds_a_batch_of_rows():
    seen = []

    def rows(n, size):
        for i in range(n):
            seen.append(i)
            yield i, b"x" * size

    batches = pieces.batched(rows(100_000, 10), "place long, val binary")
    assert next(batches).num_rows == len(seen) == 8192  # the rest is not read before it is asked for
    assert sum(b.num_rows for b in batches) == 100_000 - 8192
    assert [b.num_rows for b in pieces.batched(rows(10, 3 << 20), "place long, val binary")] == [2] * 5
    assert pa.Table.from_batches(pieces.batched(rows(3, 1), "place long, val binary")).to_pylist()[2] == {"place": 2, "val": b"x"}


def log_parts(spark, bad):
    """Logs of 3,000 records: a is whole, the record `bad` of b has a wrong checksum."""
    rows = [(f, i, bytearray(wal.encode_record(DELETE if i % 5 == 0 else PUT, b"k%d" % i, b"v" * (9_000 if i % 700 == 1 else i % 5)))) for f in "ab" for i in range(3000)]
    rows[3000 + bad][2][-1] ^= 1
    return pieces.joined(spark.createDataFrame(rows, "c string, seq long, record binary"), "c"), rows


def test_logs_in_parts_are_inspected_to_the_bad_record(spark):
    parts, rows = log_parts(spark, 2500)
    assert parts.count() == 6
    seen = wal.inspected(parts).orderBy("path", "place").collect()
    assert [(r.path, r.place, r.valid) for r in seen] == [("a", i, True) for i in range(3000)] + [("b", i, i < 2500) for i in range(2501)]
    assert seen[2999].offset == sum(len(r) for _, _, r in rows[:2999]) and seen[2999].key_len == 5


def test_logs_in_parts_are_decoded_to_the_bad_record(spark):
    parts, rows = log_parts(spark, 1024)
    got = {p: [(r.seq, r.op, bytes(r.key), r.end) for r in wal.decoded(parts).collect() if r.file == p] for p in "ab"}
    end, want = 0, []
    for _, i, r in rows[:3000]:
        end += len(r)
        want.append((i, DELETE if i % 5 == 0 else PUT, b"k%d" % i, end))
    assert got == {"a": want, "b": want[:1024]}


@pytest.mark.parametrize("n", [1, 11, 12, 13, 100])
def test_records_across_borders_of_pieces(n):
    ok = b"".join(wal.encode_record(PUT, b"key%d" % i, b"v" * i) for i in range(30))
    torn = ok + b"\xa1" + bytes(4) + b"\x02\x00\x01\xff\xff\xff\xff" + b"k" * 5000  # a corrupt length: nothing more is read
    for data in (ok, ok[:-1], torn, b"", ok + b"\xa1", ok[:-1] + b"\x00"):
        cut = iter([data[i : i + n] for i in range(0, len(data), n)])
        assert list(wal.read(pieces.Feed(cut, len(data)))) == list(wal.records(data))
        assert data != torn or sum(map(len, cut)) > 4800
    with pytest.raises(wal.BadMagic, match=f"byte {len(ok)} "):
        list(wal.read(pieces.Feed([ok, b"\x00" * 12], len(ok) + 12)))
    assert [w[0] for w in wal.walked(pieces.Feed([ok, b"\x00" * 12], len(ok) + 12))][-1] == len(ok)


def test_events_of_one_number_are_one_record_each(spark, tmp_path):
    """The writers' logs took the square of the events that share a number."""
    spark.createDataFrame([(n, 1, "view") for n in (7, 7, 7, 8, None)], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    rows = wal.decoded(catalogue.logs(spark, str(tmp_path), False)).collect()
    assert sorted(bytes(r.val) for r in rows) == [b"view:7"] * 3 + [b"view:8"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """20,000 events with gaps between their numbers."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("view", "error", "click", "buy"))), (F.col("id") * 7 % 11 % 4 + 1).cast("int"))
    spark.range(20_000).select((F.col("id") * 3 - 5).alias("event_id"), (F.col("id") * 31 % 97).alias("user_id"), kind.alias("event_type")).write.parquet(path)
    return path.removesuffix("/events.parquet")


#: Queries and the streams that they read.
READERS = {
    "kv_frame_stream": catalogue.connections,
    "kv_wal_inspect": lambda spark, d: catalogue.logs(spark, d, True),
    "kv_recover_prefix": lambda spark, d: catalogue.logs(spark, d, True),
    "kv_wal_decode": lambda spark, d: catalogue.logs(spark, d, True),
    "kv_frame_responses": catalogue.connections,
    "kv_recover_clean": lambda spark, d: catalogue.logs(spark, d, False),
}


@pytest.mark.parametrize("name", READERS)
def test_queries_over_streams_of_many_parts(spark, events, name):
    assert READERS[name](spark, events).agg(F.max(F.octet_length("content"))).first()[0] < 1024 * 12  # 342 events or so, an eighth of them each
    df = catalogue.QUERIES[name](spark, events)
    want = duckdb.connect()
    want.sql(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = want.sql(catalogue.ORACLE_SQL[name])
    assert sorted(map(repr, map(tuple, df.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
