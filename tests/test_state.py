import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from foldmark.model import DELETE, MUTATION, PUT, checked
from foldmark.operators import runs, state
from foldmark.sources.table import KVTable, due_level
from foldmark.sources.wal import WriteAheadLog, encode_record
from foldmark.streaming.ingest import drain, ingest, mutation_stream, streaming_fold

KEYS = st.sampled_from([b"", b"\x00", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff", b"\xff\xff"])
OPS = st.lists(st.tuples(KEYS, st.sampled_from([b"", b"1", b"2", b"\xff"])), max_size=40)


def log_of(spark, ops):
    return spark.createDataFrame([(i, DELETE if not v else PUT, bytearray(k), bytearray(v)) for i, (k, v) in enumerate(ops)], MUTATION)


def as_dict(df):
    return {bytes(r.key): bytes(r.val) for r in df.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=OPS, width=st.integers(1, 9), cut=st.integers(0, 40))
def test_state_is_a_dict_whatever_the_runs(spark, ops, width, cut):
    model, snap = {}, {}
    for i, (k, v) in enumerate(ops):
        model[k] = v
        if i <= cut:
            snap[k] = v
    alive = {k: v for k, v in model.items() if v}
    log = log_of(spark, ops)
    assert as_dict(state.live(log)) == alive
    assert as_dict(state.deleted(log)) == {k: v for k, v in model.items() if not v}
    assert as_dict(state.snapshot(log, cut)) == {k: v for k, v in snap.items() if v}
    run = runs.flush(log.withColumn("gen", log.seq / width))
    assert as_dict(runs.tiered_get(run)) == alive
    assert as_dict(runs.compact(run)) == model and as_dict(runs.compact(run, True)) == alive
    half = runs.compact(run.filter(run.file_seq < 2)).unionByName(run.filter(run.file_seq >= 2))
    assert as_dict(runs.tiered_get(half)) == alive


def test_lookups_order_and_overlay(spark):
    log = log_of(spark, [(b"b", b"1"), (b"a", b"2"), (b"b", b"3"), (b"c", b"4"), (b"c", b""), (b"d", b""), (b"", b"e"), (b"\xff", b"f")])
    assert as_dict(state.get(log, b"b")) == {b"b": b"3"} and as_dict(state.get(log, "c")) == {} and as_dict(state.get(log, b"")) == {b"": b"e"}
    probes = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"c", b"x")], "key binary")
    for few in (False, True):
        assert {bytes(r.key): r.found for r in state.multi_get(log, probes, few).collect()} == {b"a": True, b"c": False, b"x": False}
    assert {bytes(r.key) for r in state.contains(probes, log).collect()} == {b"a"}
    assert {bytes(r.key) for r in state.absent(probes, log).collect()} == {b"c", b"x"}
    assert [bytes(r.key) for r in state.scan(log).collect()] == [b"", b"a", b"b", b"\xff"]
    assert [bytes(r.key) for r in state.scan(log, b"a", b"b").collect()] == [b"a"]
    newer, older = log_of(spark, [(b"a", b"")]), log_of(spark, [(b"a", b"1"), (b"b", b"2")])
    assert as_dict(state.overlay(newer, older)) == {b"a": b"", b"b": b"2"}


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    runs.write_run(log_of(spark, [(b"a", b"1"), (b"b", b"2")]), str(tmp_path / "r"), 2)
    plan = state.get(spark.read.parquet(str(tmp_path / "r")), b"a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def test_limits(spark):
    for k, v in ((b"k" * 65536, b""), (b"k", b"v" * (4 << 20))):
        with pytest.raises(PySparkException):
            checked(log_of(spark, [(k, v)])).select("key").collect()
    assert checked(log_of(spark, [(b"k" * 65535, b"v")])).count() == 1


def test_rotation_counts_first_inserts_only(spark):
    log = log_of(spark, [(b"a", b"123"), (b"a", b"1" * 99), (b"b", b"123"), (b"c", b"123"), (b"a", b"1"), (b"d", b"12")]).withColumn("w", log_w())
    got = [r.gen for r in runs.rotations(log, "w", 8).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1]
    sizes = {r.gen: r.bytes for r in runs.buffer_bytes(log.withColumn("gen", log.seq * 0)).collect()}
    assert sum(sizes.values()) == 4 + 4 + 4 + 3


def log_w():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_table(spark, tmp_path):
    t = KVTable(spark, str(tmp_path / "t"))
    assert t.get(b"a") is None and t.versions() == []
    t.apply(log_of(spark, [(b"a", b"1"), (b"b", b"2"), (b"", b"0"), (b"gone", b"x")]))
    t.put(b"a", b"3")
    t.delete(b"gone")
    t.delete(b"never")
    assert (t.get(b"a"), t.get(b"gone"), t.get(b""), t.get(b"never")) == (b"3", None, b"0", None)
    assert t.get(b"a", version=1) == b"1" and t.get(b"gone", version=1) == b"x"
    before = as_dict(t.live())
    version = t.compact(drop_deleted=True)
    assert as_dict(t.live()) == before == {b"a": b"3", b"b": b"2", b"": b"0"} and len(t.manifest()["runs"]) == 1
    assert len(t.obsolete()) == 4 and len(t.vacuum()) == 4 and t.versions() == [version]
    again = KVTable(spark, str(tmp_path / "t"))
    assert as_dict(again.live()) == before
    probes = spark.createDataFrame([(bytearray(b"a"), "x"), (bytearray(b"gone"), "x")], "key binary, val string")
    assert {bytes(r.key): (r.val, r.found) for r in t.multi_get(probes).collect()} == {b"a": (b"3", True), b"gone": (None, False)}
    with pytest.raises(ValueError):  # deletes are gone, so what they overwrote must not come late
        t.apply(log_of(spark, [(b"gone", b"late")]))
    t.put(b"gone", b"new")
    assert t.get(b"gone") == b"new" and len(t.versions()) == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=OPS.filter(lambda o: len(o) > 2), order=st.randoms(use_true_random=False), parts=st.integers(2, 4), replays=st.integers(0, 2))
def test_table_is_the_fold_whatever_the_batches(spark, tmp_path_factory, ops, order, parts, replays):
    log = log_of(spark, ops)
    t = KVTable(spark, str(tmp_path_factory.mktemp("t") / "t"))
    batches = list(range(parts))
    order.shuffle(batches)
    for number, part in enumerate(batches):
        t.apply(log.filter(log.seq % parts == part), number, "s")
    before = t.manifest()["version"]
    for number in range(replays):
        assert t.apply(log.filter(log.seq % parts == batches[number]), number, "s") == before
    t.apply(log.filter(log.seq % parts == batches[0]))  # and once more without a number
    want = {k: v for k, v in as_dict(state.fold(log)).items() if v}
    assert as_dict(t.live()) == want and all(t.get(k) == want.get(k) for k in list(want)[:1])
    t.compact_if_due(2, 1, 2)
    assert as_dict(t.live()) == want and len(t.manifest()["runs"]) == 1
    assert {r.key: r.seq for r in t.live().collect()} == {r.key: r.seq for r in state.live(log).collect()}


def test_levels_and_commits(spark, tmp_path):
    run = lambda level, rows: {"level": level, "rows": rows}
    assert due_level([], 4, 100, 10) is None and due_level([run(0, 1)] * 3, 4, 100, 10) is None
    assert due_level([run(0, 1)] * 4, 4, 100, 10) == 0 and due_level([run(0, 1), run(1, 100)], 4, 100, 10) == 1
    assert due_level([run(1, 99), run(2, 999)], 4, 100, 10) is None and due_level([run(2, 1000)], 4, 100, 10) == 2
    t = KVTable(spark, str(tmp_path / "t"))
    t.put(b"a", b"1")
    old = t.manifest()
    t.put(b"a", b"2")
    assert t._commit(old) == 3  # a number is never given twice
    (tmp_path / "t" / "manifest" / "v4.json").write_text("{")  # a writer that died
    assert t.versions() == [1, 2, 3] and t.manifest()["version"] == 3 and t._commit(t.manifest()) == 5
    rows = KVTable(spark, str(tmp_path / "t")).inspected(2).orderBy("file_seq").collect()
    assert [(r.level, r.entries, r.deletes, r.last_seq) for r in rows] == [(0, 1, 0, 1), (0, 1, 0, 2)]


def test_log_folder(spark, tmp_path):
    log = WriteAheadLog(spark, str(tmp_path / "log")).open()
    assert log.read().count() == 0 and log.sync() is None
    log.append(PUT, b"a", b"1")
    log.append(PUT, b"b", b"2")
    assert log.read().count() == 0  # nothing counts before the commit
    first = log.sync()
    log.append(DELETE, b"b")
    log.close()
    (tmp_path / "log" / log.segments()[-1]).write_bytes(encode_record(DELETE, b"b", b"") + b"\xa1torn")
    (tmp_path / "log" / f".{log.segments()[-1]}.crc").unlink()  # the local store's own checksum
    again = WriteAheadLog(spark, str(tmp_path / "log")).open()
    assert (tmp_path / "log" / again.segments()[-1]).read_bytes() == encode_record(DELETE, b"b", b"")
    again.append(PUT, b"c", b"3")
    again.close()
    assert len(again.segments()) == 3 and first == again.segments()[0]
    t = KVTable.open(spark, str(tmp_path / "t"), str(tmp_path / "log"))
    assert as_dict(t.live()) == {b"a": b"1", b"c": b"3"}
    assert as_dict(KVTable.open(spark, str(tmp_path / "t"), str(tmp_path / "log")).live()) == {b"a": b"1", b"c": b"3"}


def test_key_order_and_clashing_names(spark):
    log = log_of(spark, [(b"user:%d" % i, b"v") for i in range(300)] + [(b"", b"v"), (b"\xff", b"v")])
    got = {bytes(r.key): r.pos for r in state.key_order(state.live(log)).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))} and len(got) == 302
    from pyspark.sql import functions as F

    odd = log.withColumn("__rank", F.lit("own"))
    assert {r["__rank"] for r in state.fold_by_rank(odd, [F.col("seq")], ["key"]).collect()} == {"own"}
    moved = [(r.a, r.b) for r in log.select(state.key_shard(F.col("key"), 5).alias("a"), state.key_shard(F.col("key"), 6).alias("b")).collect()]
    assert all(b in (a, 5) for a, b in moved) and len({a for a, _ in moved}) == 5


def test_drained_stream(spark, tmp_path):
    log = log_of(spark, [(bytes([97 + i % 5]), str(i).encode()) for i in range(40)])
    log.repartition(4).write.parquet(str(tmp_path / "in"))
    t = KVTable(spark, str(tmp_path / "t"))
    q = ingest(mutation_stream(spark, str(tmp_path / "in"), 1), t, str(tmp_path / "cp"), "100 milliseconds", compact={"runs_at_0": 2})
    drain(q)
    assert not q.isActive and as_dict(t.live()) == as_dict(state.live(log)) and len(t.manifest()["runs"]) <= 2


def test_streaming_equals_batch(spark, tmp_path):
    ops = [(bytes([97 + i % 7]), b"" if i % 5 == 0 else str(i).encode()) for i in range(60)]
    log = log_of(spark, ops)
    for part in range(3):
        log.filter(log.seq % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_fold(stream).writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert as_dict(spark.table("folded")) == as_dict(state.fold(log))
    table = KVTable(spark, str(tmp_path / "t"))
    q = ingest(stream, table, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert as_dict(table.live()) == as_dict(state.live(log))
