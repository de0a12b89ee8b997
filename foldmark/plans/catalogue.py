"""All queries by name, each (spark, sf_dir) -> DataFrame, and SQL that gives the same rows.

Most run over the event log: user_id is the key, event_id the order, an `error` deletes. R, D, F and X in the notes:
reachable in the original store, implemented there but unused, only announced there, or an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmark.functions.bytes import fnv1a_hex, record_crc
from foldmark.model import DELETE, ECHO, GET, MUTATION, PUT, mutations
from foldmark.operators import runs, skipping, state
from foldmark.sources import frames, pieces, wal
from foldmark.sources.scratch import shared_path
from foldmark.sources.table import KVTable
from foldmark.streaming import ingest

QUERIES = {}
ORACLE_SQL = {}
BLOOM_M, BLOOM_K = skipping.bloom_size(100, 0.01)

_MUT = """mut AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || CAST(event_id AS VARCHAR) END AS v, event_id // 250 AS gen FROM events)"""
_LIVE = "live AS (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM mut GROUP BY k HAVING arg_max(v, seq) <> '')"
_RUN = "run AS (SELECT gen, k, arg_max(v, seq) AS v FROM mut GROUP BY gen, k)"
_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, [ascii(c)::uhugeint for c in string_split(k, '')]), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
#: CRC32 of the bytes in a hexadecimal string h, with the 256 remainders in tab.t; there is no such function.
_TAB = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda s, b: xor(s // 256, t[(xor(s, b) % 256) + 1])))"
_BE = lambda x, n: f"lpad(printf('%X', ({x})::BIGINT), {2 * n}, '0')"
_BODY = f"CASE WHEN v = '' THEN '04' ELSE '02' END || {_BE('strlen(k)', 2)} || {_BE('strlen(v)', 4)} || hex(encode(k)) || hex(encode(v))"


def query(sql: str | None = None, tables: str = _MUT):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {tables} {sql}" if tables else sql
        return f

    return add


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    own = mutations(e.withColumn("__v", value), F.col("event_id"), F.col("user_id").cast("string"), F.col("__v"))
    return own.withColumn("gen", F.expr("seq DIV 250"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(log(spark, sf_dir))


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("val").cast("string").alias("v"), *more)


@query("SELECT k, v, seq FROM live", f"{_MUT}, {_LIVE}")
def kv_live_state(spark, d):
    """R: fold and delete filter."""
    return shown(state.live(log(spark, d)), "seq")


@query("SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM mut) WHERE r = 1 AND v <> ''")
def kv_live_state_window(spark, d):
    """R: the same by rank."""
    return shown(state.fold_by_rank(log(spark, d), [F.col("seq")], ["key"]).filter(F.octet_length("val") > 0), "seq")


@query("SELECT k, v, seq FROM live WHERE k = '3'", f"{_MUT}, {_LIVE}")
def kv_get_hit(spark, d):
    """R: point lookup; the key filter is pushed into the scan below the fold."""
    return shown(state.get(log(spark, d), "3"), "seq")


@query("SELECT k, v, seq FROM live WHERE k = 'no such key'", f"{_MUT}, {_LIVE}")
def kv_get_miss(spark, d):
    return shown(state.get(log(spark, d), "no such key"), "seq")


@query("SELECT k, seq FROM (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM mut GROUP BY k) WHERE v = ''")
def kv_tombstones(spark, d):
    """R: keys whose newest mutation deletes."""
    return state.deleted(log(spark, d)).select(F.col("key").cast("string").alias("k"), "seq")


_DEAD = "dead AS (SELECT min(k) AS k FROM (SELECT k, arg_max(v, seq) AS v FROM mut GROUP BY k) WHERE v = '')"


@query("SELECT dead.k, live.k IS NOT NULL AS found FROM dead LEFT JOIN live ON live.k = dead.k", f"{_MUT}, {_LIVE}, {_DEAD}")
def kv_get_tombstone(spark, d):
    """R: a get of a deleted key finds nothing, though older values exist."""
    own = log(spark, d)
    probe = state.deleted(own).agg(F.min("key").alias("key"))
    return state.multi_get(own, probe).select(F.col("key").cast("string").alias("k"), "found")


def probes(spark, d):
    e = spark.read.parquet(f"{d}/customer.parquet")
    return e.select(F.col("c_custkey").cast("string").cast("binary").alias("key"))


_PROBES = "probes AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)"


@query("SELECT p.k, v, v IS NOT NULL AS found FROM probes p LEFT JOIN live USING (k)", f"{_MUT}, {_LIVE}, {_PROBES}")
def kv_multi_get(spark, d):
    """R: probes left join state."""
    p = probes(spark, d)
    return shown(state.multi_get(log(spark, d), p, state.few_probes(p)), "found")


@query("SELECT k FROM probes WHERE k IN (SELECT k FROM live)", f"{_MUT}, {_LIVE}, {_PROBES}")
def kv_contains(spark, d):
    p = probes(spark, d)
    return state.contains(p, log(spark, d), state.few_probes(p)).select(F.col("key").cast("string").alias("k"))


@query("SELECT k FROM probes WHERE k NOT IN (SELECT k FROM live)", f"{_MUT}, {_LIVE}, {_PROBES}")
def kv_absent(spark, d):
    p = probes(spark, d)
    return state.absent(p, log(spark, d), state.few_probes(p)).select(F.col("key").cast("string").alias("k"))


_EMPTY = "m2 AS (SELECT seq, k, CASE WHEN v LIKE 'view%' THEN '' ELSE v END AS v FROM mut)"


@query("SELECT k, arg_max(v, seq) AS v FROM m2 GROUP BY k HAVING arg_max(v, seq) <> ''", f"{_MUT}, {_EMPTY}")
def kv_put_empty_is_delete(spark, d):
    """R: a put of an empty value hides the key."""
    own = log(spark, d).withColumn("val", F.when(F.col("val").cast("string").startswith("view"), F.lit("").cast("binary")).otherwise(F.col("val")))
    return shown(state.live(own))


@query("SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM mut GROUP BY k")
def kv_apply_batch(spark, d):
    """R: a state from the first half of generations with the rest applied to it."""
    own = log(spark, d)
    return shown(state.apply_batch(state.fold(own.filter("gen % 2 = 0")), own.filter("gen % 2 = 1")), "seq")


@query("SELECT k, coalesce(n.v, o.v) AS v FROM (SELECT k, arg_max(v, seq) AS v FROM mut WHERE gen >= 2 GROUP BY k) n FULL JOIN (SELECT k, arg_max(v, seq) AS v FROM mut WHERE gen < 2 GROUP BY k) o USING (k)")
def kv_overlay(spark, d):
    """R: a newer tier over an older one, deletes shadowing."""
    own = log(spark, d)
    return shown(state.overlay(state.fold(own.filter("gen >= 2")), state.fold(own.filter("gen < 2"))))


@query("SELECT k, row_number() OVER (ORDER BY k) AS pos FROM live", f"{_MUT}, {_LIVE}")
def kv_key_order(spark, d):
    """R: place of each live key in byte order."""
    return state.key_order(state.live(log(spark, d))).select(F.col("key").cast("string").alias("k"), "pos")


_REPLAY = "req AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, event_type AS t, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN '' ELSE event_type || ':' || CAST(event_id AS VARCHAR) END AS v FROM events), seen AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM req)"


@query("SELECT seq, k, nullif(s, '') AS v FROM seen WHERE t = 'view'", _REPLAY)
def kv_request_replay(spark, d):
    """R: gets among mutations, each answered as of its place."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    op = F.when(F.col("event_type") == "view", GET).when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    req = mutations(e.withColumn("__v", F.concat_ws(":", "event_type", F.col("event_id").cast("string"))), F.col("event_id"), F.col("user_id").cast("string"), F.col("__v"), op)
    return shown(state.replay(req), "seq")


#: Logs of eight writers, by the digits of their keys; in each the first record from nine tenths of the numbers on is corrupt.
_LOGS = "logs AS (SELECT *, CAST(CAST(k AS BIGINT) % 8 AS VARCHAR) AS writer FROM mut), bad AS (SELECT writer, min(seq) AS bad FROM logs WHERE seq >= (SELECT max(seq) FROM mut) * 9 // 10 GROUP BY writer)"


def logs(spark, d, corrupt: bool):
    """(path, part, content) of the writers' log files."""
    rows = log(spark, d).filter("seq IS NOT NULL").withColumn("writer", F.col("key").cast("string").cast("long") % 8)
    records = wal.encoded(rows, "writer")
    if corrupt:
        top = rows.agg(F.expr("max(seq) * 9 div 10").alias("from"))
        bad = records.join(F.broadcast(top), F.col("seq") >= F.col("from")).groupBy("writer").agg(F.min("seq").alias("bad"))
        flipped = F.unhex(F.concat(F.hex(F.substr("record", F.lit(1), F.octet_length("record") - 1)), F.when(F.hex("record").endswith("00"), "01").otherwise("00")))
        records = records.join(F.broadcast(bad), "writer", "left").withColumn("record", F.when(F.col("seq") == F.col("bad"), flipped).otherwise(F.col("record")))
    return pieces.joined(records, "writer")


@query("SELECT k, arg_max(v, seq) AS v FROM logs LEFT JOIN bad USING (writer) WHERE bad IS NULL OR seq < bad GROUP BY k HAVING arg_max(v, seq) <> ''", f"{_MUT}, {_LOGS}")
def kv_recover_prefix(spark, d):
    """R: state from the bytes of logs that each hold a corrupt record: what stands before it counts. A key is in one log."""
    return shown(state.live(wal.decoded(logs(spark, d, True))))


@query("SELECT k, v FROM live", f"{_MUT}, {_LIVE}")
def kv_recover_clean(spark, d):
    """R: state from the bytes of whole logs."""
    return shown(state.live(wal.decoded(logs(spark, d, False))))


@query("SELECT writer AS path, row_number() OVER (PARTITION BY writer ORDER BY seq) - 1 AS seq, CASE WHEN v = '' THEN 4 ELSE 2 END AS op, k, v, CAST(sum(12 + strlen(k) + strlen(v)) OVER (PARTITION BY writer ORDER BY seq) AS BIGINT) AS stop FROM logs LEFT JOIN bad USING (writer) WHERE bad IS NULL OR seq < bad", f"{_MUT}, {_LOGS}")
def kv_wal_decode(spark, d):
    """R: the records of the valid prefix of each log and the byte at which each ends."""
    rows = wal.decoded(logs(spark, d, True))
    return shown(rows, F.col("file").alias("path"), "seq", F.col("op").cast("int").alias("op"), F.col("end").alias("stop"))


@query(f"SELECT writer AS path, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (bad IS NOT NULL AND seq = bad) AS BIGINT) AS bad, CAST(sum(12 + strlen(k) + strlen(v)) FILTER (bad IS NULL OR seq < bad) AS BIGINT) AS good_bytes FROM logs LEFT JOIN bad USING (writer) WHERE bad IS NULL OR seq <= bad GROUP BY writer", f"{_MUT}, {_LOGS}")
def kv_wal_inspect(spark, d):
    """F: what an inspection of log files tells, without failing at the bad record."""
    rows = wal.inspected(logs(spark, d, True))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("valid")).alias("bad"), F.sum(F.when(F.col("valid"), 12 + F.col("key_len") + F.col("val_len"))).alias("good_bytes"))


@query(f"SELECT seq, {_CRC} AS crc FROM (SELECT seq, {_BODY} AS h FROM mut), tab", f"{_MUT}, {_TAB}")
def kv_wal_crc(spark, d):
    """R: checksum of each log record."""
    return log(spark, d).select("seq", record_crc(F.col("op"), F.col("key"), F.col("val")).alias("crc"))


@query(f"SELECT seq, 'A1' || {_BE(_CRC, 4)} || h AS record FROM (SELECT seq, {_BODY} AS h FROM mut), tab", f"{_MUT}, {_TAB}")
def kv_wal_append(spark, d):
    """R: the bytes of each log record."""
    return wal.encoded(log(spark, d)).select("seq", F.hex("record").alias("record"))


#: Requests of eight connections: views get, errors delete, searches or clicks echo, others put.
_REQ = "req AS (SELECT event_id AS seq, CAST(user_id % 8 AS VARCHAR) AS path, CAST(user_id AS VARCHAR) AS k, CASE WHEN event_type = 'view' THEN 3 WHEN event_type = 'error' THEN 4 WHEN event_type = 'click' THEN 1 ELSE 2 END AS op, event_type || ':' || CAST(event_id AS VARCHAR) AS v FROM events)"
_FRAME = lambda op, k, v: f"'A1' || {op} || {_BE(f'strlen({k})', 2)} || {_BE(f'strlen({v})', 4)} || hex(encode({k})) || hex(encode({v}))"


def requests(spark, d):
    """(seq, path, op, key, val)."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    op = F.when(F.col("event_type") == "view", GET).when(F.col("event_type") == "error", DELETE).when(F.col("event_type") == "click", ECHO).otherwise(PUT)
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).cast("string").alias("path"), op.cast("int").alias("op"), F.col("user_id").cast("string").cast("binary").alias("key"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).cast("binary").alias("val"))


def connections(spark, d):
    """(path, part, content) of the connections' bytes."""
    r = requests(spark, d)
    return pieces.joined(r.select("seq", "path", frames.frame_bytes(F.col("op"), F.col("key"), F.col("val")).alias("record")), "path")


@query("SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS place, op, k, v FROM req", _REQ)
def kv_frame_stream(spark, d):
    """R: requests decoded from the byte streams of connections."""
    return shown(frames.decoded(connections(spark, d)), "path", "place", "op")


@query("SELECT seq, op, strlen(k) AS key_len, strlen(v) AS val_len, seq % 10 <> 0 AS valid FROM (SELECT seq, CASE WHEN seq % 10 <> 0 THEN op END AS op, CASE WHEN seq % 10 <> 0 THEN k END AS k, CASE WHEN seq % 10 <> 0 THEN v END AS v FROM req)", _REQ)
def kv_frame_headers(spark, d):
    """R: headers of frames, every tenth of which begins with a wrong byte."""
    r = requests(spark, d)
    frame = frames.frame_bytes(F.col("op"), F.col("key"), F.col("val"))
    bad = F.concat(F.lit(b"\x00"), F.substr(frame, F.lit(2)))
    return frames.headers(r.select("seq", F.when(F.col("seq") % 10 == 0, bad).otherwise(frame).alias("frame"))).select("seq", F.col("op").cast("int").alias("op"), "key_len", "val_len", "valid")


@query(f"SELECT path, place, CASE WHEN op = 1 THEN {_FRAME("'01'", 'k', 'v')} WHEN op IN (2, 4) THEN 'A100000000000000' WHEN coalesce(s, '') = '' THEN 'A100FFFF00000000' ELSE {_FRAME("'03'", 'k', 's')} END AS response FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS place, last_value(CASE op WHEN 2 THEN v WHEN 4 THEN '' END IGNORE NULLS) OVER (PARTITION BY path, k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM req)", _REQ)
def kv_frame_responses(spark, d):
    """R: the bytes that each request of a connection is answered with: echo, ack, value or not found."""
    r = frames.decoded(connections(spark, d))
    r = r.withColumn("seq", F.col("path").cast("long") * F.lit(1 << 40) + F.col("place"))  # a key is on one connection
    out = frames.responses(r.select("seq", "op", "key", "val"))
    return out.select(F.expr("CAST(seq DIV 1099511627776 AS STRING)").alias("path"), F.expr("seq % 1099511627776").alias("place"), F.hex("response").alias("response"))


@query("SELECT CAST(sum(12 + strlen(k) + strlen(v)) AS BIGINT) AS wal_bytes FROM mut")
def kv_wal_size(spark, d):
    return log(spark, d).agg(F.sum(12 + F.octet_length("key") + F.octet_length("val")).alias("wal_bytes"))


@query("SELECT gen, CAST(sum(strlen(k) + n) AS BIGINT) AS bytes FROM (SELECT gen, k, arg_min(strlen(v), seq) AS n FROM mut GROUP BY gen, k) GROUP BY gen")
def kv_memtable_size(spark, d):
    return runs.buffer_bytes(log(spark, d))


@query("SELECT gen AS file_seq, k, v FROM run", f"{_MUT}, {_RUN}")
def kv_flush_runs(spark, d):
    return shown(run_log(spark, d), "file_seq")


@query("SELECT k, arg_max(v, gen) AS v FROM run GROUP BY k HAVING arg_max(v, gen) <> ''", f"{_MUT}, {_RUN}")
def kv_tiered_get(spark, d):
    return shown(runs.tiered_get(run_log(spark, d)))


@query("SELECT writer, seq, gen FROM f", f"{_MUT}, r AS (SELECT CAST(k AS BIGINT) % 8 AS writer, seq, k, strlen(k) + strlen(v) AS n, row_number() OVER (PARTITION BY CAST(k AS BIGINT) % 8 ORDER BY seq) AS i FROM mut), f(writer, i, seq, gen, next, size, seen) AS (SELECT writer, i, seq, 0::BIGINT, CASE WHEN n >= 512 THEN 1 ELSE 0 END::BIGINT, CASE WHEN n >= 512 THEN 0 ELSE n END::BIGINT, CASE WHEN n >= 512 THEN [] ELSE [k] END FROM r WHERE i = 1 UNION ALL SELECT writer, i, seq, gen, CASE WHEN total >= 512 THEN gen + 1 ELSE gen END, CASE WHEN total >= 512 THEN 0 ELSE total END, CASE WHEN total >= 512 THEN [] WHEN is_new THEN list_append(seen, k) ELSE seen END FROM (SELECT r.writer, r.i, r.seq, r.k, f.next AS gen, f.seen, NOT list_contains(f.seen, r.k) AS is_new, CAST(f.size + CASE WHEN list_contains(f.seen, r.k) THEN 0 ELSE r.n END AS BIGINT) AS total FROM f JOIN r ON r.writer = f.writer AND r.i = f.i + 1))")
def kv_rotation_generations(spark, d):
    """R: rotation by size, with a small limit, for each of eight writers."""
    own = log(spark, d).select("seq", "key", "val").withColumn("writer", F.col("key").cast("string").cast("long") % 8)
    return runs.rotations(own, "writer", 512).select("writer", "seq", "gen")


@query("SELECT * FROM (VALUES (100, 959, 7), (1000, 9586, 7), (4000, 38341, 7), (10000, 95851, 7)) t(n, m, k)", "")
def kv_bloom_params(spark, d):
    sizes = [(n, *skipping.bloom_size(n, 0.01)) for n in (100, 1000, 4000, 10000)]
    return spark.createDataFrame(sizes, "n int, m int, k int")


@query(f"SELECT k, lpad(printf('%X', ({_FNV} // 4294967296)::BIGINT), 8, '0') || lpad(printf('%X', ({_FNV} % 4294967296)::BIGINT), 8, '0') AS fnv FROM (SELECT DISTINCT k FROM mut)")
def kv_fnv1a(spark, d):
    return log(spark, d).select("key").distinct().select(F.col("key").cast("string").alias("k"), fnv1a_hex(F.col("key")).alias("fnv"))


_POS = f"h AS (SELECT DISTINCT k, ({_FNV})::UBIGINT AS h FROM mut), pos AS (SELECT k, (((h & 4294967295::ubigint)::hugeint + i * (h >> 32)::hugeint) % {BLOOM_M})::BIGINT AS p FROM h, range({BLOOM_K}) t(i))"


@query("SELECT p // 64 AS word, upper(hex(bit_or((1::ubigint << (p % 64)::ubigint)::ubigint))) AS bits FROM pos GROUP BY p // 64", f"{_MUT}, {_POS}")
def kv_bloom_words(spark, d):
    return skipping.bloom_build(log(spark, d).select("key").distinct(), BLOOM_M, BLOOM_K).select("word", F.hex("bits").alias("bits"))


@query(f"SELECT k, k IN (SELECT k FROM mut) OR (SELECT bool_and(x.p IN (SELECT p FROM pos)) FROM (SELECT (((h & 4294967295::ubigint)::hugeint + i * (h >> 32)::hugeint) % {BLOOM_M})::BIGINT AS p FROM (SELECT ({_FNV})::UBIGINT AS h), range({BLOOM_K}) t(i)) x) AS maybe FROM probes", f"{_MUT}, {_POS}, {_PROBES}")
def kv_bloom_probe(spark, d):
    """R: never false for a key that is there."""
    words = skipping.bloom_build(log(spark, d).select("key").distinct(), BLOOM_M, BLOOM_K)
    return skipping.bloom_probe(probes(spark, d), words, BLOOM_M, BLOOM_K).select(F.col("key").cast("string").alias("k"), "maybe")


_WORDS = "w AS (SELECT word, lpad(upper(hex(b)), 16, '0') AS h FROM (SELECT p // 64 AS word, bit_or((1::ubigint << (p % 64)::ubigint)::ubigint) AS b FROM pos GROUP BY p // 64))"


@query(f"SELECT '{BLOOM_K:02X}' || '{BLOOM_M:016X}' || string_agg(coalesce(h, '0000000000000000'), '' ORDER BY i) AS filter FROM range({-(-BLOOM_M // 64)}) t(i) LEFT JOIN w ON w.word = t.i", f"{_MUT}, {_POS}, {_WORDS}")
def kv_bloom_encode(spark, d):
    """R: the bytes of a stored filter."""
    words = skipping.bloom_build(log(spark, d).select("key").distinct(), BLOOM_M, BLOOM_K)
    return skipping.bloom_encoded(words, BLOOM_M, BLOOM_K).select(F.hex("filter").alias("filter"))


@query(f"SELECT {BLOOM_K} AS k, {BLOOM_M}::BIGINT AS m, i::INT AS word, ltrim(coalesce(h, '0'), '0') AS bits FROM range({-(-BLOOM_M // 64)}) t(i) LEFT JOIN w ON w.word = t.i", f"{_MUT}, {_POS}, {_WORDS}")
def kv_bloom_decode(spark, d):
    """R: parameters and words read back from a stored filter's bytes."""
    words = skipping.bloom_build(log(spark, d).select("key").distinct(), BLOOM_M, BLOOM_K)
    back = skipping.bloom_decoded(skipping.bloom_encoded(words, BLOOM_M, BLOOM_K))
    return back.select("k", "m", "word", F.ltrim(F.hex("bits"), F.lit("0")).alias("bits"))


def doc_run(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    return docs.select("source", F.col("doc_id").cast("string").cast("binary").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("val"))


_OFF = "e AS (SELECT source, CAST(doc_id AS VARCHAR) AS k, strlen(coalesce(text, '')) + strlen(CAST(doc_id AS VARCHAR)) + 7 AS n FROM documents), o AS (SELECT source, k, CAST(sum(n) OVER (PARTITION BY source ORDER BY k) - n AS BIGINT) AS off FROM e)"
_ANCHOR = "a(source, off) AS (SELECT DISTINCT source, 0::BIGINT FROM o UNION ALL SELECT * FROM (SELECT a.source, (SELECT min(off) FROM o WHERE o.source = a.source AND o.off >= a.off + 4096) AS off FROM a) WHERE off IS NOT NULL)"


@query("SELECT source, k, off AS offset FROM o", _OFF)
def kv_sparse_offsets(spark, d):
    return skipping.entry_offsets(doc_run(spark, d), ["source"]).select("source", F.col("key").cast("string").alias("k"), "offset")


@query("SELECT o.source, o.k, o.off AS offset FROM a JOIN o USING (source, off)", f"{_OFF}, {_ANCHOR}")
def kv_sparse_index(spark, d):
    e = skipping.entry_offsets(doc_run(spark, d), ["source"])
    return skipping.sparse_index(e, ["source"]).select("source", F.col("key").cast("string").alias("k"), "offset")


@query("SELECT source, k, (SELECT max(a.off) FROM a WHERE a.source = o.source AND a.off <= o.off) AS block FROM o", f"{_OFF}, {_ANCHOR}")
def kv_sparse_probe(spark, d):
    e = skipping.entry_offsets(doc_run(spark, d), ["source"])
    return skipping.sparse_probe(e, skipping.sparse_index(e, ["source"]), ["source"]).select("source", F.col("key").cast("string").alias("k"), "block")


@query("SELECT p.source, p.k, max(a.off) AS block FROM (SELECT source, k || '~' AS k FROM o UNION ALL SELECT DISTINCT source, '!' FROM o) p LEFT JOIN (SELECT o.source, o.k, o.off FROM a JOIN o USING (source, off)) a ON a.source = p.source AND a.k <= p.k GROUP BY p.source, p.k", f"{_OFF}, {_ANCHOR}")
def kv_sparse_prune(spark, d):
    """R: blocks of absent keys; none for a key below a run's first one."""
    e = skipping.entry_offsets(doc_run(spark, d), ["source"])
    absent = e.select("source", F.concat(F.col("key"), F.lit(b"~")).alias("key")).unionByName(e.select("source", F.lit(b"!").alias("key")).distinct())
    return skipping.sparse_probe(absent, skipping.sparse_index(e, ["source"]), ["source"]).select("source", F.col("key").cast("string").alias("k"), "block")


@query("SELECT source, count(*) AS entries, (SELECT count(*) FROM a WHERE a.source = o.source) AS anchors FROM o GROUP BY source", f"{_OFF}, {_ANCHOR}")
def kv_index_size(spark, d):
    """R: entries and index entries of each run."""
    e = skipping.entry_offsets(doc_run(spark, d), ["source"])
    anchors = skipping.sparse_index(e, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("anchors"))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("entries")).join(anchors, "source")


@query("SELECT k, arg_max(v, gen) AS v, max(gen) AS file_seq FROM run GROUP BY k", f"{_MUT}, {_RUN}")
def kv_compact(spark, d):
    """D: one run of the newest entries, deletes kept."""
    return shown(runs.compact(run_log(spark, d)), "file_seq")


@query("SELECT gen AS file_seq, count(*) FILTER (gen < m) AS purged FROM (SELECT gen, max(gen) OVER (PARTITION BY k) AS m FROM run) GROUP BY gen", f"{_MUT}, {_RUN}")
def kv_compact_duplicates(spark, d):
    return runs.purged(run_log(spark, d))


@query("SELECT k, arg_max(v, gen) AS v, max(gen) AS file_seq FROM run GROUP BY k HAVING arg_max(v, gen) <> ''", f"{_MUT}, {_RUN}")
def kv_full_compact_drop_tombstones(spark, d):
    """X: safe because it merges all runs."""
    return shown(runs.compact(run_log(spark, d), True), "file_seq")


@query("SELECT gen AS file_seq FROM run EXCEPT ALL (SELECT DISTINCT gen FROM run WHERE gen % 4 = 0)", f"{_MUT}, run AS (SELECT DISTINCT gen FROM mut)")
def kv_manifest_diff(spark, d):
    """D: files of the old manifest that the new one lacks."""
    old = log(spark, d).select(F.col("gen").alias("file_seq")).distinct()
    return old.exceptAll(old.filter("file_seq % 4 = 0"))


@query("SELECT k, arg_max(v, seq) AS v FROM mut WHERE seq <= (SELECT max(seq) * 9 // 10 FROM mut) GROUP BY k HAVING arg_max(v, seq) <> ''")
def kv_snapshot_at(spark, d):
    """F: as of nine tenths of the log."""
    own = log(spark, d)
    return shown(state.snapshot(own, (own.agg(F.max("seq")).first()[0] or 0) * 9 // 10))


@query("SELECT k, v FROM live WHERE k >= '1' AND k < '2'", f"{_MUT}, {_LIVE}")
def kv_scan_range(spark, d):
    """F: half-open."""
    return shown(state.scan(log(spark, d), b"1", b"2"))


@query("SELECT string_split(v, ':')[1] AS attribute, count(*) AS n_keys, min(k) AS first_key FROM live GROUP BY 1", f"{_MUT}, {_LIVE}")
def kv_secondary_index(spark, d):
    """F."""
    index = state.secondary_index(state.live(log(spark, d)), F.split(F.col("val").cast("string"), ":")[0])
    return index.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").cast("string").alias("first_key"))


@query("SELECT k, v FROM live WHERE seq + 500 > (SELECT max(seq) FROM mut)", f"{_MUT}, {_LIVE}")
def kv_ttl_expired(spark, d):
    """F: a life of 500 sequence numbers."""
    own = log(spark, d)
    now = own.agg(F.max("seq").alias("now"))
    return shown(state.live(own).join(F.broadcast(now), F.col("seq") + 500 > F.col("now")))


@query("SELECT (SELECT count(*) FROM mut) AS log_entries, (SELECT CAST(sum(12 + strlen(k) + strlen(v)) AS BIGINT) FROM mut) AS log_bytes, count(*) AS run_entries, CAST(sum(7 + strlen(k) + strlen(v)) AS BIGINT) AS run_bytes, (SELECT count(*) FROM live) AS live_entries, (SELECT CAST(sum(7 + strlen(k) + strlen(v)) AS BIGINT) FROM live) AS live_bytes FROM run", f"{_MUT}, {_LIVE}, {_RUN}")
def kv_amplification(spark, d):
    """F."""
    return runs.amplification(log(spark, d), run_log(spark, d))


@query("SELECT * EXCLUDE r FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1", "")
def kv_lineitem_upsert(spark, d):
    """R: the fold on wide rows with a composite key; the newest row by a struct, summed before the shuffle."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    newest = F.max_by(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).alias("r")
    return t.groupBy("l_orderkey", "l_linenumber").agg(newest).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND role <> 'system'", "")
def kv_conversation_state(spark, d):
    """R: last turn of each conversation; a system turn deletes."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    last = t.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text", "role"), "turn").alias("r"))
    return last.filter("r.role <> 'system'").select("conv_id", "r.turn", "r.text")


@query("SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE text <> '' AND doc_id % 7 <> 3 AND doc_id % 5 <> 1 UNION ALL SELECT doc_id, 7, md5('revised') FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 5 = 1", "")
def kv_document_state(spark, d):
    """R: the fold over wide values: every document is put, then some are put again and some deleted."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    key = F.col("id").cast("string")
    puts = mutations(docs, F.lit(1), key, F.col("text"))
    again = mutations(docs.filter("id % 5 = 1"), F.lit(2), key, F.lit("revised"))
    gone = mutations(docs.filter("id % 7 = 3"), F.lit(3), key, F.lit(""))
    live = state.live(puts.unionByName(again).unionByName(gone))
    return live.select(F.col("key").cast("string").cast("long").alias("doc_id"), F.octet_length("val").cast("long").alias("bytes"), F.md5("val").alias("digest"))


def filled(spark, d) -> KVTable:
    """A table of the event log, written in four batches, newest first, one of them twice, and merged by levels."""
    table, own = KVTable(spark, shared_path(spark, "table")), log(spark, d)
    for number, part in enumerate((3, 2, 1, 0, 0)):
        table.apply(own.filter(F.col("gen") % 4 == part).select("seq", "op", "key", "val"), min(number, 3), "events")
    table.compact_if_due(2, 1 << 40)
    return table


@query("SELECT k, v, seq FROM live", f"{_MUT}, {_LIVE}")
def kv_table_state(spark, d):
    """R: live state of a persisted table: runs written, listed by manifests, merged and read again."""
    return shown(filled(spark, d).live(), "seq")


@query("SELECT p.k, v, v IS NOT NULL AS found FROM probes p LEFT JOIN live USING (k)", f"{_MUT}, {_LIVE}, {_PROBES}")
def kv_table_get(spark, d):
    """R: lookups in a persisted table after a compaction without deletes and a vacuum."""
    table = filled(spark, d)
    table.compact(drop_deleted=True)
    table.vacuum()
    return shown(table.multi_get(probes(spark, d)), "found")


@query("SELECT 0 AS level, CAST(count(DISTINCT k) AS BIGINT) AS entries, CAST(count(DISTINCT CASE WHEN v = '' THEN k END) AS BIGINT) AS deletes, min(k) AS first_key, max(seq) AS last_seq FROM (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM mut WHERE gen % 2 = 0 GROUP BY k) UNION ALL SELECT 0, CAST(count(DISTINCT k) AS BIGINT), CAST(count(DISTINCT CASE WHEN v = '' THEN k END) AS BIGINT), min(k), max(seq) FROM (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM mut WHERE gen % 2 = 1 GROUP BY k)")
def kv_run_inspect(spark, d):
    """F: what an inspection of a table's runs tells."""
    table, own = KVTable(spark, shared_path(spark, "inspected")), log(spark, d)
    for part in (0, 1):
        table.apply(own.filter(F.col("gen") % 2 == part).select("seq", "op", "key", "val"))
    return table.inspected().select("level", "entries", "deletes", F.col("first_key").cast("string").alias("first_key"), "last_seq")


@query("SELECT k, v, seq FROM live", f"{_MUT}, {_LIVE}")
def kv_stream_state(spark, d):
    """R: live state of a table that a stream of mutation files filled, file by file, in no order of sequence numbers."""
    files = shared_path(spark, "stream-files")
    log(spark, d).select("seq", "op", "key", "val").repartition(4, "seq").write.parquet(files)
    table = KVTable(spark, shared_path(spark, "stream-table"))
    q = ingest.ingest(ingest.mutation_stream(spark, files, 1), table, shared_path(spark, "stream-checkpoint"), compact={"runs_at_0": 3})
    q.awaitTermination()
    return shown(table.live(), "seq")


@query("SELECT k, list_reduce(range(1, 8), lambda b, i: CASE WHEN md5(CAST(i AS VARCHAR) || ':' || k) > md5(CAST(b AS VARCHAR) || ':' || k) THEN i ELSE b END, 0)::INT AS shard, list_reduce(range(1, 9), lambda b, i: CASE WHEN md5(CAST(i AS VARCHAR) || ':' || k) > md5(CAST(b AS VARCHAR) || ':' || k) THEN i ELSE b END, 0)::INT AS grown FROM live", f"{_MUT}, {_LIVE}")
def kv_key_shards(spark, d):
    """F: the shard of each live key among eight and among nine."""
    keys = state.live(log(spark, d))
    return keys.select(F.col("key").cast("string").alias("k"), state.key_shard(F.col("key"), 8).alias("shard"), state.key_shard(F.col("key"), 9).alias("grown"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation WHERE n_regionkey <> 1", "")
def kv_open_log(spark, d):
    """R: a table opened over a log folder: puts in one segment, deletes in the next, and a torn tail behind them."""
    log = wal.WriteAheadLog(spark, shared_path(spark, "log")).open()
    nations = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    for r in nations:
        log.append(PUT, str(r["n_nationkey"]).encode(), r["n_name"].encode())
    log.sync()
    for r in nations:
        if r["n_regionkey"] == 1:
            log.append(DELETE, str(r["n_nationkey"]).encode())
    log.close()
    log.tear(b"\xa1torn")
    return shown(KVTable.open(spark, shared_path(spark, "opened"), log.path).live())


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, CASE WHEN r_regionkey % 2 = 0 THEN r_name || ' again' END AS v FROM region", "")
def kv_table_ops(spark, d):
    """R: single puts, overwrites, deletes and gets."""
    table = KVTable(spark, shared_path(spark, "ops"))
    regions = spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()
    names = {str(r["r_regionkey"]): r["r_name"] for r in regions}
    table.apply(spark.createDataFrame([(i, PUT, bytearray(k.encode()), bytearray(v.encode())) for i, (k, v) in enumerate(names.items())], MUTATION))
    for k, v in names.items():
        table.put(k.encode(), f"{v} again".encode()) if int(k) % 2 == 0 else table.delete(k.encode())
    got = {k: table.get(k.encode()) for k in names}
    return spark.createDataFrame([(k, v.decode() if v else None) for k, v in got.items()], "k string, v string")
