"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 by a digest of their id. A permutation of those numbers then says where a row goes:
its place p is slot p div k of shard p mod k, so shard sizes differ by one row at most, and both directions can be
computed from the number alone, without a sort of the whole table.

The permutation is an alternating Feistel network on pairs (number div b, number mod b) with a * b barely over n;
a result outside 0 to n - 1 is permuted again until it is inside (cycle walking), which keeps it a bijection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm._shared import bare, free, measured, small, staged

PRIME = (1 << 31) - 1
ROUNDS = 4
#: Times that a place is permuted again at most. The chance that a row needs more is under (1/sqrt n)**40.
WALK = 40


def _constants(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend under PRIME for each round, from a linear congruential sequence."""
    x, out = seed % PRIME, []
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) % PRIME
        y = (x * 1103515245 + 12345) % PRIME
        out.append((x | 1, y))
        x = y
    return out


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, both near its square root."""
    b = max(1, math.isqrt(max(n, 1)))
    return -(-max(n, 1) // b), b


def permuted_number(x: int, n: int, seed: int) -> int:
    """Where the permutation of 0 to n - 1 puts x: the plain definition, for readers of shards and for tests."""
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for r, (mul, add) in enumerate(_constants(seed)):
            side = right if r % 2 == 0 else left
            t = (side % PRIME * mul + add) % PRIME
            t = t * t % PRIME
            t = t // 7
            if r % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        x = left * b + right
        if x < n:
            return x


def _network(x: Column, n: int, seed: int) -> Column:
    a, b = (F.lit(v).cast("long") for v in sides(n))
    rounds = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"), F.lit(i % 2 == 0).alias("even")) for i, (m, k) in enumerate(_constants(seed))])

    def step(s: Column, c: Column) -> Column:
        side = F.when(c["even"], s["r"]).otherwise(s["l"])
        t = (side % PRIME * c["m"] + c["k"]) % PRIME
        t = _div(t * t % PRIME, 7)
        return F.struct(F.when(c["even"], (s["l"] + t) % a).otherwise(s["l"]).alias("l"), F.when(c["even"], s["r"]).otherwise((s["r"] + t) % b).alias("r"))

    return F.aggregate(rounds, F.struct(_div(x, sides(n)[1]).alias("l"), (x % b).alias("r")), step, lambda s: s["l"] * b + s["r"])


def _div(x: Column, b: int) -> Column:
    return F.call_function("div", x, F.lit(b).cast("long"))


def permutation(x: Column, n: int, seed: int) -> Column:
    """permuted_number() as a column. A row that is outside still after WALK further passes fails the query."""
    place = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _network(x, n, seed), lambda v, _: F.when(v < n, v).otherwise(_network(v, n, seed)))
    return F.transform(F.array(place), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("the walk is too long; take another seed")).cast("long")))[0]


#: Rows of a bucket at about which buckets are made finer.
BUCKET_ROWS = 1 << 20


def numbered(df: DataFrame, digest: Column, ties: list[Column], name: str = "row_number", times: str | None = None) -> tuple[DataFrame, int]:
    """df with global row numbers from 0, in order of digest (a hexadecimal string) and ties, and the number of rows.

    The first digits of the digest deal rows into buckets, at least 4,096 and so many that one holds about BUCKET_ROWS rows;
    the counts of the buckets give each bucket's first number. So no task sees more than one bucket's rows. Rows that are
    equal in digest and ties are interchangeable and lie in one bucket: where there may be many, hand in one row for
    all of them and the column `times` with how many there are, whose numbers then follow that of the row. df is read twice;
    hand in a staged table if it's costly.
    """
    key, bucket, at = (bare(df, {name}, p) for p in ("__digest", "__bucket", "__at"))
    weight = F.lit(1).cast("long") if times is None else F.col(times)
    digits = 3
    while True:
        rows = df.withColumn(key, digest).withColumn(bucket, F.substring(key, 1, digits))
        counts, has = measured(rows.groupBy(bucket).agg(F.sum(weight).alias("count"), F.count(F.lit(1)).alias("rows")), "buckets", n=F.sum("count"), most=F.avg("rows"))
        n, most = has["n"] or 0, has["most"] or 0
        if most <= BUCKET_ROWS:
            break
        digits += max(1, math.ceil(math.log(most / BUCKET_ROWS, 16)))
    first = counts.select(bucket, (F.sum("count").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias(at))
    first = F.broadcast(first) if digits <= 4 else small(staged(first, "bucket-starts"))  # a row for each bucket
    own = Window.partitionBy(bucket).orderBy(key, *ties)
    rows = rows.withColumn(name, F.row_number().over(own).cast("long") if times is None else F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) - weight + 1)
    return rows.join(first, bucket).withColumn(name, F.col(name) - 1 + F.col(at)).drop(key, bucket, at), n


def assign_shards(df: DataFrame, shards: int, digest: Column, ties: list[Column], seed: int = 20, times: str | None = None, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """df with two more columns, shard int and slot long, gapless from 0 in each shard.

    Every row counts, repeated rows each for themselves; an empty table gives an empty one. The same rows in any order or
    partitioning get the same places, up to rows equal in digest and ties. With `times`, a row comes out as often as that
    column says, each time with a place of its own. All columns pass through; a new one whose name is taken gets underscores after
    it.
    """
    names = free(df, names)
    number = bare(df, set(names), "__number")
    rows, n = numbered(df, digest, ties, number, times)
    if times is not None:
        rows = rows.filter(F.col(times) > 0).withColumn(number, F.explode(F.sequence(F.col(number), F.col(number) + F.col(times) - 1)))
    place = bare(rows, set(names), "__place")
    rows = rows.withColumn(place, permutation(F.col(number), max(n, 1), seed))
    return rows.withColumn(names[0], (F.col(place) % shards).cast("int")).withColumn(names[1], _div(F.col(place), shards)).drop(number, place)


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """Shards of documents by the law `rows`: doc_id, size (UTF-8 bytes of the text, null having none, plus 1),
    text_crc32, law, shard, slot, grown_shard (null). Nulls may stand in any column; other columns are not read. Rows equal
    in the first three are counted before anything is dealt out, so a document that repeats often makes no hot bucket."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    light = staged(light.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times")), "sizes")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string")).cast("binary"))
    placed = assign_shards(light, shards, digest, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], seed, "times")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write the rows of assign_shards() as one folder for each shard, in order of slot within its files."""
    df.repartition("shard", F.call_function("div", F.col("slot"), F.lit(1 << 20).cast("long"))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _sql_network(left: str, right: str) -> str:
    """The network's rounds as SELECTs, one inside the other."""
    at = f"SELECT *, {left} AS l, {right} AS r FROM walk WHERE v >= n OR step = 0"
    for i, (mul, add) in enumerate(_constants(20)):
        side = "r" if i % 2 == 0 else "l"
        t = f"((({side} % {PRIME} * {mul} + {add}) % {PRIME}) * (({side} % {PRIME} * {mul} + {add}) % {PRIME}) % {PRIME}) // 7"
        at = f"SELECT * REPLACE ({f'(l + {t}) % a AS l' if i % 2 == 0 else f'(r + {t}) % b AS r'}) FROM ({at})"
    return at


#: The CRC32 table and sum are written out by list functions; crc32 is unknown there.
SQL = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, strlen(x) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda s, b: xor(s // 256, t[(xor(s, b) % 256) + 1]))) AS crc FROM d, tab),
k AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CAST(crc AS VARCHAR)), doc_id NULLS FIRST, crc, size) - 1 AS i, count(*) OVER () AS n, greatest(1, floor(sqrt(count(*) OVER ()))::BIGINT) AS b FROM c),
walk AS (SELECT i, i AS v, n, b, (n + b - 1) // b AS a, 0 AS step FROM k UNION ALL SELECT i, l * b + r AS v, n, b, a, step + 1 AS step FROM ({_sql_network("v // b", "v % b")})),
place AS (SELECT i, v FROM walk WHERE v < n AND step > 0)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (v % 8)::INT AS shard, v // 8 AS slot, NULL::INT AS grown_shard FROM k JOIN place USING (i)
"""
