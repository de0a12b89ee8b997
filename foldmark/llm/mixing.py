"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows stand in a permuted order (that of a digest), cut into blocks by the digest's first digits. Its draws are
the first `target` words of that order, begun anew when the source is used up, so its quota is a number of blocks: all of them,
so many times, and those up to where the target ends. A tree splits the quotas of all sources among output shards: at each
node the left half of the shards draws its part of the node's blocks without replacement, which makes its numbers of blocks by
source multivariate-hypergeometric. The draws are made by a random order of all blocks, of which each node holds a stretch
and its left child the first part; so they are exact at all sizes, need no list of sources in one place, and
a block finds its leaf by a walk from the root. Shards are disjoint, and each is shuffled locally: its copies stand in the
order of a hash of their own, whatever blocks they came in, and a copy's slot is its place in that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm._shared import bare, free, measured, small, staged
from foldmark.llm.sharding import numbered

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """How many stretches of other characters than ASCII white space the text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaf(place: Column, blocks: int, shards: int) -> Column:
    """The shard of the block at a place of the random order of all blocks, by a walk down the tree.

    A node has n shards, from `shard` on, and a stretch of b blocks, from `first` on. Its left half, n // 2 shards, draws the
    first b // n * (n // 2) blocks and one more for each of the b % n shards that get one more. Leaves then hold
    blocks // shards blocks or one more.
    """
    root = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("first", 0), ("b", blocks), ("shard", 0), ("n", shards))])
    levels = F.sequence(F.lit(1), F.lit(max(1, (shards - 1).bit_length())))

    def child(node: Column, _: Column) -> Column:
        first, b, shard, n = (node[k] for k in ("first", "b", "shard", "n"))
        half = F.call_function("div", n, F.lit(2).cast("long"))
        drawn = F.call_function("div", b, n) * half + F.least(b % n, half)
        left = place < first + drawn  # a leaf's left half is empty, so it is its own right child
        parts = (first, first + drawn), (drawn, b - drawn), (shard, shard + half), (half, n - half)
        return F.struct(*[F.when(left, x).otherwise(y).alias(k) for k, (x, y) in zip(("first", "b", "shard", "n"), parts)])

    return F.aggregate(levels, root, child)["shard"].cast("int")


def split_quotas(blocks: DataFrame, shards: int, seed: int, ties: list[str]) -> DataFrame:
    """blocks (a row for each block of each source's quota, told apart by the columns ties) with the shard that draws it."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ties]).cast("binary"))
    rows, n = numbered(blocks, key, [F.col(c) for c in ties], "__place")
    return rows.withColumn("shard", leaf(F.col("__place"), n, shards)).drop("__place")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size), a row for each source, with rank, weight and target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; no target is over `most`
    times its source's size, and what is cut off goes to the others by weight. That is one level for all: target =
    least(most * size, level * weight). Window functions over one row for each source find the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    s = s.withColumn("common", F.max(fits).over(every))
    return s.select("source", "source_size", "rank", "weight", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight"))).alias("target"))


#: Digits of the digest by which a source is cut into blocks, and rows up to which one task orders the block where a target ends.
DIGITS, MOST_ROWS = 3, 1 << 20


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _ends(rows: DataFrame, blocks: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """(source, cut, spare, equal): the digest at which each source's last, partial round ends, how many of the rows with just
    that digest belong to it, and how many there are. rows: (source, size, digest); blocks: (source, block, words, n, begin); size: plan's bytes.

    The block that holds the end is cut finer until it has few rows; only those are put in order by one task.
    """
    digits = DIGITS
    at = blocks.join(small(plan, size=size), _same(blocks["source"], plan["name"])).filter((F.col("rest") > 0) & (F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("begin") + F.col("words")))
    at, has = measured(at.select("name", F.col("block").alias("prefix"), F.col("begin").alias("from"), "rest", "n"), "ends", most=F.max("n"))
    while digits < 30 and (has["most"] or 0) > MOST_ROWS:
        finer = _within(rows, at, has["bytes"]).groupBy("name", "rest", "from", F.substring("digest", 1, digits + 3).alias("prefix")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("words").over(Window.partitionBy("name").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        finer = finer.withColumn("from", F.col("from") + upto).filter((F.col("from") <= F.col("rest")) & (F.col("rest") < F.col("from") + F.col("words")))
        at, has = measured(finer.select("name", "prefix", "from", "rest", "n"), "ends", most=F.max("n"))
        digits += 3
    each = _within(rows, at, has["bytes"]).groupBy("name", "rest", "from", "prefix", "digest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    begin = F.col("from") + F.sum("words").over(Window.partitionBy("name").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    size = F.col("words") / F.col("n")
    # a row belongs to the round if half of it lies before the end
    fit = F.when(size > 0, F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("begin")) / size + 0.5)))).otherwise(F.when(F.col("begin") <= F.col("rest"), F.col("n")).otherwise(0))
    last = each.withColumn("begin", begin).withColumn("spare", fit.cast("long")).groupBy("name", "prefix").agg(F.max(F.when(F.col("spare") > 0, F.struct("digest", "spare", "n"))).alias("m"))
    return last.select("name", F.coalesce("m.digest", "prefix").alias("cut"), F.coalesce("m.spare", F.lit(0)).cast("long").alias("spare"), F.coalesce("m.n", F.lit(0)).alias("equal"))


def _within(rows: DataFrame, at: DataFrame, size: int) -> DataFrame:
    return rows.join(small(at, size=size), _same(rows["source"], F.col("name")) & F.col("digest").startswith(F.col("prefix")))


def mix(df: DataFrame, source: Column, size: Column, digest: Column, *, light: DataFrame | None = None, shards: int = 8, seed: int = 9, names: tuple[str, ...] = ("size", "source_size", "target", "taken", "shards"), slots: str | None = None, local_seed: int = 1) -> DataFrame:
    """df with five more columns: size, source_size, target, taken (words) and shards (array<int>: of each copy taken, where it
    goes). With `slots`, each shard is shuffled locally, too, and a sixth column of that name (array<long>) says at which place
    of its shard's order each copy stands, gapless from 0 in each shard.

    taken is 0, 1 or 2 times the row's size (more only if targets are set higher). Null sources are a source of their own.
    Rows of size 0 count as any. The same rows in any order or partitioning get the same draws, up to rows equal in digest,
    which should differ with the text. An empty table gives an empty one. All columns pass through; a new one whose name is
    taken gets underscores after it. df is read several times, but only the columns that the three expressions need; where these are
    costly, hand in the staged table `light` of their values (source, size, digest), a row for each of df.

    Rows themselves are not moved: sums of blocks and, of the one block of each source in which its target ends, the order
    of digests say of any row by itself whether and where it goes. These tables have a row for each block, 4,096
    at most for each source; they are broadcast only if their measured size allows. The local shuffle does move and write the rows: for
    wide ones mix a light table with slots, or take what mixed_documents() does.
    """
    if slots is not None:
        key = bare(df, {*names, slots}, "__order")
        rows = mix(df.withColumn(key, digest), source, size, digest, light=light, shards=shards, seed=seed, names=names)
        return shuffled(rows, rows.columns[-1], key, seed=local_seed, name=slots).drop(key)
    names = free(df, names)
    src, n, key, block, times = (bare(df, set(names), p) for p in ("__source", "__size", "__digest", "__block", "__times"))
    rows = df.withColumn(src, source).withColumn(n, size).withColumn(key, digest).withColumn(block, F.substring(key, 1, DIGITS))
    if light is None:
        light = rows.select(F.col(src).alias("source"), F.col(n).alias("size"), F.col(key).alias("digest"))
    light = light.withColumn("block", F.substring("digest", 1, DIGITS))
    sums = light.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    begin = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    blocks = staged(sums.withColumn("begin", begin), "blocks")
    plan = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan, has = measured(plan.select(F.col("source").alias("name"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")), "source-plan")
    ends, at_ends = measured(_ends(light, blocks, plan, has["bytes"]).withColumnRenamed("name", "ended"), "source-ends", parted=F.count_if(F.col("equal") > F.col("spare")))
    plan = plan.join(ends, _same(F.col("name"), F.col("ended")), "left").select("name", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("spare", F.lit(0)).alias("spare"))
    # the quota: each block as often as the source is drawn whole, and once more up to where its target ends
    rounds = F.col("whole") + F.when(F.col("block") <= F.col("cut"), 1).otherwise(0)
    known = blocks.select("source", "block").join(plan, _same(F.col("source"), F.col("name"))).drop("name")
    known = staged(known.withColumn("rounds", rounds), "quotas")
    units = known.filter("rounds > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("copy"))
    drawn = split_quotas(units, shards, seed, ["source", "block", "copy"])
    drawn = drawn.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("where"))
    known = known.join(drawn, _same(F.col("source"), F.col("s")) & (F.col("block") == F.col("b")), "left")
    params, has = measured(known.select(F.struct("source", "block", "source_size", "target", "whole", "cut", "spare", F.coalesce("where", F.array().cast("array<int>")).alias("where")).alias("p")).select("p.*"), "block-plans")
    params = params.select(F.struct(*params.columns).alias(times), F.col("source").alias(src + "p"), F.col("block").alias(block + "p"))
    rows = rows.join(small(params, size=has["bytes"]), _same(F.col(src), F.col(src + "p")) & (F.col(block) == F.col(block + "p")))
    p = F.col(times)
    done = lambda rows, extra: _drawn(rows, df.columns, n, p, p["whole"] + extra, names)
    if not at_ends["parted"]:
        return done(rows, F.when((F.col(key) < p["cut"]) | ((F.col(key) == p["cut"]) & (p["spare"] > 0)), 1).otherwise(0))
    # of the equal rows in which a target ends only some belong: these few digests' rows are counted off
    others = done(rows.filter(F.col(key) != p["cut"]), F.when(F.col(key) < p["cut"], 1).otherwise(0))
    nth = bare(df, {*names, src, n, key, block, times}, "__nth")
    counted = rows.filter(F.col(key) == p["cut"]).withColumn(nth, F.row_number().over(Window.partitionBy(src, key).orderBy(F.lit(0))))
    return others.unionByName(done(counted, F.when(F.col(nth) <= p["spare"], 1).otherwise(0)))


def _drawn(rows: DataFrame, columns: list[str], n: str, p: Column, times: Column, names: tuple[str, ...]) -> DataFrame:
    out = (F.col(n), p["source_size"], p["target"], times * F.col(n), F.slice(p["where"], F.lit(1), times.cast("int")))
    return rows.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(name) for c, name in zip(out, names)])


#: Bits of a copy's order by which a shard is cut into buckets, at first and at most.
ORDER_BITS, MOST_BITS = 10, 40


def local_order(digest: Column, copy: Column, seed: int) -> Column:
    """What the copies of a shard are sorted by, 62 bits, copies of one row each for themselves."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), digest, copy.cast("int")), 2)


def shuffled(rows: DataFrame, shards: str, digest: str, *, seed: int = 1, name: str = "slots") -> DataFrame:
    """rows with one more column (array<long>): of each entry of the column `shards`, a copy, the place in its shard's shuffled
    order, which the column `digest` and the copy's number decide. Places are gapless from 0 in each shard; a row without copies has an empty array.

    A shard's copies are brought together in buckets of their order, whose number grows with the rows; the counts of the
    buckets give each one's first place, so no task orders more than one bucket. Copies equal in digest and number are
    interchangeable and lie in one bucket, side by side.
    """
    (name,) = free(rows, (name,))
    row, nth, out, order, bucket, begin = (bare(rows, {name}, p) for p in ("__row", "__nth", "__out", "__at", "__bucket", "__begin"))
    key, each = F.col(f"`{digest}`"), F.col(f"`{shards}`")
    copies = rows.withColumn(row, F.monotonically_increasing_id()).select("*", F.posexplode_outer(each).alias(nth, out)).drop(shards)
    copies, bits = staged(copies.withColumn(order, local_order(key, F.col(nth), seed)), "copies"), ORDER_BITS
    while True:
        cut = copies.withColumn(bucket, F.shiftrightunsigned(order, 62 - bits))
        counts, has = measured(cut.filter(F.col(out).isNotNull()).groupBy(out, bucket).agg(F.count(F.lit(1)).alias("n")), "copy-buckets", most=F.avg("n"))
        most = has["most"] or 0
        if most <= MOST_ROWS or bits >= MOST_BITS:
            break
        bits = min(MOST_BITS, bits + math.ceil(math.log2(most / MOST_ROWS)))
    upto = F.sum("n").over(Window.partitionBy(out).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first, has = measured(counts.select(F.col(out).alias(out + "p"), F.col(bucket).alias(bucket + "p"), upto.alias(begin)), "copy-starts")
    own = Window.partitionBy(out, bucket).orderBy(order, key, nth)
    at = cut.withColumn(order, F.row_number().over(own) - 1)
    at = at.join(small(first, size=has["bytes"]), (F.col(out) == F.col(out + "p")) & (F.col(bucket) == F.col(bucket + "p")), "left")
    copy = F.when(F.col(out).isNotNull(), F.struct(F.col(nth).alias("nth"), F.col(out).alias("shard"), (F.col(begin) + F.col(order)).alias("slot")))
    by_row = at.groupBy(row).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in copies.columns if c in rows.columns], F.array_sort(F.collect_list(copy)).alias(nth))
    where = F.transform(nth, lambda x: x["shard"])
    return by_row.select(*[where.alias(c) if c == shards else F.col(f"`{c}`") for c in rows.columns], F.transform(nth, lambda x: x["slot"]).alias(name))


def _digest() -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))).cast("binary"))


def _sizes(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), _digest().alias("digest")), "mix-sizes")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards and slots of each document."""
    mixed = mix(_sizes(docs), F.col("source"), F.col("words"), F.col("digest"), slots="slots")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards", "slots")


def mixed_documents(docs: DataFrame, *, shards: int = 8, local_seed: int = 1, slice_words: int = 4_000_000) -> DataFrame:
    """The documents that the mix takes, repeats included, with the columns of docs alone. The rows of a shard are brought
    together in its shuffled order, that of the slots: by slices of it, of about slice_words words, and sorted within a slice.
    Each slice is a partition of its own, so no task holds more than one."""
    sizes = _sizes(docs)
    words = sizes.agg(F.sum("words")).first()[0] or 0
    slices = max(1, -(-3 * words // 2 // (shards * slice_words)))
    names = free(docs, ("__size", "__source_size", "__target", "__taken", "__shards"))
    light = sizes.select("source", F.col("words").alias("size"), "digest")
    rows = mix(docs, F.col("source"), word_count(F.col("text")), _digest(), light=light, shards=shards, names=names)
    nth, out, order, part, key = (bare(rows, set(), p) for p in ("__nth", "__out", "__order", "__part", "__key"))
    rows = rows.withColumn(key, _digest()).select(*[F.col(f"`{c}`") for c in docs.columns], key, F.posexplode(names[4]).alias(nth, out))
    rows = rows.withColumn(order, local_order(F.col(key), F.col(nth), local_seed))
    at = F.call_function("div", F.col(order), F.lit(-(-(1 << 62) // slices)).cast("long"))
    rows = rows.withColumn(part, (F.col(out) * slices + at).cast("int"))
    return rows.repartitionById(shards * slices, F.col(part)).sortWithinPartitions(order, key, nth).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS digest FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(r % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS common FROM l),
g AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM g),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
o AS (SELECT d.doc_id, d.source, d.size, d.digest, substr(d.digest, 1, 3) AS block, q.source_size, q.target, q.whole, q.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS pos FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, whole + CASE WHEN rest > 0 AND pos + size / 2.0 <= rest THEN 1 ELSE 0 END AS times FROM o),
b AS (SELECT source, block, min(whole) AS whole, min(rest) AS rest, min(pos) AS start FROM x GROUP BY source, block),
u AS (SELECT source, block, unnest(range(1, (whole + CASE WHEN rest > 0 AND start <= rest THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM b),
n AS (SELECT *, row_number() OVER (ORDER BY md5('9:' || coalesce('=' || source, '-') || ':=' || block || ':=' || CAST(copy AS VARCHAR))) - 1 AS place, count(*) OVER () AS blocks FROM u),
s AS (SELECT source, block, copy, CASE WHEN place < (blocks % 8) * (blocks // 8 + 1) THEN place // (blocks // 8 + 1) ELSE (place - (blocks % 8) * (blocks // 8 + 1)) // greatest(1, blocks // 8) + blocks % 8 END AS shard FROM n),
m AS (SELECT source, block, string_agg(CAST(shard AS VARCHAR), ',' ORDER BY copy) AS shards FROM s GROUP BY source, block)
SELECT x.doc_id, x.size, x.source_size, x.target, (x.times * x.size)::BIGINT AS taken, CASE WHEN x.times = 0 THEN '' ELSE array_to_string(string_split(m.shards, ',')[1:x.times], ',') END AS shards
FROM x LEFT JOIN m ON m.source IS NOT DISTINCT FROM x.source AND m.block = x.block
"""
