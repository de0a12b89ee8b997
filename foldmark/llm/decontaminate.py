"""Benchmark decontamination: short test items are found inside long documents by containment.

Items are partitioned by size, their number n of distinct five-word shingles, into classes of n within a factor of two. An
item's sketch is its k least shingle hashes (bottom-k MinHash), with k = floor((1 - t) * u) + 1 for the class's largest
size u: a document that holds a share t or more of the item's shingles misses at most (1 - t) * n < k of them and so
holds one of the sketch. Looking up every document shingle among the sketches therefore finds all pairs that
reach t, whatever the document's length; candidates are then verified by exact shingle containment. An item of fewer words
than a shingle is one shingle, all of its words, and is held against the documents' runs of as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm._shared import bare, small, staged

SHINGLE = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(rows: DataFrame, words: str, at: str, k: int) -> DataFrame:
    """A row for each run of k words of each row, with its first word's index. The words stay in place: nothing is copied."""
    n = F.size(words)
    return rows.withColumn(at, F.explode(F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))))


def _hash(words: str, at: str, k: int) -> Column:
    return F.xxhash64(*[F.col(words)[F.col(at) + i] for i in range(k)])


def _key(*columns: Column) -> Column:
    """128 bits that tell rows apart, nulls from values too: no two of 1e12 rows share them."""
    given = [x for c in columns for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*given).alias("a"), F.xxhash64(F.lit(1), *reversed(given)).alias("b"))


def _runs(rows: DataFrame, k: int, sizes: list[int], *more: str) -> DataFrame:
    """(more, h, shingle, w, i) of all runs of k words of rows (more, w), and of those of each of sizes, which are under k."""
    out = None
    for size in [k, *sizes]:
        one = _shingles(rows, "w", "i", size)
        one = one.select(*more, _hash("w", "i", size).alias("h"), F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("shingle"))
        out = one if out is None else out.unionByName(one)
    return out


def item_shingles(benchmark: DataFrame, k: int = SHINGLE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item key, item_id, h, shingle, n, size) of each distinct shingle of each distinct item; size is its number of words, k or,
    for items of fewer words, all of them. Rows equal in id and text are one item; items without a word have no shingle."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), _key(F.col(item_col), F.col(text_col)).alias("item"), words_of(F.col(text_col)).alias("w"))
    long = _shingles(rows, "w", "i", k).select("item", "item_id", _hash("w", "i", k).alias("h"), F.array_join(F.slice("w", F.col("i") + 1, k), " ").alias("shingle"), F.lit(k).alias("size"))
    short = rows.filter(F.size("w").between(1, k - 1)).select("item", "item_id", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(k)]).alias("h"), F.array_join("w", " ").alias("shingle"), F.size("w").alias("size"))
    return long.unionByName(short).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item")))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, h) of each item's bottom-k sketch, k by its size class."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    k = F.floor((1 - threshold) * upper + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("item").orderBy("h", "shingle"))
    return items.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "h")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, doc_id, item_id, shared, item_shingles, containment) of each pair with containment >= threshold.

    Rows of docs equal in id and text are one document. Null and empty texts match nothing; an empty table on either
    side gives no pairs. Items and candidates are broadcast only if their measured size allows, else they are
    joined by a shuffle on hashes or row keys. Of the benchmark only the sizes of items under k words reach the driver,
    k - 1 numbers at most; each costs another pass over the documents' words.
    """
    items = staged(item_shingles(benchmark, k), "items")
    sizes = [r["size"] for r in items.filter(F.col("size") < k).select("size").distinct().collect()]
    sketch = staged(sketches(items, threshold).groupBy("h").agg(F.collect_set("item").alias("items")), "sketches")
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("t")).withColumn("row", _key(F.col("doc_id"), F.col("t")))
    found = _runs(rows.select("row", words_of(F.col("t")).alias("w")), k, sizes, "row").select("row", "h")
    found = found.join(small(sketch), "h").select("row", F.explode("items").alias("item")).distinct()
    found = staged(found, "candidates")
    which = staged(found.select("row").distinct(), "candidate-rows")
    held = rows.join(small(which), "row", "left_semi").select("row", "doc_id", words_of(F.col("t")).alias("w"))
    held = _runs(held, k, sizes, "row", "doc_id")
    pairs = held.join(small(items), ["h", "shingle"]).groupBy("row", "doc_id", "item", "item_id", "n").agg(F.size(F.collect_set("shingle")).cast("long").alias("shared"))
    pairs = pairs.filter(F.col("shared") >= threshold * F.col("n")).join(small(found), ["row", "item"], "left_semi")
    return pairs.select("row", "doc_id", "item_id", "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a benchmark item. All columns pass through."""
    key = bare(docs, set(), "__row")
    bad = staged(contaminated(docs, benchmark, threshold).select(F.col("row").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, _key(F.col("doc_id"), F.col("text"))).join(small(bad), key, "left_anti").drop(key)


SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, text, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS i FROM b WHERE len(w) >= 5)
  UNION SELECT item_id, text, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY ALL),
z AS (SELECT 5 AS z UNION SELECT len(w) FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, text AS doc_text, array_to_string(w[i + 1:i + z], ' ') AS s FROM (SELECT *, unnest(range(len(w) - z + 1)) AS i FROM d, z WHERE len(w) >= z)),
m AS (SELECT doc_id, doc_text, bs.item_id, bs.text, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, m.item_id, shared, n AS item_shingles, shared / n AS containment
FROM m JOIN n ON m.item_id = n.item_id AND m.text = n.text WHERE shared >= 0.8 * n
"""
