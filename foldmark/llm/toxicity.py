"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are whether a text holds a word, a pair of neighbouring words, a triple, or a pair with one word between,
each hashed into 2**BITS places. Words alone count 1, the others GRAM: a single word needs less evidence to get a weight
past the L1 term than one of the many pairs and triples that hold it. Each coordinate has its own rate, and the L1 term leaves most at zero: the
weights that remain are a short list, small enough to go along with every task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import bare, lean, staged
from foldmark.llm._words import mixed, word_hashes

BITS = 22
#: Labelled rows of either kind from which the model learns at most.
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 6000
THRESHOLD = 0.3
#: A feature that fewer rows of the sample hold is not learnt.
MIN_ROWS = 4
#: The value of a feature of several words.
GRAM = 0.5


def places(h: np.ndarray) -> np.ndarray:
    """The places of all features of a text from its words' hashes: the words' first, then those of several words. Repeats are
    included. The lowest bit of a place says which it is (1: a word), so a place alone tells its value."""
    m = np.uint64(0x9E3779B97F4A7C15)
    parts = [h]
    if len(h) > 1:
        parts.append(h[:-1] * m + h[1:] + np.uint64(1))
    if len(h) > 2:
        parts.append((h[:-2] * m + h[1:-1]) * m + h[2:] + np.uint64(2))
        parts.append(h[:-2] * m + h[2:] + np.uint64(3))
    at = (mixed(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.uint32)
    at[: len(h)] |= np.uint32(1)
    at[len(h) :] &= ~np.uint32(1)
    return at


def values(at: np.ndarray) -> np.ndarray:
    """What the features at these places count."""
    return np.where(at & 1, 1.0, GRAM)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0, epochs: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias. rows: the distinct places of each example. A weight is already times its feature's value."""
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0), 0.0
    count = np.zeros(1 << BITS, np.int32)
    for r in rows:
        count[r] += 1
    seen = np.flatnonzero(count >= min(MIN_ROWS, max(1, len(rows) // 4)))
    number = np.full(1 << BITS, -1, np.int32)
    number[seen] = np.arange(len(seen))
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    local = [np.append(at[at >= 0], len(seen)).astype(np.int32) for at in (number[r] for r in rows)]
    value = np.append(values(seen), 1.0)

    def weight(i: np.ndarray) -> np.ndarray:
        one = np.where(i == len(seen), 0.0, l1)  # the bias has no penalty
        return np.where(np.abs(z[i]) <= one, 0.0, -(z[i] - np.sign(z[i]) * one) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y in zip(local, labels):
            w, x = weight(i), value[i]
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(len(seen) + 1)) * value
    kept = np.flatnonzero(w[:-1])
    return seen[kept], w[kept], float(w[-1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from labelled documents that are not held out: at most toxic_rows and clean_rows of either kind, those
    whose ids have the least hashes. One task of an executor learns from their staged features; only the weights reach
    the driver. The bias is set back to the share of toxic rows among all labelled ones. Null ids, labels and texts
    teach nothing."""
    import pyarrow as pa

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = staged(known, "labelled")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: toxic_rows, 0: clean_rows}
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (1, 0)]
    picked = F.broadcast(staged(picked[0].union(picked[1]), "training-ids"))

    def features(batches):
        for b in batches:
            out = [np.unique(places(h)).astype("<u4").tobytes() for h in word_hashes(b["text"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "y": b["y"], "f": pa.array(out, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(picked, "doc_id").mapInArrow(lean(features), "doc_id long, y int, f binary")

    def learn(batches):
        y, ids, data = [], [], []
        for b in batches:
            y += b["y"].to_pylist()
            ids += b["doc_id"].to_pylist()
            data += [np.frombuffer(x.as_buffer(), "<u4") for x in b["f"]]
        if len(set(y)) < 2:
            share = sum(y) / len(y) if y else 0.0
            place, weight, bias = np.zeros(0, np.uint32), np.zeros(0), math.log(max(share, 1e-3) / max(1 - share, 1e-3))
        else:
            key = np.array(ids, np.int64).astype(np.uint64)
            order = np.lexsort((key, mixed(key))).tolist()
            place, weight, bias = fit_ftrl([data[i] for i in order], np.array(y)[order])
        yield pa.RecordBatch.from_pydict({"place": pa.array([place.tolist()], pa.list_(pa.int32())), "weight": pa.array([weight.tolist()], pa.list_(pa.float64())), "bias": pa.array([bias], pa.float64()), "classes": pa.array([len(set(y))], pa.int32())})

    got = staged(rows, "features").coalesce(1).mapInArrow(lean(learn), "place array<int>, weight array<double>, bias double, classes int").first()
    if got is None:
        return np.zeros(0, np.uint32), np.zeros(0), math.log(1e-3)
    place, weight, bias = np.array(got["place"], np.uint32), np.array(got["weight"], float), got["bias"]
    if got["classes"] < 2:
        return place, weight, bias
    rate = {c: min(1.0, most[c] / total[c]) for c in (0, 1)}
    return place, weight, bias + math.log(rate[0] / rate[1])


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str = "score", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep (all, if None) of docs and the score, from the whole text alone. Null and empty texts score by the bias."""
    import pyarrow as pa

    place, weight, bias = model
    order = np.argsort(place)
    place, weight = place[order].astype(np.uint32), weight[order]
    names = docs.columns if keep is None else keep
    given = docs.select(*[F.col(f"`{c}`") for c in names], *([] if text_col in names else [text_col]))
    fields = [f for f in given.schema.fields if f.name in names]

    def score(batches):
        held = np.zeros(1 << BITS, bool)
        held[place] = True
        for b in batches:
            scores = []
            for h in word_hashes(b[text_col].to_pylist()):
                p = places(h)
                p = np.unique(p[held[p]])
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, bias + float(weight[np.searchsorted(place, p)].sum()))))))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(scores, pa.float64())], [*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return given.mapInArrow(lean(score), StructType([*fields, StructField(out, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, repeated rows each for themselves."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under threshold, with the columns of docs."""
    out = bare(docs, set(), "__score")
    return scored(docs, fit(docs, labels), out).filter(F.col(out) < threshold).drop(out)
