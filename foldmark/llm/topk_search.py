"""Exact top-k search by inner product with pivot-table elimination.

Vectors get one more component, so that all candidates have one length; the inner product then falls exactly as the
distance grows. Distances to the pivots are computed once for each vector and written beside it: the pivot table. For a query q
and a candidate x no pivot p lets d(q, x) be under |d(q, p) - d(x, p)|, so the largest of these bounds the score from above.

Candidates are clustered by their nearest pivot, and for each cluster and pivot the least and greatest distance are kept.
That bounds a whole cluster at once. A query first searches the clusters with the best bounds, as many as hold enough
candidates; its k-th best score so far then goes along to all others, and only clusters whose bound reaches it are sent the query.
Within them candidates are evaluated in the order of their own bounds, and the search stops where these fall under
the k-th best score. The result is exact; pivots change only the cost. Where a first look at the bounds of a block of queries
shows that most candidates are left, as with vectors spread evenly in many dimensions, they are evaluated by one
matrix product, which costs less than to bound them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm._shared import small, staged

#: Pivots at most; there is one for about CLUSTER_ROWS vectors, and LEAST_PIVOTS at least.
PIVOTS, LEAST_PIVOTS, CLUSTER_ROWS = 256, 16, 128
#: Vectors among which the pivots are chosen, farthest first; fixed, since pivots only change the cost.
PIVOT_SAMPLE = 4096
QUERY_BLOCK, SLICE = 4096, 4096
#: The floor of a query that has none.
LOWEST = -(1 << 63)
#: Share of candidates that a block's bounds must leave out for single candidates to be bounded at all.
WORTH = 0.5


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of sample, each the one farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray, lift: float) -> np.ndarray:
    """float32 distances of v to the pivots. Pivots have the added component that brings them to the squared length lift; v has
    it as candidates have (lift: theirs) or not, as queries (0)."""
    n = (v * v).sum(1)
    extra = np.sqrt(np.maximum(lift - n, 0))
    d = n[:, None] + extra[:, None] ** 2 + (pivots * pivots).sum(1)[None] - 2 * (v @ pivots[:, :-1].T) - 2 * extra[:, None] * pivots[:, -1][None]
    return np.sqrt(np.maximum(d, 0)).astype(np.float32)


def lifted(pivots: np.ndarray, lift: float) -> np.ndarray:
    return np.concatenate([pivots, np.sqrt(np.maximum(lift - (pivots * pivots).sum(1, keepdims=True), 0))], axis=1)


def upper(bound: np.ndarray, q_n: np.ndarray, lift: float) -> np.ndarray:
    """The greatest score at a distance of `bound` or more. float32 distances are off by under 2e-6 of the largest length; that
    and what float64 rounds is given away."""
    slack = 4e-6 * (np.sqrt(q_n) + np.sqrt(lift) + 1.0)
    return (q_n + lift - np.square(np.maximum(bound - slack, 0))) / 2 + 1e-6 * (q_n + lift)


def cluster_bounds(q_d: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(queries, clusters): under what distance no candidate of a cluster lies. least, most: (clusters, pivots)."""
    out = np.empty((len(q_d), len(least)))
    for i in range(len(q_d)):
        out[i] = np.maximum(least - q_d[i], q_d[i] - most).max(axis=1, initial=0)
    return np.maximum(out, 0)


def search_slice(q: dict[str, np.ndarray], x: dict[str, np.ndarray], k: int, lift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best candidates of a slice: query positions, ids, scores; and of each query how many candidates
    were evaluated.

    q: id, v, d (to the pivots), floor (a score that k candidates are known to reach, or the least number) and clusters (a
    boolean for each cluster: whether to search it). x: id, v, d and cluster. v hold whole numbers; where float64 can't hold all sums
    exactly, int64 is used.
    """
    order = np.argsort(x["id"], kind="stable")
    x = {n: a[order] for n, a in x.items()}
    exact = float(np.abs(q["v"]).max(initial=0)) * float(np.abs(x["v"]).max(initial=0)) * max(1, q["v"].shape[1]) < 2.0**53
    qf, xf = (q["v"].astype(np.float64), x["v"].astype(np.float64)) if exact else (q["v"], x["v"])
    q_n = (q["v"].astype(np.float64) ** 2).sum(1)
    wanted = q["clusters"][:, x["cluster"]]
    some = np.linspace(0, len(qf) - 1, min(8, len(qf))).astype(int)
    left = [int((wanted[i] & (upper(np.abs(x["d"] - q["d"][i]).max(1), q_n[i], lift) >= q["floor"][i])).sum()) for i in some]
    where, ids, scores, evaluated = [], [], [], np.zeros(len(qf), np.int64)
    whole = sum(left) > (1 - WORTH) * len(some) * len(xf)
    for at in range(0, len(qf), 128):
        got = (qf[at : at + 128] @ xf.T).astype(np.int64) if whole else None
        for i in range(at, min(at + 128, len(qf))):
            if whole:
                on = np.flatnonzero(wanted[i] & (got[i - at] >= q["floor"][i]) & (x["id"] != q["id"][i]))
                evaluated[i] = wanted[i].sum()
                s = got[i - at][on]
            else:
                on = np.flatnonzero(wanted[i])
                most = upper(np.abs(x["d"][on] - q["d"][i]).max(1, initial=0), q_n[i], lift)
                keep = most >= q["floor"][i]
                on, most = on[keep], most[keep]
                turn = np.argsort(-most, kind="stable")
                on, most = on[turn], most[turn]
                parts, floor, done = [np.zeros(0, np.int64)], q["floor"][i], 0
                size = max(64, 4 * k)
                while done < len(on) and most[done] >= floor:
                    step = on[done : done + size]
                    parts.append((xf[step] @ qf[i]).astype(np.int64))
                    done += len(step)
                    size = min(2 * size, 4096)
                    own = np.concatenate(parts)[x["id"][on[:done]] != q["id"][i]]
                    if len(own) >= k:
                        floor = max(floor, -np.partition(-own, k - 1)[k - 1])
                evaluated[i] = done
                s, on = np.concatenate(parts), on[:done]
                keep = (s >= floor) & (x["id"][on] != q["id"][i])
                s, on = s[keep], on[keep]
            if len(on) > k:  # all that reach the k-th score, then ties by id
                keep = s >= -np.partition(-s, k - 1)[k - 1]
                s, on = s[keep], on[keep]
            top = np.lexsort((on, -s))[:k]
            where.append(np.full(len(top), i))
            ids.append(x["id"][on[top]])
            scores.append(s[top])
    flat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return flat(where), flat(ids), flat(scores), evaluated


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query its k best other rows by the inner product of
    floor(scale * component), ties to smaller ids; fewer if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Rows that share an id are
    one, the greatest vector standing for it. Shorter vectors count as padded with zeros. Other columns are not
    read; an empty table gives an empty result. Scores must fit into a long.

    The driver sees the pivots and two tables of clusters by pivots, PIVOTS squared at most whatever the input. Blocks of
    queries meet slices of candidates, both of bounded size, in one task.
    """
    import pyarrow as pa

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("id").agg(F.max(F.struct("v", "q")).alias("r")).select("id", F.transform("r.v", lambda x: F.floor(x * scale).cast("long")).alias("v"), "r.q")
    rows = staged(rows, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    n, n_q, width, lift, largest = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v")), F.max(squares), F.max(largest)).first()
    width, lift = max(width or 0, 1), float(lift or 0)
    whole = np.int16 if (largest or 0) < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
    padded = lambda lists: np.array([[*v, *[0] * (width - len(v))] for v in lists], np.int64).reshape(-1, width)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()]
    pivot = choose_pivots(lifted(padded(sample).astype(np.float64), lift), max(LEAST_PIVOTS, min(pivots, n // CLUSTER_ROWS)))

    def tabled(batches):
        for b in batches:
            v = padded(b["v"].to_pylist())
            d = distances(v.astype(np.float64), pivot, lift)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([b["id"], b["q"], pa.array(d.argmin(1) if len(v) else [], pa.int32()), binary(v.astype(whole)), binary(d)], ["id", "q", "cluster", "v", "d"])

    rows = staged(rows.mapInArrow(tabled, "id long, q boolean, cluster int, v binary, d binary"), "pivot-table")
    grid = lambda column, kind, m: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, m)

    def spread(batches):
        least, most, size = np.full((len(pivot),) * 2, np.inf, np.float32), np.full((len(pivot),) * 2, -np.inf, np.float32), np.zeros(len(pivot), np.int64)
        for b in batches:
            c, d = b["cluster"].to_numpy(), grid(b["d"], np.float32, len(pivot))
            np.minimum.at(least, c, d)
            np.maximum.at(most, c, d)
            size += np.bincount(c, minlength=len(pivot))
        on = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(size[on]), *[pa.array([r.tolist() for r in a[on]], pa.list_(pa.float32())) for a in (least, most)]], ["cluster", "n", "least", "most"])

    parts = rows.select("cluster", "d").mapInArrow(spread, "cluster int, n long, least array<float>, most array<float>")
    parts = parts.select("cluster", "n", F.posexplode(F.arrays_zip("least", "most")).alias("p", "x"))
    parts = parts.groupBy("cluster", "p").agg(F.min("x.least").alias("least"), F.max("x.most").alias("most"), F.sum("n").alias("n")).collect() if len(pivot) else []
    least, most, size = np.full((len(pivot),) * 2, np.inf), np.full((len(pivot),) * 2, -np.inf), np.zeros(len(pivot), np.int64)
    for r in parts:
        least[r["cluster"], r["p"]], most[r["cluster"], r["p"]], size[r["cluster"]] = r["least"], r["most"], r["n"]
    slices, blocks = max(1, -(-n // SLICE)), max(1, -(-(n_q or 0) // QUERY_BLOCK))
    # whole clusters fill slices up; a large cluster is dealt over several
    share = np.maximum(1, -(-size // SLICE))
    first = np.floor(np.concatenate([[0], np.cumsum(size)[:-1]]) / SLICE).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    slices = int((first + share).max(initial=1))
    own_slice = F.array(*[F.lit(int(i)) for i in first])[F.col("cluster")] + F.pmod(F.xxhash64("id"), F.array(*[F.lit(int(i)) for i in share])[F.col("cluster")])
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), (own_slice if len(pivot) else F.lit(0)).cast("int").alias("s"), "id", "v", "d", "cluster")
    asked = rows.filter("q").select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("b"), "id", "v")

    def chosen(again: bool):
        """Which slices a query goes to and which clusters it searches there: those with the best bounds that hold enough
        candidates, or those that are left and reach its floor."""

        def run(batches):
            for b in batches:
                v = grid(b["v"], whole, width).astype(np.float64)
                q_n = (v * v).sum(1)
                bound = cluster_bounds(distances(v, pivot, 0.0), least, most)
                turn = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(size[turn], axis=1) - size[turn]
                seeds = np.zeros(bound.shape, bool)
                np.put_along_axis(seeds, turn, held < 4 * (k + 1), axis=1)
                floor = b["floor"].to_numpy() if again else np.full(len(v), LOWEST)
                search = (~seeds & (upper(bound, q_n[:, None], lift) >= floor[:, None])) if again else seeds
                search &= size[None] > 0
                at, to = [], []
                for i in range(len(v)):
                    c = np.flatnonzero(search[i])
                    go = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(first[j], first[j] + share[j]) for j in c]]))
                    at += [i] * len(go)
                    to += go.tolist()
                flags = pa.array([np.packbits(search[i]).tobytes() for i in at], pa.binary())
                take = lambda a: a.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([take(b["b"]), pa.array(to, pa.int32()), take(b["id"]), take(b["v"]), pa.array(floor[at] if at else [], pa.int64()), flags], ["b", "s", "id", "v", "floor", "clusters"])

        return run

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not len(a) or not len(b):
            return pa.table({"query_id": none, "vec_id": none, "score": none})
        both = lambda t: {"id": t["id"].to_numpy().astype(np.int64), "v": grid(t["v"], whole, width).astype(np.int64)}
        clusters = np.unpackbits(grid(a["clusters"], np.uint8, -(-len(pivot) // 8)), axis=1)[:, : len(pivot)].astype(bool)
        q, x = both(a), both(b) | {"d": grid(b["d"], np.float32, len(pivot)), "cluster": b["cluster"].to_numpy()}
        # the table holds a query's distances as a candidate; as a query it lacks the added component
        q |= {"d": distances(q["v"].astype(np.float64), pivot, 0.0), "floor": a["floor"].to_numpy(), "clusters": clusters}
        where, found, scores, _ = search_slice(q, x, k, lift)
        return pa.table({"query_id": q["id"][where], "vec_id": found, "score": scores})

    sent, result = "b int, s int, id long, v binary, floor long, clusters binary", "query_id long, vec_id long, score long"
    meet = lambda left: left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(search, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    seeds = staged(meet(asked.mapInArrow(chosen(False), sent)), "seeds")
    floors = best(seeds).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.join(small(staged(floors, "floors")), "id", "left").select("b", "id", "v", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
    return best(seeds.unionByName(meet(known.mapInArrow(chosen(True), sent)))).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
