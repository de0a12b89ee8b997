"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with how often it occurred before. Each of BANDS sketches takes
the SAMPLE labelled k-mers with the least hashes and keeps them in text order, so two texts share a sketch only
if they hold these k-mers in one order, which follows edit similarity rather than set similarity. Texts that share a
sketch are candidates; a candidate is linked if the alignment of the two word sequences, banded by the
edits that the threshold allows, has similarity 1 - edits / longer length >= threshold. Classes are the connected links.

Rows are told apart by a number of their own, not by their id, and equal texts are one node from the start. A first round divides buckets by length and compares each text with the first and last
id of its part only, which joins most classes with few pairs. Then, in each bucket whose texts lie in several classes, all pairs of texts
of different classes are taken whose lengths allow a link, so classes are those of all pairs that share a sketch. Word counts in
BINS bins give a lower bound of the edits; pairs that exceed the threshold by this bound are dropped before their words
are read, which loses none. Large buckets are cut into blocks, and each two blocks are one unit of work.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm._graph import connected
from foldmark.llm._shared import bare, lean, small, staged
from foldmark.llm._words import mixed, word_hashes

K, SAMPLE, BANDS = 5, 2, 32
#: Bins of the word counts, the fewer ones into which they are folded for a first look, and texts of a block at most about.
BINS, COARSE, BLOCK = 1024, 256, 512
THRESHOLD = 0.8
_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the labelled k-mers in text order; a text of fewer words is one k-mer, an empty one has none."""
    if not len(words):
        return words
    m = np.uint64(0x9E3779B97F4A7C15)
    k = min(K, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * m + words[i : i + n]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    if len(new) < n:
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        h = np.where(label > 0, mixed(h + label), h)
    return h


def sketch(words: np.ndarray) -> np.ndarray:
    """A bucket for each band, as signed 64-bit numbers; none for an empty text."""
    h = kmers(words)
    if not len(h):
        return np.zeros(0, np.int64)
    size = min(SAMPLE, len(h))
    at = np.empty((BANDS, size), np.int64)
    step = max(1, (1 << 18) // len(h))
    for b in range(0, BANDS, step):
        some = mixed(h[None, :] ^ _SEEDS[b : b + step, None])
        at[b : b + step] = np.argpartition(some, size - 1, axis=1)[:, :size] if size < len(h) else np.arange(size)
    at.sort(axis=1)
    key = _SEEDS.copy()
    for i in range(size):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[at[:, i]])
    return mixed(key).view(np.int64)


def word_bins(words: np.ndarray) -> bytes:
    """How many words fall into each of BINS bins, 255 at most, a byte each."""
    return np.minimum(np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def folded(bins: np.ndarray) -> np.ndarray:
    """Rows of BINS bins as rows of COARSE ones."""
    return bins.reshape(len(bins), COARSE, -1).sum(axis=2, dtype=np.uint16)


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the edits between each row of bins in a and each in b.

    An edit takes at most one word out of one bin and puts one into another, so the bins' sums of surpluses and of
    lacks, whichever is more, are never above the edits. That also holds for counts cut off at 255 and for folded bins.
    """
    out = np.empty((len(a), len(b)), np.int64)
    size_b = b.sum(axis=1, dtype=np.int64)
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        some = a[i : i + step]
        apart = (np.maximum(some[:, None], b[None]) - np.minimum(some[:, None], b[None])).sum(axis=2, dtype=np.uint32)
        out[i : i + step] = (apart + np.abs(some.sum(axis=1, dtype=np.int64)[:, None] - size_b[None])) // 2
    return out


def least_edits_of_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """least_edits() of the rows i of a and the rows j of b, pair by pair."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 4096):
        u, v = a[i[k : k + 4096]], b[j[k : k + 4096]]
        apart = (np.maximum(u, v) - np.minimum(u, v)).sum(axis=1, dtype=np.int64)
        out[k : k + 4096] = (apart + np.abs(u.sum(axis=1, dtype=np.int64) - v.sum(axis=1, dtype=np.int64))) // 2
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences if it is at most `most`, else most + 1.

    Equal ends are cut off; then a bit-parallel alignment goes over the longer sequence word by word. The differences of
    neighbouring cells of the current column are bits of two integers, which hold only the cells within `most` of the
    diagonal, and some more: the window moves on in steps. Cells outside count as one more than their neighbour
    inside, which is never too little, and no alignment of at most `most` edits goes through them.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b) if len(b) <= most else most + 1
    both = np.concatenate([a, b])
    _, code = np.unique(both, return_inverse=True)
    count = np.bincount(code[: len(a)], minlength=code.max() + 1) - np.bincount(code[len(a) :], minlength=code.max() + 1)
    if max(int(count[count > 0].sum()), int(-count[count < 0].sum())) > most:
        return most + 1
    cells, columns = code[: len(a)].tolist(), code[len(a) :].tolist()
    m, n = len(cells), len(columns)
    # bit i of vp / vn: cell base + i + 1 is one more / less than cell base + i; first is the value of cell base
    base, top, first, vp, vn = 0, 0, 0, 0, 0
    step = max(64, most // 2)
    for at in range(0, n, step):
        end = min(n, at + step)
        low, high = max(0, at - most), min(m, end + most)
        if low > base:
            gone = (1 << (low - base)) - 1
            first += (vp & gone).bit_count() - (vn & gone).bit_count()
            vp, vn, base = vp >> (low - base), vn >> (low - base), low
        if high > top:
            vp |= ((1 << (high - top)) - 1) << (top - base)
            top = high
        full = (1 << (top - base)) - 1
        match: dict[int, int] = {}
        for i in range(base, top):
            match[cells[i]] = match.get(cells[i], 0) | (1 << (i - base))
        for c in columns[at:end]:
            x = match.get(c, 0)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = ((vn | ~(d0 | vp)) << 1) | 1
            hn = (d0 & vp) << 1
            vp = (hn | ~(d0 | hp)) & full
            vn = hp & d0 & full
        first += end - at
        if first - vn.bit_count() > most:  # no cell of the window is less
            return most + 1
    score = first + vp.bit_count() - vn.bit_count()
    return score if score <= most else most + 1


def allowed(a: int, b: int, threshold: float) -> int:
    """The edits that leave similarity >= threshold."""
    return int(math.floor((1 - threshold) * max(a, b) + 1e-9))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text), null texts as empty ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n, buckets, bins, rid) of every row; n is the number of words, rid the row's own number, which holds
    once it is written."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n, keys, bins = [], [], []
            for h in word_hashes(b["text"].to_pylist()):
                n.append(len(h))
                keys.append(sketch(h))
                bins.append(word_bins(h))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["digest"], pa.array(n, pa.int32()), lists, pa.array(bins, pa.binary())], ["id", "digest", "n", "buckets", "bins"])

    rows = _identified(docs, id_col, text_col).mapInArrow(lean(run), "id long, digest string, n int, buckets array<long>, bins binary")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _long_enough(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Whether texts of a and b words can be linked at all."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-6


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (x, y) of representatives (first: rep, digest, least) whose texts align."""
    import pyarrow as pa

    ends = pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct()
    needed = staged(first.join(ends, "rep", "left_semi").select(F.col("rep").alias("rid"), F.col("digest").alias("d"), "least"), "needed")
    rows = _identified(docs, id_col, text_col)
    texts = rows.join(small(needed), (rows["digest"] == F.col("d")) & rows["id"].eqNullSafe(F.col("least"))).select("rid", "text")

    def sequences(batches):
        for b in batches:
            seqs = [h.tobytes() for h in ((h >> np.uint64(32)).astype(np.uint32) for h in word_hashes(b["text"].to_pylist()))]
            yield pa.RecordBatch.from_arrays([b["rid"], pa.array(seqs, pa.binary())], ["rid", "words"])

    words = staged(texts.mapInArrow(lean(sequences), "rid long, words binary"), "sequences")
    if words.count() > needed.count():  # rows that repeat whole
        words = staged(words.groupBy("rid").agg(F.first("words").alias("words")), "sequences")

    def align(batches):
        for b in batches:
            ok = []
            for p, q in zip(b["p"], b["q"]):
                u, v = np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(q.as_buffer(), np.uint32)
                most = allowed(len(u), len(v), threshold)
                ok.append(banded_distance(u, v, most) <= most)
            yield pa.RecordBatch.from_arrays([b["x"], b["y"]], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.join(words.select(F.col("rid").alias("y"), F.col("words").alias("q")), "y").join(words.select(F.col("rid").alias("x"), F.col("words").alias("p")), "x")
    return rows.select("x", "y", "p", "q").mapInArrow(lean(align), "x long, y long")


def _across(unit: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of one unit's texts that are of different classes and not too far apart by length and bins.

    A unit holds one block, all of whose pairs are compared, or two, of which each pair across is. own texts are those of the
    unit's own length cell, the others those of the next one, whose pairs among themselves are another unit's. A pair that
    shares several buckets is found in the first of them only.
    """
    left = np.flatnonzero(unit["block"] == unit["block"].min())
    right = np.flatnonzero(unit["block"] == unit["block"].max())
    n, c, rid, own = unit["n"].astype(np.int64), unit["c"], unit["rid"], unit["own"]
    longer = np.maximum(n[left][:, None], n[right][None])
    most = np.floor((1 - threshold) * longer + 1e-9)
    ok = (c[left][:, None] != c[right][None]) & (own[left][:, None] | own[right][None])
    ok &= longer - np.minimum(n[left][:, None], n[right][None]) <= most
    if unit["apart"].any():
        ok &= unit["block"].min() < unit["block"].max()
    else:
        ok &= rid[left][:, None] < rid[right][None]
    for band in range(int(unit["band"][0])):
        ok &= unit["buckets"][left, band][:, None] != unit["buckets"][right, band][None]
    if not ok.any():
        return rid[:0], rid[:0]
    rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    ok, most = ok[np.ix_(rows, cols)], most[np.ix_(rows, cols)]
    a, b = unit["bins"][left[rows]], unit["bins"][right[cols]]
    i, j = np.nonzero(ok & (least_edits(folded(a), folded(b)) <= most))
    near = least_edits_of_pairs(a, b, i, j) <= most[i, j]
    i, j = i[near], j[near]
    u, v = rid[left[rows[i]]], rid[right[cols[j]]]
    return np.minimum(u, v), np.maximum(u, v)


def _remaining(rows: DataFrame, bands: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """All pairs (x, y) of texts that share a bucket, lie in different classes and can be linked by length and word counts.

    Lengths are put on a grid so wide that texts which can be linked lie in one cell or in two neighbouring ones.
    """
    import pyarrow as pa

    known = bands.join(label, bands["rid"] == label["node"], "left").select("rid", "n", "band", "bucket", F.coalesce("label", "rid").alias("c"))
    known = staged(known, "classed")
    differ = (F.min("c") < F.max("c")).alias("differ")
    several = staged(known.groupBy("bucket").agg(differ).filter("differ").select("bucket"), "several")
    cell = F.floor(F.log("n") / math.log(1.001 / threshold)).alias("cell")
    celled = known.join(several, "bucket").select("rid", "n", "c", "band", "bucket", cell)
    celled = celled.select("rid", "n", "c", "band", F.explode(F.array(F.struct(F.xxhash64("bucket", "cell").alias("part"), F.lit(True).alias("own")), F.struct(F.xxhash64("bucket", F.col("cell") - 1).alias("part"), F.lit(False).alias("own")))).alias("e")).select("rid", "n", "c", "band", "e.part", "e.own")
    celled = staged(celled, "celled")
    parts = celled.groupBy("part").agg(differ, F.max("own").alias("any"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("differ AND any").select("part", "blocks")
    placed = celled.join(staged(parts, "parts"), "part").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    units = placed.select("rid", "n", "c", "band", "own", "block", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = staged(units.select("rid", "n", "c", "band", "own", "block", (F.col("block") != F.col("other")).alias("apart"), F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other")).alias("unit")), "units")
    units = units.join(rows.select("rid", "bins", "buckets"), "rid")

    def compare(batches):
        held = None

        def pairs(table):
            unit = table["unit"].to_numpy()
            if not len(unit):
                return
            at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            columns = {k: table[k].to_numpy() for k in ("rid", "n", "c", "band", "own", "block", "apart")}
            columns["buckets"] = table["buckets"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            columns["bins"] = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
            found = [_across({k: v[i:j] for k, v in columns.items()}, threshold) for i, j in zip(at, np.append(at[1:], len(unit)))]
            found = np.concatenate([np.stack(p, axis=1) for p in found])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            unit = held["unit"].to_numpy()
            cut = int(np.argmax(unit == unit[-1]))  # the last unit may go on in the next batch
            yield from pairs(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from pairs(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(compare), "x long, y long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (rid, id, digest, rep, least, class_rid, class_id), a row for each row of docs, and links (x, y) between reps.

    rid numbers the rows of this call, rep is the least rid of rows with the row's text, class_rid that of its class;
    least and class_id are the least ids of the same, null where no row has one. Ids may be null or repeat: each row is a
    document of its own, so rows of one id and different texts may lie in different classes, and classes that share a class_id
    so are told apart by class_rid. Null texts equal empty ones. Texts under five words are near only to texts
    with the same words. Other columns are not read; an empty table gives empty results.
    """
    rows = staged(sketched(docs, id_col, text_col), "sketches")
    first = staged(rows.groupBy("digest").agg(F.min("rid").alias("rep"), F.min("id").alias("least")), "representatives")
    own = rows.join(first.select(F.col("rep").alias("rid")), "rid", "left_semi")
    bands = own.select("rid", "n", F.posexplode("buckets").alias("band", "bucket"))
    # the grid of lengths is as wide as the threshold allows and shifted for each band, so it parts similar texts in some bands only
    bands = bands.select("rid", "n", "band", "bucket", F.floor(F.log("n") / -math.log(threshold) + F.col("band") / BANDS).alias("cell"))
    one = F.struct("rid", "n")
    ends = bands.groupBy("bucket", "cell").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low.rid < high.rid")
    ends = staged(ends, "buckets")
    pairs = bands.join(ends, ["bucket", "cell"]).select("rid", "n", F.explode(F.array("low", "high")).alias("e")).filter("rid <> e.rid").filter(_long_enough("n", "e.n", threshold))
    pairs = staged(pairs.select(F.least("rid", "e.rid").alias("x"), F.greatest("rid", "e.rid").alias("y")).distinct(), "pairs")
    links = staged(verified(pairs, first, docs, threshold, id_col, text_col), "links")
    more = staged(_remaining(rows, bands, connected(links), threshold).join(pairs, ["x", "y"], "left_anti"), "more-pairs")
    links = staged(links.unionByName(verified(more, first, docs, threshold, id_col, text_col)), "all-links")
    label = connected(links)
    classed = staged(first.join(label, first["rep"] == label["node"], "left").select("digest", "rep", "least", F.coalesce("label", "rep").alias("class_rid")), "labelled")
    names = staged(classed.groupBy("class_rid").agg(F.min("least").alias("class_id")), "class-names")
    classed = staged(classed.join(names, "class_rid"), "classes")
    return rows.select("rid", "id", "digest").join(classed, "digest"), links


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document, a row for each row of docs."""
    members, _ = near_duplicates(docs)
    return members.select(F.col("id").alias("doc_id"), "class_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of its least id, null ids last; of its rows with that id the one whose text has the
    least digest, and of rows equal in both any one. Whole rows are shuffled only where such rows repeat."""
    members, _ = near_duplicates(docs, id_col=id_col, text_col=text_col)
    one = members.filter("rid = rep").groupBy("class_rid").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("k"))
    kept = staged(one.select(F.col("k.digest").alias("kept_digest"), F.col("k.least").alias("kept_id")), "kept")
    same = lambda d, i: (d == F.col("kept_digest")) & i.eqNullSafe(F.col("kept_id"))
    times = members.select("id", "digest").join(kept, same(F.col("digest"), F.col("id"))).groupBy("kept_digest", "kept_id").count()
    repeated = staged(times.filter("count > 1").drop("count"), "repeated")
    key = bare(docs, {"kept_digest", "kept_id"}, "__digest")
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    on = same(F.col(key), F.col(id_col).cast("long"))
    if repeated.isEmpty():
        return rows.join(small(kept), on, "left_semi").drop(key)
    once = kept.join(repeated, (kept["kept_digest"] == repeated["kept_digest"]) & kept["kept_id"].eqNullSafe(repeated["kept_id"]), "left_anti")
    several = rows.join(small(repeated), on, "left_semi").dropDuplicates([key, id_col])
    return rows.join(small(staged(once, "kept-once")), on, "left_semi").unionByName(several).drop(key)
