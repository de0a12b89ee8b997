"""Token ids in binary segments of patched frame-of-reference blocks.

A segment is one self-contained byte string; Spark's writer stores segments as rows, so any store that Spark
writes to will do and a lost task is simply written again by the commit protocol. All numbers are little-endian.

    header      magic "PFB1", u32 documents, u64 ids, u32 blocks
    lengths     u32 for each document: its number of ids
    index       u64 for each block: the byte at which it starts, counted from the first block
    block       u32 minimum, u8 width, u8 exceptions, u16 zero; the packed values
    exceptions  the positions of all blocks' exceptions, u8 each; then their high parts, u32 each

A block holds 128 ids, the last one padded with its minimum. Each id less the minimum keeps its low `width` bits:
the 128 values stand in 32 rows of 4 lanes, and each lane packs its 32 values into `width` u32 words. The width is
what the percentile of the block's values needs; what does not fit is an exception, its high bits kept apart.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
import struct
import sys
import unicodedata
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import lean, staged

MAGIC = b"PFB1"
BLOCK, ROWS, LANES = 128, 32, 4
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 18
#: Bytes that a worker remembers chunks and their ids in; past this it forgets all but those that came most often and goes on.
MEMO_BYTES = 96 << 20
#: UTF-8 bytes of texts after which they are encoded together with the text at hand.
BATCH_BYTES = 4 << 20


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each number under 2**32 needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 128) numbers under 2**width as (m, 4 * width) words."""
    v = values.reshape(-1, ROWS, LANES)
    out = np.zeros((len(v), width, LANES), np.uint32)
    for i in range(ROWS if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(v), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(-1, width, LANES)
    out = np.zeros((len(w), ROWS, LANES), np.uint32)
    low = np.uint32((1 << width) - 1)
    for i in range(ROWS if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, i] = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, i] |= w[:, word + 1] << np.uint32(32 - shift)
        out[:, i] &= low
    return out.reshape(len(w), BLOCK)


def encode_segment(ids: np.ndarray, lengths: np.ndarray, percentile: float = 90.0) -> bytes:
    """ids of consecutive documents, under 2**32, as one segment. lengths: of each document."""
    ids, n = np.ascontiguousarray(ids, np.uint32), len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + struct.pack("<IQI", len(lengths), n, blocks) + np.asarray(lengths, "<u4").tobytes()
    if not blocks:
        return head
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n], v[n:] = ids, ids[(blocks - 1) * BLOCK :].min()
    v = v.reshape(blocks, BLOCK)
    least = v.min(1)
    v = v - least[:, None]
    rank = max(0, min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _bits(np.partition(v, rank, axis=1)[:, rank])
    over = v >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(1)
    start = np.concatenate([[0], np.cumsum(2 + 4 * width)])  # in u32 words
    out = np.zeros(start[-1], "<u4")
    out[start[:-1]] = least
    out[start[:-1] + 1] = width | n_over << 8
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[(start[at] + 2)[:, None] + np.arange(4 * int(w))] = _pack(v[at] & np.uint32((1 << int(w)) - 1), int(w))
    block, where = np.nonzero(over)
    high = v[block, where] >> width[block].astype(np.uint32)
    return head + (4 * start[:-1]).astype("<u8").tobytes() + out.tobytes() + where.astype(np.uint8).tobytes() + high.astype("<u4").tobytes()


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and each document's number of ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, total, blocks = struct.unpack_from("<IQI", data, 4)
    lengths = np.frombuffer(data, "<u4", docs, 20).astype(np.int64)
    if not blocks:
        return np.zeros(0, np.uint32), lengths
    start = np.frombuffer(data, "<u8", blocks, 20 + 4 * docs).astype(np.int64) // 4
    begin = 20 + 4 * docs + 8 * blocks
    last = begin + 4 * (int(start[-1]) + 1)
    words = np.frombuffer(data, "<u4", int(start[-1]) + 2 + 4 * data[last], begin)
    least, width, n_over = words[start], (words[start + 1] & 255).astype(np.int64), (words[start + 1] >> 8 & 255).astype(np.int64)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        v[at] = _unpack(words[(start[at] + 2)[:, None] + np.arange(4 * int(w))], int(w))
    if n := int(n_over.sum()):
        at = begin + 4 * len(words)
        block, where = np.repeat(np.arange(blocks), n_over), np.frombuffer(data, np.uint8, n, at)
        v[block, where] |= np.frombuffer(data, "<u4", n, at + n) << width[block].astype(np.uint32)
    return (v + least[:, None]).reshape(-1)[:total], lengths


#: A run of letters and a run of ASCII punctuation after it, which may be empty.
_PLAIN = re.compile(rf"([^\W\d_]+)([{re.escape(string.punctuation)}]*)")


#: Stands for the end of a text among chunks, none of which is white space.
END = " "


class _Memo(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Pieces(dict):
    """What the model makes of a piece: its ids as u32 numbers side by side, as a list of them takes several times as much memory."""

    def __init__(self, tokenizer, known=()):
        super().__init__(known)
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = array("I", [t.id for t in self.tokenize(piece)]).tobytes()
        return ids


class _Letters(dict):
    """For str.translate: what the tokenizer makes of a letter inside a word. A NUL marks what it does not keep in the word."""

    def __init__(self, tokenizer):
        self.cut = lambda x: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(x))]

    def __missing__(self, code: int) -> str:
        got = self.cut(f"a{chr(code)}a")
        self[code] = out = got[0][1:-1] if len(got) == 1 and len(got[0]) > 2 and got[0][0] == got[0][-1] == "a" else "\0"
        return out


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct chunk of text once.

    No token of such a tokenizer spans ASCII white space, so a text's ids are those of its chunks in turn, and each
    distinct chunk's ids are kept. New chunks go through the tokenizer's own normalizer, pre-tokenizer and model, which
    is far quicker than a whole encode() for each. A chunk of letters goes to the model letter by letter as those two
    write each letter, and ASCII punctuation after letters is a piece of its own. Texts that may hold special
    tokens, chunks with other white space, and any tokenizer for which the probes below don't hold take encode().
    """

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(spec), end_id
        self.marks = {x.content.lower()[:2] for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.apart = bool(self.tokenizer.pre_tokenizer and self.tokenizer.normalizer) and self._probes()
        self.forget()

    def _probes(self) -> bool:
        t = self.tokenizer
        ids = lambda x: t.encode(x, add_special_tokens=False).ids
        cuts = all(ids(f"{a}{s}{b}") == ids(a) + ids(b) for a in ("Ab", "x.", "7") for b in ("cd", "'s", "9!") for s in (" ", "\n", "\t  "))
        stops = all(ids(a + b) == ids(a) + ids(b) for a in ("ab", "x", "\u00e9t\u00e9") for c in string.punctuation for b in (c, c * 3, c + ".", "'" + c))
        plain = all(t.normalizer.normalize_str(x) == x.lower() and [p for p, _ in t.pre_tokenizer.pre_tokenize_str(x.lower())] == [x.lower()] for x in ("abcdefghijklmnopqrstuvwxyz", "THE", "s"))
        return cuts and stops and plain

    def forget(self) -> None:
        self.letters = _Letters(self.tokenizer)
        self._keep([END], np.array([self.end_id], np.uint32), np.ones(1, np.int64), np.ones(1, np.int32), {})

    def _keep(self, chunks: list[str], ids: np.ndarray, n: np.ndarray, uses: np.ndarray, pieces: dict[str, bytes]) -> None:
        self.memo, self.pieces, self.known = _Memo(zip(chunks, range(len(chunks)))), _Pieces(self.tokenizer, pieces), len(chunks)
        self.flat, self.begin, self.uses = ids, np.concatenate([[0], np.cumsum(n)]), uses
        self.strings = sum(map(sys.getsizeof, itertools.chain(chunks, pieces, pieces.values()))) + 32 * len(chunks)

    def thin(self) -> None:
        """Forget the chunks that came in one call of encode() only, and others until a quarter is left."""
        uses = self.uses[: self.known]
        at = np.argsort(-uses[1:], kind="stable")[: self.known // 4] + 1
        stay = np.zeros(self.known, bool)
        stay[0] = stay[at[uses[at] > 1]] = True
        chunks, n = list(itertools.compress(self.memo, stay)), np.diff(self.begin[: self.known + 1])
        ids = self.flat[: self.begin[self.known]][np.repeat(stay, n)]
        self._keep(chunks, ids, n[stay], -(-uses[stay] // 2), {c: self.pieces[c] for c in chunks if c in self.pieces})
        if self.remembered() > MEMO_BYTES // 2:  # long ones
            self.forget()

    def remembered(self) -> int:
        """Bytes of what is kept about chunks: the tables, and the strings, numbers and ids in them."""
        return sum(map(sys.getsizeof, (self.memo, self.pieces))) + self.flat.nbytes + self.begin.nbytes + self.uses.nbytes + self.strings

    def _put(self, chunks: list[str]) -> None:
        before = len(self.pieces)
        every = self._ids(chunks)
        n = np.fromiter(map(len, every), np.int64, len(every)) // 4
        at, new = self.begin[self.known], int(n.sum())
        while len(self.flat) < at + new:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.begin) < self.known + len(every) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.begin) - len(self.uses), np.int32)])
        self.flat[at : at + new] = np.frombuffer(b"".join(every), np.uint32)
        self.begin[self.known + 1 : self.known + 1 + len(every)] = at + np.cumsum(n)
        self.known += len(every)
        for strings in (chunks, *[itertools.islice(x, before, None) for x in (self.pieces, self.pieces.values())]):
            self.strings += sum(map(sys.getsizeof, strings))
        self.strings += 32 * len(chunks)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Of new chunks, which are in lower case as far as ASCII goes."""
        out, ids_of = [b""] * len(chunks), self.pieces
        rest, texts = [], []
        for i, chunk in enumerate(chunks):
            if chunk.isascii() and chunk.isalpha():
                out[i] = ids_of[chunk]
                continue
            if (plain := _PLAIN.fullmatch(chunk)) and unicodedata.is_normalized("NFC", chunk):
                word, end = plain.groups()
                if not word.isascii():
                    word = word.translate(self.letters)
                if "\0" not in word:
                    out[i] = ids_of[word] + ids_of[end] if end else ids_of[word]
                    continue
            if chunk:
                rest.append(i)
                texts.append(chunk)
        for at in range(0, len(rest), 256):
            some = texts[at : at + 256]
            text = self.tokenizer.normalizer.normalize_str(" ".join(some))
            stop = np.cumsum([len(x) + 1 for x in text.split(" ")])
            if len(stop) != len(some) or any(x.isspace() and x != " " for x in set(text)):
                own = [array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in some]
            else:
                parts: list[list[bytes]] = [[] for _ in some]
                cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
                for k, (piece, _) in zip(np.searchsorted(stop, [x[1][0] for x in cut], "right").tolist(), cut):
                    parts[k].append(ids_of[piece])
                own = map(b"".join, parts)
            for i, ids in zip(rest[at : at + 256], own):
                out[i] = ids
        return out

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct chunks, the place of each chunk of the texts among them, and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.string())
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(rows))  # white space at an end leaves an empty chunk, of no ids
        distinct = chunks.flatten().dictionary_encode()
        return distinct.dictionary.to_numpy(zero_copy_only=False), distinct.indices.to_numpy(), np.diff(chunks.offsets.to_numpy())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, null being empty, with the end id after each, and how many each text has."""
        if not self.apart or any(m in t.lower() for t in texts if t for m in self.marks):
            own = [[*x.ids, self.end_id] for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)
        keys, place, counts = self._chunks(texts)
        own = np.fromiter(map(self.memo.__getitem__, keys), np.int32, len(keys))
        del keys
        if len(self.memo) > self.known:
            self._put(list(itertools.islice(self.memo, self.known, None)))
        self.uses[own] += 1
        counts = counts.astype(np.int64)
        which = np.insert(own[place], np.cumsum(counts), 0)  # the end id after each text
        del place
        size = np.diff(self.begin[: self.known + 1])[which]
        done, doc_end = np.concatenate([[0], np.cumsum(size)]), np.cumsum(counts + 1)
        lengths = done[doc_end] - done[doc_end - counts - 1]
        kind = np.int32 if max(done[-1], len(self.flat)) < 1 << 31 else np.int64
        source = np.repeat((self.begin[which] - done[:-1]).astype(kind), size)
        source += np.arange(done[-1], dtype=kind)
        out = self.flat[source]
        if self.remembered() > MEMO_BYTES:
            self.thin()
        return out, lengths


@functools.lru_cache(maxsize=1)
def encoder(spec: str, end_id: int) -> Encoder:
    """The process's own encoder, for one task after another. A task must get it from this function, which is pickled by name: a
    table that the task's function names would be pickled with it, and each task would start with an encoder of its own."""
    return Encoder(spec, end_id)


def _batches(names, texts):
    """Ids and texts, of which about BATCH_BYTES become Python objects at a time. names, texts: Arrow arrays of one batch."""
    import pyarrow.compute as pc

    at = total = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        total += n or 0
        if total >= BATCH_BYTES or i == len(texts):
            yield names[at:i].to_pylist(), texts[at:i].to_pylist()
            at, total = i, 0


def write_segments(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, percentile: float = 90.0) -> DataFrame:
    """Encode every whole text and return the staged segments, in ascending id order over (part, segment).

    vocabulary: path of a tokenizers JSON file, read by the driver and broadcast (a vocabulary file has a fixed size).
    Rows come in order of id, nulls first, then by a hash of the text; rows that share an id stand side by side. Null
    texts are empty; an empty text has the end id alone. Columns other than the two named are not read.
    Segments: part int, segment int, before long (ids of the part's earlier segments), n_ids long, ids array<long>
    (the documents' own ids), payload binary.
    """
    import pyarrow as pa

    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches):
        encode = encoder(spec.value, end_id).encode
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        own, ids, lengths, size = [], [], [], 0

        def close():
            nonlocal segment, before, own, ids, lengths, size
            if not own:
                return
            flat = np.concatenate(ids)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64()), "ids": pa.array([own], pa.list_(pa.int64())), "payload": pa.array([encode_segment(flat, np.array(lengths), percentile)], pa.binary())}
            )
            segment, before = segment + 1, before + len(flat)
            own, ids, lengths, size = [], [], [], 0

        for batch in batches:
            for names, texts in _batches(batch.column(0), batch.column(1)):
                flat, n = encode(texts)
                at = 0
                for name, k in zip(names, n.tolist()):
                    own.append(name)
                    ids.append(flat[at : at + k])
                    lengths.append(k)
                    at, size = at + k, size + k
                    if size >= SEGMENT_IDS:
                        yield from close()
        yield from close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return staged(rows.mapInArrow(lean(write), "part int, segment int, before long, n_ids long, ids array<long>, payload binary"), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """Read staged segments back: for each document doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only totals of parts, one row for each partition that wrote, are summed in one task.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    def read(batches):
        for batch in batches:
            for begin, names, payload in zip(batch["begin"].to_pylist(), batch["ids"].to_pylist(), batch["payload"].to_pylist()):
                ids, n = decode_segment(payload)
                end = np.cumsum(n)
                data = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(names, pa.int64()), "start": pa.array(begin + end - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist())], pa.int64())}
                )

    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    rows = segments.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("begin"), "ids", "payload")
    return rows.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
