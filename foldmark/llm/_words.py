"""Words of many texts as 64-bit hashes in NumPy arrays, without a Python object for each word.

A word is a run of ASCII letters and digits and of bytes beyond ASCII, in lower case.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text that are hashed at once; a longer text is cut between words.
CHUNK = 1 << 20
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK * 5 // 4)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of x moves about half of all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For data, which ends in a byte of no word: the hash of each word and where it begins."""
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[b].view(np.int8), prepend=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    power, inverse = _upto(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mixed((total[end] - total[begin]) * inverse[begin]), begin


def _pieces(data: bytes):
    at = 0
    while len(data) - at > 2 * CHUNK:
        end = at + CHUNK
        while end < len(data) and _WORD[data[end]]:
            end += 1
        yield data[at:end] + b" "
        at = end
    yield data[at:] + b" "


def word_hashes(texts):
    """Yield for each text, null being empty, the array of its words' hashes, in order."""
    wait: list[bytes] = []
    size = 0

    def flush():
        if wait:
            h, begin = _hashes(b"".join(wait))
            cut = np.searchsorted(begin, np.cumsum([len(x) for x in wait]))
            yield from np.split(h, cut[:-1])

    for text in texts:
        data = (text or "").lower().encode("utf-8", "replace") + b" "
        if size + len(data) > CHUNK:
            yield from flush()
            wait, size = [], 0
        if len(data) > 2 * CHUNK:
            yield np.concatenate([_hashes(x)[0] for x in _pieces(data)])
        else:
            wait.append(data)
            size += len(data)
    yield from flush()
