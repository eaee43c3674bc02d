"""Hashed words and word shingles, in NumPy.

Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased: what bytes.lower()
and bytes.split() give. Hashes have 64 bits. Many documents are hashed at once, from
the buffers of an Arrow column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Odd multipliers of the hash functions.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165],
    dtype=np.uint64,
)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * MULTIPLIERS[1]
    h = h ^ (h >> np.uint64(29))
    h = h * MULTIPLIERS[4]
    return h ^ (h >> np.uint64(32))


#: Bytes hashed at once, unless one document has more: their values stay in a processor's cache.
CHUNK_BYTES = 1 << 17
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A value for each byte; A-Z have those of a-z, spaces have none.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0])
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _BASE, and of its inverse."""
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of documents that lie in raw (bytes) between offsets, and where each document's words begin.

    A word's hash is a polynomial of its bytes, taken from running sums.
    """
    n = len(raw)
    inside = np.append(~_SPACE[raw], False)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | border))
    ends = np.flatnonzero(before & (~inside | border))
    power, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * power[:n])])
    h = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[5])
    return h, np.searchsorted(starts, offsets)


def sequences(texts: pa.Array, size: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingles) of each text in order; without a size no shingles are made."""
    size = size or 1
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        words, at = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        all_ = masked(words, tuple(range(size)), size) if size > 1 else words
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield words[a:b], (all_[a : b - size + 1] if b - a >= size else shingled(words[a:b], size))
        i = j


def hashed(text: str) -> np.ndarray:
    """The word hashes of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def masked(words: np.ndarray, ones: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """At each place, the hash of the words at the offsets in ones."""
    n = len(words) - ones[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k, o in enumerate(ones):
        total += words[o : o + n] * MULTIPLIERS[k]
    return mixed(total)


def shingled(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles in order; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    return masked(words, tuple(range(min(size, len(words)))), min(size, len(words)))


def best_segment(equal: np.ndarray, share: float, at: int | None = None) -> tuple[int, int]:
    """[i, j) with the largest count of trues less its mismatches' price; true for at least share of it. With at, of those that hold it."""
    price = share / (1 - share) * (1 - 1e-7)  # of segments with just that share, the longest
    s = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -price))])
    if at is not None:
        i, j = int(np.argmin(s[: at + 1])), at + 1 + int(np.argmax(s[at + 1 :]))
        return (i, j) if s[j] >= s[i] else (at, at)
    low = np.minimum.accumulate(s)
    j = int(np.argmax(s - low))
    i = int(np.argmin(s[: j + 1]))
    return i, j


def longest_segment(equal: np.ndarray, share: float) -> tuple[int, int]:
    """[i, j) of the longest segment that is true for at least share; of several, the one with most trues, then the first."""
    count = np.zeros(len(equal) + 1, np.int64)
    equal.cumsum(out=count[1:])
    s = count - share * np.arange(len(count))
    behind = np.maximum.accumulate(s[::-1])  # ascending: the last place with at least a value is sought in it
    n = len(s)
    j = n - 1 - behind.searchsorted(s - 1e-9)
    width = j - np.arange(n)
    best = np.flatnonzero(width == width.max())
    i = int(best[np.argmax(count[j[best]] - count[best])])
    return i, int(j[i])
