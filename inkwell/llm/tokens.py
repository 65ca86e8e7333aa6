"""Words of Arrow string columns and their hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All of these are ASCII, so bytes of
UTF-8 and code points give the same words. A-Z are lower-cased, other letters kept.

A word's 64-bit hash keeps no algebra of its bytes: repetitive words don't collide as they do under a
polynomial. Among n distinct words or n-grams some n * n / 2^65 pairs collide by chance; where that must not
decide, words themselves are compared (``shingles``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
KEY = b"inkwell words 1"

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_KEYS = _rng.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(_STEP, 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column with about ``limit`` bytes of text each (a longer text stands alone)."""
    _, off = text_buffers(column)
    first = 0
    while first < len(off) - 1:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, last
        first = last
    pa.default_memory_pool().release_unused()


def split_words(text: bytes) -> list[bytes]:
    """The words of a text in order, A-Z lower-cased: ``bytes`` methods know ASCII letters and these six separators only."""
    return text.lower().split()


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in order, and the n + 1 word offsets of the texts.

    A word of up to 16 bytes is two integers, which are mixed; a longer one is hashed by BLAKE2b.
    """
    n = len(raw)
    word = ~_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[1:n] = word[1:] & ~word[:-1]
    first[off[:-1]] = True
    starts = np.flatnonzero(first[:n] & word)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:n] = word[:-1] & ~word[1:]
    stop[off[1:]] = True
    ends = np.flatnonzero(stop[1:] & word) + 1
    size = ends - starts
    data = np.concatenate([_LOWER[raw], np.zeros(24, np.uint8)]).tobytes()
    at = np.ndarray((n + 16,), "<u8", data, strides=(1,))
    head, tail = at[starts] & _MASK[np.minimum(size, 8)], at[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
    out = mix(mix(head ^ _KEYS[0]) * _KEYS[1] + mix(tail ^ _KEYS[2]) + size.astype(np.uint64))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=KEY).digest(), "little")
    return out, np.searchsorted(starts, off).astype(np.int64)


def sequences(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The words of each text, joined by single spaces."""
    word = ~_SPACE[raw]
    kept = word.copy()
    kept[1:] |= word[:-1]
    data = np.where(word, _LOWER[raw], np.uint8(0x20))[kept].tobytes()
    cut = np.concatenate([[0], np.cumsum(kept)])[off].tolist()
    return [data[a:b].strip(b" ") for a, b in zip(cut, cut[1:])]


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive 64-bit hash of equally long sequences of word hashes."""
    acc = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        acc = mix(acc * np.uint64(0xA0761D6478BD642F) + p)
    return acc


def ngram_hashes(words: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive words within a text, and their offsets by text."""
    if n == 1:
        return words, woff
    count = np.maximum(np.diff(woff) - (n - 1), 0)
    off = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(off[-1]) + np.repeat(woff[:-1] - off[:-1], count)
    return chain([words[at + i] for i in range(n)]) if len(at) else np.zeros(0, np.uint64), off


def shingles(words: list[bytes], width: int = 5) -> set[tuple[bytes, ...]]:
    """The distinct ``width``-word shingles as words; of fewer words, the whole sequence as one."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; see ``shingles``."""
    words, woff = word_hashes(raw, off)
    full, foff = ngram_hashes(words, woff, width)
    for i in range(len(off) - 1):
        if foff[i + 1] > foff[i]:
            yield np.unique(full[foff[i] : foff[i + 1]])
        elif woff[i + 1] > woff[i]:
            yield chain([words[j : j + 1] for j in range(woff[i], woff[i + 1])])
        else:
            yield np.zeros(0, np.uint64)
