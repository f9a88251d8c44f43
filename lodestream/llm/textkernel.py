"""Vectorised text kernels over Arrow string columns: words, word hashes, lines.

All hashes are 64-bit: each eight bytes are mixed non-linearly with their place, and the
sum is mixed again, so that no family of texts collides by its algebra.  Work goes in blocks of whole documents near `block_bytes`, so memory
follows the block (or the longest single text), never the partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORDS = ~SPACE
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, block_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of whole texts, near block_bytes each, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_blocks(arr: pa.Array, block_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = column(arr)
    for i, j in blocks(off, block_bytes):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which inside[byte] holds, never across texts: starts, ends, text index."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    on = inside[buf]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    full = off[:-1] < off[1:]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a], last[b] = on[a], on[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span, A-Z lower-cased or as they are; spans may overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = LOWER[buf] if lower else buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    k = np.maximum((n + 7) >> 3, 1)
    at = np.cumsum(k) - k
    rel = np.arange(int(k.sum())) - np.repeat(at, k)
    left = np.minimum(np.repeat(n, k) - 8 * rel, 8)
    salt = mix(np.arange(1, int(k.max()) + 1, dtype=np.uint64) * _BASE)
    x = mix((eight[np.repeat(starts, k) + 8 * rel] & _MASK[left]) ^ salt[rel])
    return mix(np.add.reduceat(x, at) + n.astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased word hashes in text order, and each word's text index."""
    s, e, d = spans(buf, off, inside)
    return span_hash(buf, s, e), d


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    x = h[:n].copy()
    for j in range(1, k):
        x = mix(x * _BASE + h[j : n + j])
    return x, doc[:n] == doc[k - 1 :]


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)
