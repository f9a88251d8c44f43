"""Arrays packed into one compressed binary value, to travel as a row."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Blocks are written once and moved several times.
LEVEL = 6


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block."""
    raw = [np.array([len(arrays), *[x for a in arrays for x in (a.dtype.itemsize * 2 + (a.dtype.kind == "f"), len(a))]], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]
    data = b"".join(raw)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    data = pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    k = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * k)[1:]
    at, out = 8 * (1 + 2 * k), []
    for code, n in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        dtype = np.dtype(f"{'f' if code % 2 else 'u'}{code // 2}")
        out.append(np.frombuffer(data, dtype, n, at))
        at += dtype.itemsize * n
    return out


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Free memory that Arrow and the C library keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
