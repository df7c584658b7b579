"""Numpy kernels over many texts at once: word spans and rolling hashes of a block of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LONG = 64  # bytes of a long span
BASE = 0x9E3779B97F4A7C15 | 1
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most limit bytes together (a longer text is a run of its own)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spaced(buf: np.ndarray, off: np.ndarray, i: int, j: int, fill: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Texts i to j with one fill byte after each; and where each begins (with the end as last)."""
    rel = off[i : j + 1] - off[i]
    out = np.full(int(rel[-1]) + (j - i), fill, dtype=np.uint8)
    at = np.arange(rel[-1]) + np.repeat(np.arange(j - i), np.diff(rel))
    out[at] = buf[off[i] : off[j]]
    return out, rel + np.arange(j - i + 1)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of each at least."""
    have = max(_POW, default=0)
    if have < n:
        size = max(n, (1 << 20) + (1 << 16))
        inverse = pow(BASE, -1, 1 << 64)
        p, q = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        p[0] = q[0] = 1
        _POW.clear()
        _POW[size] = (np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64))
    return next(iter(_POW.values()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: H[k] covers b[:k]."""
    p, _ = powers(len(b) + 1)
    h = np.empty(len(b) + 1, np.uint64)
    h[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=h[1:])
    return h


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span b[start:end]; equal bytes, equal hash.

    Up to 64 bytes by prefix sums; longer ones by XXH3, as regular strings of a thousand bytes can share a polynomial modulo 2^64.
    """
    h, (_, q) = prefix_sums(b), powers(len(b) + 1)
    out = mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(b[start[k] : end[k]].tobytes())
    return out


def same_spans(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, n: np.ndarray, spare: bool = False) -> np.ndarray:
    """Whether a[i : i + n] and b[j : j + n] are the same bytes, for each of many spans; eight bytes at a time, long ones whole.

    spare: b has eight bytes more than the spans reach, so it isn't copied.
    """
    same = np.ones(len(n), bool)
    for k in np.flatnonzero(n > LONG).tolist():
        same[k] = np.array_equal(a[i[k] : i[k] + n[k]], b[j[k] : j[k] + n[k]])
    a8, b8 = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (np.append(a, np.zeros(8, np.uint8)), b if spare else np.append(b, np.zeros(8, np.uint8))))
    rows, t = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(rows):
        keep = np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(8, n[rows] - t))).astype(np.uint64)
        same[rows[((a8[i[rows] + t] ^ b8[j[rows] + t]) & keep) != 0]] = False
        t += 8
        rows = rows[n[rows] > t]
    return same


def word_spans(b: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes."""
    inside = np.empty(len(b) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~is_space[b]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
