"""Vectorised text kernels over Arrow string buffers: words, hashes and shingles without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
CHUNK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to n."""
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 2 * CHUNK)
        for key, x in (("p", _BASE), ("q", _INV)):
            a = np.full(m, x, U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
        if m > 16 * CHUNK:  # a rare giant text doesn't stay in memory
            return _POW.pop("p"), _POW.pop("q")
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of symbols[starts:ends] for each span, by prefix sums of a polynomial."""
    p, q = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * p[: len(symbols)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one long row: bounds the temporaries of the kernels."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without gap bytes inside each row: starts, ends, and the first word of each row (n + 1 entries)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~gap[data]
    inner = offsets[1:-1]
    step = np.diff(inside)
    starts, ends = step == 1, step == -1
    if len(inner):  # a row's end cuts a run
        cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1) & (inner > 0) & (inner < len(data))]
        starts[cut] = True
        ends[cut] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(offsets: np.ndarray, data: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row (ASCII lower case, ASCII white space), rows in order, and their first index (n + 1).

    A row with 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    low = LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    starts, ends, first = words(low, at, SPACE)
    h = span_hashes(low, starts, ends)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out_first[1:])
    mult = U64(0xD6E8FEB86659FD93)
    if len(h) >= k:
        acc = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            acc *= mult
            acc += h[i : len(h) - k + 1 + i]
    else:
        acc = np.zeros(0, U64)
    pick = np.repeat(first[:-1] - out_first[:-1], n) + np.arange(out_first[-1])
    short = np.flatnonzero((count > 0) & (count < k))
    acc = np.append(acc, np.zeros(max(0, len(h) - len(acc)), U64))
    out = mix(acc[pick]) if len(pick) else np.zeros(0, U64)
    for r in short:
        v = int(count[r])
        for x in h[first[r] : first[r + 1]].tolist():
            v = (v * 0xA24BAED4963EE407 + x) & 0xFFFFFFFFFFFFFFFF
        out[out_first[r]] = mix(np.array([v], U64))[0]
    return out, out_first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
