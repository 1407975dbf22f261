"""Hashed n-gram counts of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from .textops import LOWER, SPACE, U64, span_hashes, words

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)

#: Letters fold into two shapes, so that only case, digits, white space and signs are told apart.
SHAPES = np.arange(256).astype(np.uint8)
SHAPES[97:123] = 97
SHAPES[128:] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 48


def counts(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, sizes: tuple[int, ...], dim: int) -> np.ndarray:
    """rows x dim counts of the n-grams of folded bytes, for each n of sizes; none crosses a row's end."""
    rows = len(offsets) - 1
    at = offsets - offsets[0]
    x = fold[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros(rows * dim)
    for n in sizes:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ x[i : m + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        whole = row[:m] == row[n - 1 : m + n - 1]
        out += np.bincount((row[:m] * dim + (h % np.uint32(dim)).astype(np.int64))[whole], minlength=rows * dim)
    return out.reshape(rows, dim)


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 3: words, words equal to the one before, words equal to the one two before."""
    low = LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    starts, ends, first = words(low, at, SPACE)
    h = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first)).astype(U64)
    h = h ^ (row * U64(0x9E3779B97F4A7C15))  # equal words of two rows differ
    out = np.zeros((len(at) - 1, 3))
    out[:, 0] = np.diff(first)
    for lag in (1, 2):
        same = np.zeros(len(h) + 1, np.int64)
        np.cumsum(np.concatenate([np.zeros(min(lag, len(h)), bool), h[lag:] == h[:-lag]]), out=same[1:])
        out[:, lag] = np.diff(same[first])
    return out


def word_counts(data: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """rows x dim counts of hashed words (ASCII lower case)."""
    low = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends, first = words(low, offsets - offsets[0], SPACE)
    rows = len(offsets) - 1
    column = (span_hashes(low, starts, ends) % U64(dim)).astype(np.int64)
    return np.bincount(np.repeat(np.arange(rows), np.diff(first)) * dim + column, minlength=rows * dim).reshape(rows, dim).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)
