"""Word hashes, shingle sets and spans straight from Arrow string buffers.

A word is a maximal run of bytes other than space and \\t..\\r; A-Z count as a-z. All of it is numpy over
whole buffers: a Python object is never made for a word. A word's hash depends on its bytes only, so
documents may be cut into pieces of any size, and memory is bounded by PIECE plus the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, PIECE + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the rows, bytes) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def _cut(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """[a, b) in pieces of about PIECE bytes that end where a word ends."""
    while b - a > PIECE:
        e, step = a + PIECE, 4096
        while e < b:
            spaces = np.flatnonzero(_SPACE[data[e : min(b, e + step)]])
            if len(spaces):
                e += int(spaces[0])
                break
            e += step
        if e >= b:
            break
        yield a, e
        a = e
    yield a, b


#: Breaks words at all ASCII that is neither a letter nor a digit, for features rather than for contracts.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _piece(data: np.ndarray, first: np.ndarray, lower: bool, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a piece; first marks bytes where a document begins."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    word = ~breaks[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    end[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def words_of(offsets: np.ndarray, data: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of consecutive rows: (first row, end row, word counts' offsets by row, starts, ends, hashes).

    starts and ends are positions in data. Rows are grouped up to PIECE bytes; a longer row comes alone.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        parts = []
        for x, y in _cut(data, a, b):
            first = np.zeros(y - x + 1, bool)
            own = offsets[i:j]
            first[own[(own >= x) & (own < y)] - x] = True
            s, e, h = _piece(data[x:y], first[:-1], lower, breaks)
            parts.append((s + x, e + x, h))
        s, e, h = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
        yield i, j, np.searchsorted(s, offsets[i : j + 1]), s, e, h
        i = j


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The first k (at most 7) bytes of words as integers, A-Z as a-z; the length k is part of them."""
    out = np.full(len(starts), k << 56, np.uint64)
    for i in range(k):
        at = starts + i
        ok = at < ends
        out |= np.where(ok, _LOWER[data[np.where(ok, at, 0)]], 0).astype(np.uint64) << np.uint64(8 * i)
    return out


_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], dtype=np.uint64)


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all n-word windows in order; a shorter sequence is one window, an empty one none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.full(m, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(n):
        out ^= h[k : k + m] * _ODD[k % len(_ODD)]
        out = (out << np.uint64(13)) | (out >> np.uint64(51))
    return mix(out)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a sorted set of distinct values."""
    with np.errstate(over="ignore"):
        a = int(mix(values + np.uint64(0x51ED270B)).sum(dtype=np.uint64))
        b = int(mix(values ^ np.uint64(0xC3A5C85C97CB3127)).sum(dtype=np.uint64))
    return a, b


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
