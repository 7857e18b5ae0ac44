"""Vectorised UTF-8 word tools shared by the operators of this subpackage.

Everything works on the raw bytes of an Arrow string column: no Python string
is built for a word.  A word is a maximal run of bytes other than space and
tab to carriage return (``[^\\x20\\x09-\\x0D]+``), and never crosses a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_TABLE = _splitmix(256, 7)
_M = U64(0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 12, 2 * len(have) if have is not None else 0), U64(base))
            have[0] = 1
            have = np.cumprod(have, dtype=U64)
        _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of some rows: byte range of each, and each row's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # row i has words first[i] .. first[i+1]-1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if len(col) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def split(data: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None) -> Words:
    """Words of each row; ``between`` marks other byte values that are not in a word."""
    n = len(data)
    space = (_SPACE if between is None else between)[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        before |= cut[:-1]
        after |= cut[1:]
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - at, lengths)


def hashes(w: Words, lower: bool = False, length: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``length`` bytes."""
    if not len(w.starts):
        return np.zeros(0, U64)
    size = w.ends - w.starts if length is None else length
    at = np.cumsum(size) - size
    own = np.arange(int(size.sum())) - np.repeat(at, size)
    raw = w.data[own + np.repeat(w.starts, size)]
    if lower:
        raw = _LOWER[raw]
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_TABLE[raw] * powers(int(_M), int(size.max()) + 1)[own], at) + size.astype(U64))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over offsets[i] .. offsets[i+1]-1."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_per_row(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct hashes of each row."""
    if not len(h):
        return np.zeros(len(first) - 1, np.int64)
    row = np.repeat(np.arange(len(first) - 1, dtype=U64), np.diff(first))
    key = np.sort((row << U64(40)) | (h & U64((1 << 40) - 1)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=len(first) - 1)


def hash_text(word: str) -> int:
    """The hash that :func:`hashes` gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(Words(raw, np.array([0]), np.array([len(raw)]), np.array([0, 1])))[0])


_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def windows(h: np.ndarray, k: int, two: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes (one or two) of every run of k word hashes; run i starts at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, U64) if two else None
    out = []
    with np.errstate(over="ignore"):
        for base in (_P, _Q)[: 1 + two]:
            c = np.zeros(len(h) + 1, U64)
            np.cumsum(h * powers(base, len(h)), out=c[1:])
            out.append(mix((c[k:] - c[:-k]) * powers(pow(base, -1, 1 << 64), n)))
    return out[0], out[1] if two else None


def sliding(x: np.ndarray, k: int, f) -> np.ndarray:
    """f (minimum or maximum) over every run of k values, by doubling."""
    if len(x) < k:
        return x[:0]
    w = 1
    while 2 * w <= k:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (k - w)], x[k - w :]) if k > w else x
