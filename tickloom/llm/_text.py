"""Words of a whole Arrow batch at once, by NumPy over its UTF-8 bytes.

A word is a longest run of ASCII letters and digits and of characters from U+00C0 on, but for general punctuation
(U+2000-U+207F) and ideographic punctuation (U+3000-U+303F). Case is folded for ASCII and Latin-1 letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WORD = np.zeros(256, bool)
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)):
    _WORD[_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser; a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row, first byte and end of every word, in order."""
    return hashed(raw, offsets)[:4]


def hashed(raw: np.ndarray, offsets: np.ndarray):
    """As ``words``, and a function that gives the hashes of parts of words by their first bytes and ends."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, lambda a, b: np.zeros(len(a), np.uint64)
    is_word, low = _WORD[raw], _LOWER[raw]
    if (raw >= 0x80).any():
        lead = np.flatnonzero(raw == 0xC2)
        is_word[lead] = False
        is_word[lead[lead + 1 < n] + 1] = False
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        s = raw[second]
        second = second[(s >= 0x80) & (s <= 0x9E) & (s != 0x97)]
        low[second] += 0x20
        for first, a, b in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            at = np.flatnonzero(raw[:-2] == first) if n > 2 else np.zeros(0, np.int64)
            at = at[(raw[at + 1] >= a) & (raw[at + 1] <= b)]
            for k in range(3):
                is_word[at + k] = False
    edge = np.empty(n, bool)
    edge[0] = is_word[0]
    np.greater(is_word[1:], is_word[:-1], out=edge[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] |= is_word[inner]
    start = np.flatnonzero(edge)
    last = np.empty(n, bool)
    last[-1] = is_word[-1]
    np.greater(is_word[:-1], is_word[1:], out=last[:-1])
    before = inner - 1
    last[before] |= is_word[before]
    end = np.flatnonzero(last) + 1
    p, q = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.multiply(_VALUE[low], p[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64))

    row = np.searchsorted(offsets, start, side="right") - 1
    return part(start, end), row, start, end, part


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words within a row; a row of 1 to k-1 words has one, of all its words."""
    n = len(h)
    count = np.bincount(row, minlength=n_rows)
    short = (count > 0) & (count < k)
    out, rows = [], []
    if n >= k:
        inside = row[k - 1 :] == row[: n - k + 1]
        x = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            x = mix(x * U64(0x9FB21C651E98DF25) + h[i : n - k + 1 + i])
        out.append(x[inside])
        rows.append(row[: n - k + 1][inside])
    if short.any():
        first = np.searchsorted(row, np.flatnonzero(short))
        x = np.zeros(len(first), np.uint64)
        size = count[short]
        for i in range(k - 1):
            use = i < size
            x[use] = mix(x[use] * U64(0x9FB21C651E98DF25) + h[first[use] + i])
        out.append(mix(x + U64(1)))
        rows.append(np.flatnonzero(short))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hs, rs = np.concatenate(out), np.concatenate(rows)
    if short.any():
        order = np.argsort(rs, kind="stable")
        hs, rs = hs[order], rs[order]
    return hs, rs


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row where a row is longer; no row is cut."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out
