"""White-space words of a whole Arrow batch: their places in the bytes, and exact numbers for equal words.

A word is a longest run of characters other than the blank and U+0009 to U+000D, which are single bytes in UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm import _text

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Tokens:
    """Words of the rows of a string column; null counts as empty.

    ``raw`` and ``offsets`` are the bytes and where rows begin; ``start``, ``end`` and ``row`` are those of each word; words of
    row r are ``first[r]`` to ``first[r + 1]``.
    """

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = _text.utf8(column)
        raw, n = self.raw, len(self.raw)
        self.inside = ~SPACE[raw]
        edge = np.zeros(n + 1, np.int8)
        if n:
            edge[0] = edge[n] = 1
            cuts = np.zeros(n + 1, bool)
            cuts[self.offsets] = True
            begins = self.inside & np.r_[True, ~self.inside[:-1] | cuts[1:n]]
            ends = self.inside & np.r_[~self.inside[1:] | cuts[1:n], True]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words only, and the different words."""
        packed = self.raw[self.inside]
        cuts = np.r_[0, np.cumsum(self.end - self.start)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])
        code = words.dictionary_encode()
        return code.indices.to_numpy(), code.dictionary

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes of each word (2 x words), the same in every batch."""
        import xxhash

        index, words = self.coded()
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words.to_pylist()]), U64).reshape(-1, 2)
        return np.ascontiguousarray(both[index].T) if len(both) else np.zeros((2, 0), U64)

    def kept(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The kept words, one blank after each, and where each row's part begins."""
        size = np.where(keep, self.end - self.start + 1, 0)
        mark = np.zeros(len(self.raw) + 1, np.int8)
        mark[self.start[keep]] += 1
        mark[self.end[keep]] -= 1
        inside = np.cumsum(mark[:-1]).astype(bool)
        total = np.cumsum(size)
        out = np.full(int(total[-1]) if len(total) else 0, 0x20, np.uint8)
        hole = np.zeros(len(out), bool)
        hole[total[keep] - 1] = True
        out[~hole] = self.raw[inside]
        return out.tobytes(), np.r_[0, total][self.first]


def digests(data: bytes, cuts: np.ndarray) -> list[str]:
    """SHA-256 of each row's words, joined by one blank."""
    import hashlib

    view, at = memoryview(data), cuts.tolist()
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def prefix_hash(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash of 64-bit values, and the powers of its base (both one longer than the values)."""
    n = len(values)
    power = np.full(n + 1, base, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n + 1, pow(base, -1, 2**64), U64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * power[:n], out=total[1:])
    return total, inverse


def stretch_hash(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the values from a to b, wherever they stand."""
    return (total[b] - total[a]) * inverse[a]
