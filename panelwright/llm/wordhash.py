"""Words of whole Arrow text columns as numpy arrays of 64-bit hashes, without one Python string per word.

A word is a run of bytes other than blank and 0x09-0x0D, or than those of a table given (ASCII bytes occur only as themselves in UTF-8).
A hash of a word, or of consecutive words, is a polynomial over random 64-bit values, taken from running
sums, and mixed at the end; sums wrap around at 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled on its own), so that the arrays stay in the CPU's caches.
CHUNK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters, digits and all beyond ASCII: every other ASCII byte separates.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_FOLDED = _SAME.copy()
_FOLDED[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK + 64)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[base]


def _running(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], dtype=np.uint64, out=total[1:])
    return total


class Words:
    """The words of some texts: ``hash``, byte bounds ``start``/``end`` in ``data``, and ``first[i]:first[i+1]`` of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, blank: np.ndarray = _BLANK):
        self.data, self.offsets = data, offsets
        solid = ~blank[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(data)]] = False
        after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = _running(_VALUES[(_FOLDED if fold else _SAME)[data]], _BASES[0])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_BASES[0], len(data) + 1)[1][self.start])
        self._sums: dict[int, np.ndarray] = {}

    def runs(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the word sequences start:end (word numbers); ``which`` chooses one of two independent hashes."""
        if which not in self._sums:
            self._sums[which] = _running(self.hash if which == 0 else mix(self.hash + np.uint64(which)), _BASES[which])
        sums = self._sums[which]
        return mix((sums[end] - sums[start]) * powers(_BASES[which], len(self.hash) + 1)[1][start] + np.uint64(which))

    def grams(self, i: int, k: int, which: int = 0) -> np.ndarray:
        """Hashes of all k consecutive words of text i; the whole sequence if it is shorter; empty without words."""
        lo, hi = self.first[i], self.first[i + 1]
        if hi == lo:
            return np.zeros(0, np.uint64)
        at = np.arange(lo, max(hi - k, lo) + 1)
        return self.runs(at, np.minimum(at + k, hi), which)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunked(column: pa.Array, fold: bool = False, size: int = CHUNK, blank: np.ndarray = _BLANK) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for neighbouring texts of about ``size`` bytes together; ``blank`` marks the bytes between words."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1, lo + 1)
        yield lo, Words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], fold, blank)
        lo = hi


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
