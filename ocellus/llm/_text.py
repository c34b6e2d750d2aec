"""Vectorised text kernels shared by the corpus operators.

An Arrow string column is a byte buffer plus offsets. Word boundaries, word
hashes and window hashes are computed on that buffer with numpy, a slice of
documents at a time, so no Python object is made for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; one larger document is handled alone.
SLICE_BYTES = 1 << 21
SLICE_DOCS = 1 << 16
NULL_ID = -(1 << 63)

#: Words are runs of anything but ASCII white space.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of digits, lower-case ASCII letters and all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15 & ~0x7 | 0x3)
#: Two independent bases for window hashes.
WINDOW_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Entries of a table of powers; powers of larger exponents are products of two.
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS


class _Powers:
    """Powers of a base and of its inverse: a table of the first _BLOCK, and one of every _BLOCK-th, which alone grows with what is hashed."""

    def __init__(self, base: np.uint64):
        inverse = U64(pow(int(base), -1, 1 << 64))
        self.up, self.down = self._table(base, _BLOCK), self._table(inverse, _BLOCK)
        self.far_base, self.far_inverse = (self.up[-1:] * base)[0], (self.down[-1:] * inverse)[0]
        self.far_up = self.far_down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _table(base: np.uint64, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def reach(self, n: int) -> None:
        if len(self.far_up) <= n >> _BLOCK_BITS:
            size = 2 * (n >> _BLOCK_BITS) + 2
            self.far_up, self.far_down = self._table(self.far_base, size), self._table(self.far_inverse, size)

    def sums(self, values: np.ndarray, take: np.ndarray | None = None) -> np.ndarray:
        """0 and the sums of the first 1, 2, ... values (or of take[values]) times their powers."""
        total = np.empty(len(values) + 1, dtype=np.uint64)
        total[0] = 0
        self.reach(len(values))
        carry = U64(0)
        for k, at in enumerate(range(0, len(values), _BLOCK)):
            part = values[at : at + _BLOCK]
            sums = total[at + 1 : at + 1 + len(part)]
            np.cumsum((part if take is None else take[part]) * self.up[: len(part)], out=sums)
            sums *= self.far_up[k]
            sums += carry
            carry = sums[-1]
        return total

    def last(self, values: np.ndarray, take: np.ndarray) -> np.uint64:
        """The last of sums(), a block of values at a time."""
        self.reach(len(values))
        total = np.zeros(1, dtype=np.uint64)
        for k, at in enumerate(range(0, len(values), _BLOCK)):
            part = values[at : at + _BLOCK]
            total += (take[part] * self.up[: len(part)]).sum(keepdims=True) * self.far_up[k]
        return total[0]

    def inverses(self, at: np.ndarray) -> np.ndarray:
        """The inverse powers of the exponents at (below what was reached)."""
        return self.down[at & (_BLOCK - 1)] * self.far_down[at >> _BLOCK_BITS]


_POWERS: dict[int, _Powers] = {}


def powers(base: np.uint64) -> _Powers:
    if int(base) not in _POWERS:
        _POWERS[int(base)] = _Powers(base)
    return _POWERS[int(base)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, kind)
    if len(off) == 0:
        off = np.zeros(1, kind)
    off = off.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return a worker's freed memory to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or of one larger document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n, i + SLICE_DOCS)
        yield i, j
        i = j


def spans(b: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each document's words begin among them."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = np.zeros(len(b) + 2, dtype=bool)
    m[1:-1] = is_word[b]
    first, last = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
    cut = off[(off > 0) & (off < len(b))]
    first[cut] = m[cut + 1]
    last[cut - 1] = m[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands. A span of more than a slice is hashed by itself, in blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    p = powers(_BASE)
    long = ends - starts > SLICE_BYTES
    for k in np.flatnonzero(long).tolist():
        out[k] = p.last(b[starts[k] : ends[k]], _BYTE)
    own = slice(None) if not long.any() else np.flatnonzero(~long)
    starts, ends, made = starts[own], ends[own], out[own]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES, side="right")))
        at, to = int(starts[i]), int(ends[i:j].max())
        total = p.sums(b[at:to], _BYTE)
        made[i:j] = (total[ends[i:j] - at] - total[starts[i:j] - at]) * p.inverses(starts[i:j] - at)
        i = j
    out[own] = made
    return mix(out)


def window_hash(h: np.ndarray, width: int, base: np.uint64 = WINDOW_BASES[0]) -> np.ndarray:
    """A 64-bit hash of every width consecutive entries of h (mixed values)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, p = np.empty(n, dtype=np.uint64), powers(base)
    step = 1 << 20
    for i in range(0, n, step):
        j = min(n, i + step)
        total = p.sums(h[i : j + width - 1])
        np.subtract(total[width:], total[:-width], out=out[i:j])
        for at in range(i, j, _BLOCK):
            part = out[at : min(at + _BLOCK, j)]
            part *= p.down[: len(part)]
            part *= p.far_down[at - i >> _BLOCK_BITS]
    return mix(out ^ U64(width))


def sequence_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = WINDOW_BASES[1]) -> np.ndarray:
    """A 64-bit hash of each range of entries of h (mixed values), the same wherever the range stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    p = powers(base)
    total = p.sums(h)
    return mix((total[ends] - total[starts]) * p.inverses(starts) ^ (ends - starts).astype(np.uint64))


def leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For every width consecutive entries the place of the least, the leftmost of equal ones.

    Values are compared by their high 32 bits, so equal windows have their least at one place.
    """
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = U64(32)
    low = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    return (np.minimum(low[:n], low[width - have : width - have + n]) & ((U64(1) << bits) - U64(1))).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the next."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)
