"""Vectorised word and window hashing over the UTF-8 buffers of Arrow string columns.

A batch is cut into chunks of whole texts (at most about CHUNK_BYTES each, one very
long text being a chunk of its own), so memory follows the chunk and not the batch.
All hashes are 64-bit: random per-byte values are combined by a polynomial modulo
2**64 taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_QI = pow(_Q, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the common chunk size."""
    have = _tables.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, CHUNK_BYTES + 1)
    out = np.empty(size, np.uint64)
    out[0] = 1
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    if size <= 4 * CHUNK_BYTES:
        _tables[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


class Words:
    """Words of a chunk: byte starts and ends, and per text the range of its words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data, self.offs = data, offs
        ok = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            np.logical_not(ok[:-1], out=before[1:])
            before |= edge[:-1]
        self.starts = np.flatnonzero(ok & before)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = True
            np.logical_not(ok[1:], out=after[:-1])
            after |= edge[1:]
        self.ends = np.flatnonzero(ok & after) + 1
        #: words of text i are first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.starts, offs)
        self._lower = lower

    def hashes(self) -> np.ndarray:
        data = _LOWER[self.data] if self._lower else self.data
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_B, len(data)), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _powers(_BI, len(data))[self.starts] + (self.ends - self.starts).astype(np.uint64))


class Windows:
    """Hashes of runs of words, any length at any place, from one prefix sum."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(_Q, len(words)), out=self.total[1:])
        self.inverse = _powers(_QI, max(1, len(words)))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        n = len(self.total) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.total[k:] - self.total[: n]) * self.inverse[:n] + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i by doubling; as long as x, cut windows at the end."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out
