"""Whole Arrow columns of text as flat arrays: words, their hashes, and batches of bounded size.

Texts of a batch are looked at as one run of UTF-8 bytes, so that finding and hashing words costs
a few array passes and no Python object per word. Word classes are ASCII classes plus, where
wanted, every byte from 0x80 on, which is the same as a class over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """256 flags: the bytes in the given inclusive ranges, or all others."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if invert else table


ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NONBLANK = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + most, "right")) - 1
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is not None and len(known) >= n:
        return known
    out = np.ones(1, _U)
    while len(out) < n:  # double: P^(i + m) = P^i * P^m
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    if n <= 2 * BATCH_BYTES:  # tables for one huge text are not kept
        _POWERS[base] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What ``span_hashes`` reads its sums from."""
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, n)[:n], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand. ``total``
    are the prefix sums of the data, where several sets of spans share them."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, _U)
    total = prefix_sums(data) if total is None else total
    own = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix(own ^ ((ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F)))


class Words:
    """The words of a string column: byte spans, hashes and the word range of each row."""

    def __init__(self, column: pa.Array, kind: np.ndarray, fold: bool = True):
        raw, self.at = flat(column)
        self.raw = raw
        self.data = LOWER[raw] if fold else raw
        inside = kind[raw]
        heads = self.at[:-1][self.at[:-1] < len(raw)]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        last = np.zeros(len(raw), bool)
        last[:-1] = inside[1:]
        last[heads[heads > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~last) + 1
        self.first = np.searchsorted(self.starts, self.at)  # row i holds words first[i]:first[i + 1]
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; of the whole sequence, if it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, _U)
    for i in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + words[i : n - k + 1 + i])
    return out
