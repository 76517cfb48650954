"""Vectorised helpers on UTF-8 bytes: Arrow strings as one byte buffer, rolling hashes and word bounds.

Blocks are bounded in bytes, so that a task's memory follows the block and not the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm import tasks

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = tasks.caches.setdefault("powers", {})


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    t = _powers.get(name)
    if t is None or len(t) < n:
        size = max(n, BLOCK + 4096)
        t = np.empty(size, U)
        t[0] = 1
        k, b = 1, U(base)
        with np.errstate(over="ignore"):
            while k < size:
                m = min(k, size - k)
                t[k : k + m] = t[:m] * (t[k - 1] * b)
                k += m
        _powers[name] = t
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x in place."""
    with np.errstate(over="ignore"):
        x ^= x >> U(33)
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(29)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(32)
    return x


class Rolling:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, buf: np.ndarray, base: int = int(BASE)):
        n = len(buf)
        self.down = _power_table(f"down{base}", pow(base, -1, 1 << 64), n + 1)
        self.pre = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(U) + U(1)) * _power_table(f"up{base}", base, n + 1)[:n], out=self.pre[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.pre[end] - self.pre[start]) * self.down[start]

    def fixed(self, k: int) -> np.ndarray:
        """Of every k bytes."""
        n = len(self.pre) - k
        with np.errstate(over="ignore"):
            return (self.pre[k:] - self.pre[:n]) * self.down[:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]] if len(off) else buf[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of rows that together hold about ``limit`` bytes."""
    buf, off = strings(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_bounds(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not ``space``; runs end with their row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~space[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = off[:-1][np.diff(off) > 0]
    ends = off[1:][np.diff(off) > 0] - 1
    first[full] = ink[full]
    last[ends] = ink[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)
