"""Vectorised views of a batch of texts: words, lines, n-grams and their hashes, in NumPy.

A ``Block`` is a run of texts laid end to end as UTF-8 bytes with document offsets. All results are
arrays over the whole block, with per-document sums taken from running totals, so no Python loop
touches a character or a word. Blocks are cut to about a MB, which bounds memory whatever the batch.

64-bit hashes stand for words, lines and windows. They are polynomial in the bytes; two different
strings of one text collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FINAL = np.uint64(0xFF51AFD7ED558CCD)


def _trimmer():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _trimmer()


def give_back() -> None:
    """Return memory that is not in use: a worker lives on from task to task and keeps its high-water mark else."""
    if len(_powers[0]) > 4 * BLOCK_BYTES:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPACE = table_of(b" \t\n\v\f\r")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, base in enumerate((_BASE, np.uint64(inverse))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    h = h ^ (h >> np.uint64(33))
    h = h * _FINAL
    h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


class Block:
    """Texts ``0..n-1`` as ``buf[offs[i]:offs[i + 1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self.size = int(offs[-1])

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of an array over bytes, per document."""
        total = np.zeros(self.size + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs of ``inside`` bytes within documents; first run of each document."""
        first = np.zeros(self.size + 1, bool)
        first[self.offs] = True
        before = np.empty(self.size, bool)
        if self.size:
            before[0], before[1:] = False, inside[:-1]
        begins = inside & (~before | first[:-1])
        after = np.empty(self.size, bool)
        if self.size:
            after[-1], after[:-1] = False, inside[1:]
        ends = inside & (~after | first[1:])
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offs)

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~space[self.buf[: self.size]])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the newline-separated lines that are not empty."""
        return self.spans(self.buf[: self.size] != 10)[:2]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        power, inverse = _power(self.size + 1)
        total = np.zeros(self.size + 1, np.uint64)
        np.cumsum((self.buf[: self.size].astype(np.uint64) + np.uint64(1)) * power[: self.size], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)

    def grams(self, n: int, bits: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the ``n`` bytes (at most 4) from each byte on; first and last-plus-one per document."""
        b = self.buf
        v = b[: self.size].astype(np.uint32)
        for k in range(1, n):
            v |= b[k : self.size + k].astype(np.uint32) << np.uint32(8 * k)
        v = (v + np.uint32(salt)) * np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA77)
        return v >> np.uint32(32 - bits), self.offs[:-1], np.maximum(self.offs[1:] - n + 1, self.offs[:-1])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` hashes from each index on."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _BASE + h[k : k + m]
    return mixed(total)


def owners(first: np.ndarray, count: int) -> np.ndarray:
    """Document of each of ``count`` spans, given the first span of each document and the end."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut an Arrow array of texts into blocks: first row, end row, block. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        a, z = int(offs[lo]), int(offs[hi])
        buf = np.zeros(z - a + 8, np.uint8)
        buf[: z - a] = data[a:z]
        yield lo, hi, Block(buf, offs[lo : hi + 1] - a)
        lo = hi
    give_back()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    upper = (buf >= 65) & (buf <= 90)
    return buf + (upper.astype(np.uint8) << 5)
