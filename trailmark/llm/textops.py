"""Vectorised text kernels shared by the operators of this subpackage.

A kernel works on the UTF-8 bytes of an Arrow string column, a slice of bounded size at a time,
so its memory follows ``SLICE_BYTES`` and the largest single text, never the partition.
Words are maximal runs of bytes outside a set of ASCII separators; bytes from 0x80 up always
belong to words, so byte runs and character runs are the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # so that the arrays of a slice stay in a core's cache
pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back at once

_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_BYTE = np.random.RandomState(7).randint(1, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: white space of `[^\\x20\\x09-\\x0D]+`
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def give_back() -> None:
    """Freed memory goes back to the system, which a worker that lives on would keep otherwise."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of the column, without nulls, of at most ``most`` bytes or one text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = _offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to
    give_back()


def _offsets(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


@dataclass
class Words:
    data: np.ndarray  # bytes, lowered if asked for
    off: np.ndarray  # of each text in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # row of each word
    ptr: np.ndarray  # of each text's first word, and the end
    hash: np.ndarray  # of each word

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def bytes(self, i: int, n: int) -> bytes:
        """The n words from word i on, joined by a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column from slices()."""
    off = _offsets(column)
    buf = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, (off - off[0]).astype(np.int64)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span of the bytes."""
    h = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(_P, len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(_P, len(h))[1][start] + (end - start).astype(_U))


def words(column: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    data, off = raw(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    own = off[:-1][off[:-1] < off[1:]]
    before[own] = False
    after[off[1:][off[:-1] < off[1:]] - 1] = False
    start = np.flatnonzero(inside[1:-1] & ~before)
    end = np.flatnonzero(inside[1:-1] & ~after) + 1
    ptr = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
    return Words(data, off, start, end, doc, ptr, span_hash(prefix(data), start, end))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; across the ends of texts as well."""
    if len(h) < n:
        return np.zeros(0, _U)
    up, down = powers(_Q, len(h) + 1)
    g = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=g[1:])
    return mix((g[n:] - g[:-n]) * down[: len(h) - n + 1] + _U(n))


def cover(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words the windows of this length at the given starts cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def per_doc(flags: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the words' values by text."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[ptr[1:]] - c[ptr[:-1]]


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, ends exclusive."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))
