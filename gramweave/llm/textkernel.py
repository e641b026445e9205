"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

Everything works on byte arrays of about a megabyte (one document at least), so memory stays bounded whatever the size of an
Arrow batch, and no Python string is made.  A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and
then mixed; any byte range of a word (prefixes, suffixes) costs one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def space_table() -> np.ndarray:
    """True for bytes of words separated by ASCII white space (0x09-0x0D and 0x20)."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for digits, letters and every byte of a non-ASCII character."""
    t = np.ones(256, bool)
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        t[lo : hi + 1] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[:] = out
    return _powers[0][:n], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and the n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Words:
    """Words of documents ``lo`` to ``hi`` of a column: byte ranges in ``buf``, and ``first[d]`` the first word of document d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lo: int):
        self.lo, self.docs, self.buf, self.offsets = lo, len(offsets) - 1, buf, offsets
        n = len(buf)
        w = is_word[buf]
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        after[inner - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of byte ranges; equal bytes hash alike wherever they stand."""
        powers, inverse = _power(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers[: len(self.buf)], out=self._sums[1:])
        return (self._sums[end] - self._sums[start]) * inverse[start]

    def hashes(self) -> np.ndarray:
        return mix(self.range_hash(self.start, self.end))


def words(column: pa.Array, is_word: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """The column's words, in pieces of whole documents."""
    data, offsets = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
        buf = data[offsets[lo] : offsets[hi]]
        yield Words(LOWER[buf] if lower else buf, offsets[lo : hi + 1] - offsets[lo], is_word, lo)
        lo = hi


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one document, or of its whole sequence if it has fewer (none: no hash)."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    total, factor = np.zeros(n - k + 1, np.uint64), np.uint64(_BASE)
    for j in range(k):
        total = total * factor + hashes[j : n - k + 1 + j]
    return mix(total + np.uint64(k))
