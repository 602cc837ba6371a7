"""Byte-level text kernels shared by the operators of this subpackage.

A block of texts is one uint8 buffer plus row offsets (Arrow's own layout). Words, word hashes and
shingle hashes are computed for the whole block with numpy; no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_LANES = 1 << 17
#: The first n bytes of a little-endian lane.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all of a multi-byte character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words(NamedTuple):
    data: np.ndarray  # bytes of the block, lower-cased if asked for
    rows: np.ndarray  # row i's bytes are data[rows[i]:rows[i + 1]]
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # row i's words are first[i]:first[i + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string or binary column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if not len(column) or values is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(rows: np.ndarray, limit: int = _SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(rows) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(column: pa.Array, limit: int = _SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of bounded pieces of a column."""
    data, rows = buffers(column)
    for i, j in slices(rows, limit):
        yield i, j, data[rows[i] : rows[j]], rows[i : j + 1] - rows[i]


def words(data: np.ndarray, rows: np.ndarray, word_bytes: np.ndarray = NON_SPACE, lower: bool = True) -> Words:
    """Maximal runs of word bytes; none crosses a row's end."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = word_bytes[data]
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    begins = inside & (~before | cut[:-1])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = inside & (~after | cut[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, rows, start, end, np.searchsorted(start, rows))


def runs(data: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind (a table of 256 small numbers; 0 is no word at all)."""
    n = len(data)
    k = kind[data]
    new = np.ones(n + 1, bool)
    new[1:n] = k[1:] != k[:-1]
    new[rows] = True
    start = np.flatnonzero(new[:-1])
    end = np.append(start[1:], n)[: len(start)]
    keep = k[start] > 0
    start, end = start[keep], end[keep]
    return Words(data, rows, start, end, np.searchsorted(start, rows))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: each lane of eight bytes is mixed under its number in the span, and the lanes are added.

    No two spans collide by their structure (as they would under a polynomial modulo a power of two); an empty span has a hash too.
    """
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    out = np.zeros(len(start), U)
    if not len(start):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    lanes = (size + 7) >> 3
    upto = np.concatenate(([0], np.cumsum(lanes)))
    for a in range(0, int(upto[-1]), _LANES):
        b = min(a + _LANES, int(upto[-1]))
        i, j = int(np.searchsorted(upto, a, "right")) - 1, int(np.searchsorted(upto, b, "left"))
        of = np.repeat(np.arange(i, j), np.minimum(upto[i + 1 : j + 1], b) - np.maximum(upto[i:j], a))
        k = np.arange(a, b) - upto[of]
        v = at_byte[start[of] + 8 * k]
        v &= _KEEP[np.minimum(size[of] - 8 * k, 8)]
        v = mix(v ^ mix((k + 1).astype(U) * U(_ODD)))
        whole = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[whole]] += np.add.reduceat(v, whole)
    return mix(out + (size.astype(U) << U(48)))


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(w.data, w.start, w.end)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; entry i covers i..i+k-1. Rows are not regarded here."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mix(out + U(k))


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingle hashes; the whole sequence if there are fewer words."""
    h = word_hashes(w)
    g = grams(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(h[:0])
    return out
