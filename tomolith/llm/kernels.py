"""NumPy kernels over raw UTF-8 buffers, shared by the operators of this subpackage.

Every kernel works on one *chunk*: the bytes of a few documents side by side, with
an offset array that says where each begins. Nothing crosses a document's border.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, so that the arrays stay in the CPU's cache (a longer document is a chunk of its own).
CHUNK_BYTES = 256 << 10
#: Bytes of one document handled at once by kernels that can cut it, at some 100 bytes of arrays for each.
PIECE_BYTES = 1 << 20

# The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_NON_WHITE = np.ones(256, bool)
_NON_WHITE[list(WHITE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, (max(n, 1) - 1).bit_length())
    return (_powers(base, size) if size <= 1 << 20 else _powers.__wrapped__(base, size))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Hashes of any slices of ``values`` from one prefix sum, modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.prefix[1:])
        self.back = powers(inverse(base), n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(_STEP))

    def windows(self, size: int) -> np.ndarray:
        """Of every slice of ``size`` values; empty if there are fewer."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = self.prefix[size:] - self.prefix[:n]
        x *= self.back[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


@dataclass
class Chunk:
    """Documents ``first`` .. ``first + len(off) - 2`` of a batch; ``off`` is relative to ``data``."""

    first: int
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The whole column in order, about ``size`` bytes at a time."""
    data, off = text_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Word borders in a chunk, and for each document its range of words ``at[d]:at[d+1]``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def words(c: Chunk, letters: np.ndarray = _NON_WHITE) -> Words:
    """Maximal runs of the bytes that the table ``letters`` marks."""
    n = len(c.data)
    inside = letters[c.data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[c.off[:-1]] = False  # a document's first byte has nothing before it
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[c.off[1:]] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    at = np.searchsorted(start, c.off)
    return Words(start, end, np.repeat(np.arange(len(c)), np.diff(at)), at)


def cut_bytes(c: Chunk, overlap: int, piece: int = PIECE_BYTES) -> Iterator[tuple[Chunk, int]]:
    """A chunk, or the pieces of a long document; each piece goes on for ``overlap`` bytes into the next. With the bytes before it."""
    n = len(c.data)
    if len(c) != 1 or n <= piece:
        yield c, 0
        return
    for a in range(0, max(1, n - overlap), piece):
        data = c.data[a : a + piece + overlap]
        yield Chunk(c.first, data, np.array([0, len(data)])), a


def cut_words(c: Chunk, overlap: int, piece: int = PIECE_BYTES) -> Iterator[tuple[Chunk, int]]:
    """As ``cut_bytes``, cut between words: ``overlap`` words, and the words before."""
    n = len(c.data)
    if len(c) != 1 or n <= piece:
        yield c, 0
        return
    a = before = 0
    while a < n:
        end = _gap(c.data, a + piece)
        more, size = end, 64 * overlap + 64
        while more < n:  # far enough for the overlap
            more = _gap(c.data, end + size)
            if len(words(Chunk(0, c.data[end:more], np.array([0, more - end]))).start) > overlap:
                break
            size *= 2
        w = words(Chunk(0, c.data[end:more], np.array([0, more - end])))
        stop = end + int(w.end[overlap - 1]) if len(w.end) > overlap > 0 else (more if overlap else end)
        data = c.data[a:stop]
        yield Chunk(c.first, data, np.array([0, len(data)])), before
        if more >= n and len(w.start) <= overlap:
            return  # what is left are fewer words than a window needs, and they are in this piece
        before += len(words(Chunk(0, c.data[a:end], np.array([0, end - a]))).start)
        a = end


def _gap(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is white space, or the end."""
    n, step = len(data), 1 << 12
    while at < n:
        found = np.flatnonzero(~_NON_WHITE[data[at : at + step]])
        if len(found):
            return at + int(found[0])
        at += step
    return n


def word_hashes(c: Chunk, w: Words, lower: bool = False) -> np.ndarray:
    data = _LOWER[c.data] if lower else c.data
    return Rolling(data).slices(w.start, w.end)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the least (leftmost if tied) of every ``width`` consecutive keys."""
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = key & np.uint64(0xFFFFFFFF00000000)
    best |= np.arange(len(key), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:n], best[width - span : width - span + n])
    best = best[:n]
    best &= np.uint64(0xFFFFFFFF)
    return best.view(np.int64)


def slices_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], .. start[0]+length[0]-1, start[1], .. one slice after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(total)
