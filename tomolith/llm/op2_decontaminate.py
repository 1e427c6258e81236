"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item are compared by 63-bit hashes. A shared run of
``MIN_MATCH`` words is a seed, found in a sorted array of all seeds behind a bitmap; items whose
seeds could cover the threshold are tiled, over the words that their seeds cover in the document: running Karp-Rabin marks the longest common unmarked stretches
first, then shorter ones, never overlapping, so passages in another order are found too.
A pair is reported when the tiles cover at least ``THRESHOLD`` of the item's words.

The benchmark goes to the workers in blocks of bounded size (hashed by item, so their
number follows the benchmark and the memory does not), and each worker indexes a block once;
documents are never shuffled, and read once for each block.

Words are maximal runs of letters and digits, case folded. Items of fewer than MIN_MATCH
words cannot be told from chance and match nothing. Null texts have no words. Texts of any
length are tiled whole. Of equally long stretches the first in the item, then in the text, is
marked. Repeated rows give repeated results; null ids are carried. Empty tables give an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from . import kernels as K

MIN_MATCH = 5
THRESHOLD = 0.6
#: Characters of benchmark text that one block may hold on average; each block takes a scan of the documents.
BLOCK_CHARS = 64_000_000
#: What is no word beyond ASCII; in ASCII the table of bytes tells.
_FOREIGN = re.compile(r"[^\w\x00-\x7f]+")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the words before each text."""
    parts = []
    for text in texts:
        low = (text or "").casefold()
        parts.append((low if low.isascii() else _FOREIGN.sub(" ", low)).encode("utf-8", "surrogatepass"))
    off = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
    c = K.Chunk(0, np.frombuffer(b"".join(parts), np.uint8), off)
    w = K.words(c, _LETTERS)
    return (K.word_hashes(c, w) >> np.uint64(1)).view(np.int64), w.at


def seeds_of(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of MIN_MATCH words inside a text: hash, text and place in the text."""
    start = np.flatnonzero(np.repeat(at[1:], np.diff(at)) - np.arange(len(ids)) >= MIN_MATCH)
    text = np.searchsorted(at, start, "right") - 1
    return K.Rolling(ids).windows(MIN_MATCH)[start] if len(start) else np.zeros(0, np.uint64), text, start - at[text]


def _spread(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Positions below n covered by windows of ``size`` that start at ``at``."""
    step = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + size, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def _matches(p: np.ndarray, t: np.ndarray, p_free: np.ndarray, t_free: np.ndarray, size: int, hash_t: K.Rolling, hash_p: K.Rolling) -> list[tuple[int, int, int]]:
    """Maximal common stretches (length, place in p, place in t) of free words, of ``size`` or more."""

    def starts(free: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(free))
        return np.flatnonzero(total[size:] - total[:-size] == size) if len(free) >= size else np.zeros(0, np.int64)

    ps, ts = starts(p_free), starts(t_free)
    if not len(ps) or not len(ts):
        return []
    hp, ht = hash_p.windows(size)[ps], hash_t.windows(size)[ts]
    order = np.argsort(hp, kind="stable")
    lo, hi = np.searchsorted(hp[order], ht, "left"), np.searchsorted(hp[order], ht, "right")
    hit = np.flatnonzero(hi > lo)
    found, reached = [], {}
    for k in hit:
        b = int(ts[k])
        for a in ps[order[lo[k] : hi[k]]]:
            a = int(a)
            if reached.get(a - b, -1) > b:  # inside a stretch already found on this diagonal
                continue
            n = 0
            most = min(len(p) - a, len(t) - b)
            while n < most and p[a + n] == t[b + n] and p_free[a + n] and t_free[b + n]:
                n += 1
            if n >= size:
                reached[a - b] = b + n - size + 1
                found.append((n, a, b))
    return found


def tiles(p: np.ndarray, t: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two strings of non-negative ids (ids below 0 match nothing): always the longest common stretch of
    unmarked words becomes a tile, of equally long ones the first in p, then in t, until none of ``min_match`` is left.

    Matches of ``size`` or more are taken in that order; of one that a tile has cut the free rests stay in line.
    """
    p_free, t_free = p >= 0, t >= 0
    hash_p, hash_t = K.Rolling(p), K.Rolling(t)
    size, out = max(min_match, min(20, len(p), len(t))), []
    while True:
        found = _matches(p, t, p_free, t_free, size, hash_t, hash_p)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        line = [(-n, a, b) for n, a, b in found]
        heapify(line)
        while line:
            n, a, b = heappop(line)
            free = p_free[a : a - n] & t_free[b : b - n]
            if free.all():
                p_free[a : a - n] = False
                t_free[b : b - n] = False
                out.append((a, b, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for i, j in edge.reshape(-1, 2).tolist():
                if j - i >= size:
                    heappush(line, (i - j, a + i, b + i))
        if size <= min_match:
            return out
        size = max(min_match, size // 2)


class Index:
    """Seeds of the items of one block, sorted, with a bitmap in front of them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.names = [id_ for id_, _ in items]
        self.ids, self.at = words_of(t for _, t in items)
        seed, owner, place = seeds_of(self.ids, self.at)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        self.bits = np.zeros(1 << max(10, (8 * len(seed)).bit_length() - 3), np.uint8)
        b = (seed & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)
        np.bitwise_or.at(self.bits, b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))

    def search_all(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, tuple]]:
        """(number of the text, match) for each pair at or above the threshold."""
        ids, at = words_of(texts)
        seed, text, place = seeds_of(ids, at)
        hit = np.flatnonzero(A.in_bitmap(self.bits, seed))
        seed, text, place = seed[hit], text[hit], place[hit]
        real = np.searchsorted(self.seed, seed, "right") > np.searchsorted(self.seed, seed, "left")
        seed, text, place = seed[real], text[real], place[real]
        for mine in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
            if len(mine):
                d = int(text[mine[0]])
                for match in self._search(ids[at[d] : at[d + 1]], seed[mine], place[mine], threshold):
                    yield d, match

    def search(self, text: str | None, threshold: float) -> list[tuple]:
        return [match for _, match in self.search_all([text], threshold)]

    def _search(self, t: np.ndarray, seed: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple]:
        hashes = np.unique(seed)
        lo, hi = np.searchsorted(self.seed, hashes, "left"), np.searchsorted(self.seed, hashes, "right")
        rows = K.slices_of(lo, hi - lo)
        rows = rows[np.argsort(self.owner[rows], kind="stable")]
        owner = self.owner[rows]
        for group in np.split(rows, np.flatnonzero(np.diff(owner)) + 1):
            item = self.owner[group[0]]
            p = self.ids[self.at[item] : self.at[item + 1]]
            if _spread(len(p), self.place[group], MIN_MATCH).sum() < threshold * len(p):
                continue  # even if all seeds were tiles
            shared = _spread(len(t), at[np.isin(seed, self.seed[group])], MIN_MATCH)
            first, last = np.flatnonzero(shared)[[0, -1]]  # every tile consists of seeds
            got = tiles(p, np.where(shared, t, -1)[first : last + 1])
            covered = sum(n for _, _, n in got)
            if covered >= threshold * len(p):
                yield self.names[item], len(p), covered, len(got)


_LAST: list[tuple[str, Index]] = []


def _index(name: str, shared) -> Index:  # noqa: ANN001
    """The index of a broadcast block, built once per worker process; only the latest is held."""
    if not _LAST or _LAST[0][0] != name:
        _LAST[:] = [(name, Index(shared.value))]
    return _LAST[0][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_words, n_covered, n_tiles, th) at or above the threshold; th is xxhash64 of the document's text."""
    spark = docs.sparkSession
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"))
    items = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[item_text_col].alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1

    def searcher(shared):  # noqa: ANN001, ANN202
        name = uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for batch in batches:
                out = []
                for c in K.chunks(batch.column(1)):
                    texts = batch.column(1).slice(c.first, len(c)).to_pylist()
                    out += [(batch.column(0)[c.first + d].as_py(), *x, batch.column(2)[c.first + d].as_py()) for d, x in index.search_all(texts, threshold)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "th"])

        return work

    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(sorted((tuple(r) for r in block.toLocalIterator()), key=str))
        parts.append(read.mapInArrow(searcher(shared), "doc_id long, item_id long, n_words long, n_covered long, n_tiles int, th long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("th")
