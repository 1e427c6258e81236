"""Routing of repeated windows: which windows of a fixed size can occur twice, and where they meet.

A window (20 words, 200 bytes) is known by its *anchor*: the least of the hashed grams
inside it. Equal windows have equal anchors, so

1. ``routes`` counts the anchors and packs those that occur twice or more into a bitmap
   (sized by their number up to a bound; a false bit costs work, never a result);
2. ``contexts`` emits, for each occurrence of such an anchor, the stretch of text that
   holds all windows with this anchor, and keeps one of equal stretches per chunk with
   their number (so that a text with a million copies is not sent a million times);
3. ``solve`` deals the stretches out by anchor, gathers blocks of whole anchor groups
   and hands them to the operator's solver, which flags windows;
4. ``apply`` joins the flags back to the documents and rewrites their texts.

A group whose stretches would not fit a block (one passage amid many different texts) is
split by the longest prefix there is: the windows of such a *hot* anchor are dealt out one by
one, each by a hash of all its symbols, equal ones merged on the way. Their groups are the
classes of equal windows, of one row for each sender, and need no solver.

Only windows that *differ* from the default (a candidate window is a repeat) travel back,
so the traffic follows the distinct text, not the number of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import saved

#: log2 of the bits in a bitmap: eight for each key, at least 2**17 and at most 2**27 (16 MB) whatever the input.
BITMAP_LOG2 = (17, 27)
#: Bytes of stretches that a solver gets at once (more only if one anchor has more).
BLOCK_BYTES = 1 << 20
#: Bytes of text within which equal stretches are merged before the shuffle.
MERGE_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    """``size`` symbols make a window, ``gram`` an anchor; symbols are words or bytes."""

    size: int
    gram: int
    by_word: bool
    chunk: int = field(default_factory=lambda: K.CHUNK_BYTES)
    piece: int = field(default_factory=lambda: K.PIECE_BYTES)

    def chunks(self, col: pa.Array) -> Iterator[K.Chunk]:
        return K.chunks(col, self.chunk)

    def pieces(self, c: K.Chunk) -> Iterator[tuple[K.Chunk, int]]:
        """The chunk, or a long document in pieces that hold all windows; with the symbols before each."""
        return (K.cut_words if self.by_word else K.cut_bytes)(c, self.size - 1, self.piece)

    @property
    def symbol_bytes(self) -> int:
        return 4 if self.by_word else 1

    @property
    def stretch_bytes(self) -> int:
        """The most that all windows with one anchor occurrence take."""
        return (2 * self.size - self.gram) * self.symbol_bytes


@dataclass
class Runs:
    """Runs of windows with a common anchor occurrence, of one chunk."""

    chunk: K.Chunk
    at: np.ndarray  # symbols before each document
    words: K.Words | None
    symbols: np.ndarray
    rolling: K.Rolling
    start: np.ndarray  # first window of each run, counted in the chunk
    count: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    anchor: np.ndarray  # symbols from the first window's start to the anchor

    def keep(self, mask: np.ndarray) -> Runs:
        return Runs(self.chunk, self.at, self.words, self.symbols, self.rolling, *(x[mask] for x in (self.start, self.count, self.doc, self.key, self.anchor)))


def runs(spec: Windows, c: K.Chunk) -> Runs:
    if spec.by_word:
        w = K.words(c)
        at, hashes = w.at, K.word_hashes(c, w)
        rolling = K.Rolling(hashes)
        symbols = (hashes >> np.uint64(32)).astype(np.uint32)
    else:
        w, at, symbols = None, c.off, c.data
        rolling = K.Rolling(symbols)
    n = len(symbols)
    grams = rolling.windows(spec.gram)
    where = K.sliding_min(grams, spec.size - spec.gram + 1)
    number = np.maximum(np.diff(at) - spec.size + 1, 0)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at[:-1], (number > 0).astype(np.int32))
    np.add.at(step, at[:-1] + number, -(number > 0).astype(np.int32))
    valid = np.flatnonzero(np.cumsum(step[: len(where)]))
    anchor = where[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) != 1) | (np.diff(anchor) != 0)
    head = np.flatnonzero(new)
    start = valid[head]
    count = np.diff(np.append(head, len(valid)))
    doc = np.searchsorted(at, start, "right") - 1
    return Runs(c, at, w, symbols, rolling, start, count, doc, grams[anchor[head]], anchor[head] - start)


def in_bitmap(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    b = (key & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns used, under names of our own, with a hash that tells rows of one id apart."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_th"))


def bitmap_of(keys: DataFrame, count: int) -> bytes:
    """A bitmap of a column ``key`` of so many longs."""
    log2 = min(max((8 * count).bit_length(), BITMAP_LOG2[0]), BITMAP_LOG2[1])
    bucket = F.col("key").bitwiseAND(F.lit((1 << log2) - 1))
    rows = (
        keys.select(F.shiftright(bucket, 15).alias("part"), bucket.bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros((1 << log2) // 8, np.uint8)
    for part, bits in rows.toLocalIterator():
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


@dataclass(frozen=True)
class Routes:
    """Bitmaps of the anchors that occur more than once, and of those whose unlike stretches may not fit a block."""

    repeated: Broadcast
    hot: Broadcast


def routes(prep: DataFrame, spec: Windows) -> Routes:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, _ in (p for c in spec.chunks(batch.column(0)) for p in spec.pieces(c)):
                r = runs(spec, c)
                stretch = r.rolling.slices(r.start, r.start + r.count + spec.size - 1)
                order = np.lexsort((stretch, r.key))
                key, stretch = r.key[order], stretch[order]
                new = np.append(True, np.diff(key) != 0)[: len(key)]
                unlike = new | np.append(True, np.diff(stretch) != 0)[: len(key)]
                head = np.flatnonzero(new)
                n, d = (np.add.reduceat(x, head) if len(head) else head for x in (np.ones(len(key), np.int64), unlike.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(np.minimum(n, 2)), pa.array(d)], ["key", "n", "d"])

    keys = prep.select("_text").mapInArrow(emit, "key long, n long, d long")
    counts = saved(keys.groupBy("key").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("n > 1").select("key", "d"))
    hot = counts.where(F.col("d") > BLOCK_BYTES // spec.stretch_bytes)
    context = prep.sparkSession.sparkContext
    return Routes(*(context.broadcast(bitmap_of(x.select("key"), x.count())) for x in (counts, hot)))


#: In place of the anchor's place: a window of a hot anchor, sent without its symbols.
_ALONE = -1
CONTEXT = "key long, hash long, id long, th long, start int, windows int, n long, body binary, anchor int"
_CONTEXT = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("n", pa.int64()), ("body", pa.binary()), ("anchor", pa.int32())])


def merged(hash_: np.ndarray, id_: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal stretches, the index of the earliest and the sum of ``n``."""
    order = np.lexsort((start, th, id_, hash_))
    head = np.flatnonzero(np.append(True, np.diff(hash_[order].view(np.int64)) != 0)) if len(order) else np.zeros(0, np.int64)
    return order[head], np.add.reduceat(n[order], head) if len(order) else n


def contexts(prep: DataFrame, spec: Windows, by: Routes) -> DataFrame:
    merge = MERGE_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = (np.frombuffer(x.value, np.uint8) for x in (by.repeated, by.hot))
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            ths = batch.column(1).to_numpy(zero_copy_only=False)
            found: list[list[np.ndarray]] = []
            size = 0
            for c, before in (p for c in spec.chunks(batch.column(2)) for p in spec.pieces(c)):
                r = runs(spec, c)
                r = r.keep(in_bitmap(bits, r.key))
                size += len(c.data)
                if len(r.start):
                    hot = in_bitmap(hot_bits, r.key)
                    h, r = r.keep(hot), r.keep(~hot)
                    alone = K.slices_of(h.start, h.count)
                    start = np.concatenate([r.start, alone])
                    count = np.concatenate([r.count, np.ones(len(alone), np.int64)])
                    doc = np.concatenate([r.doc, np.repeat(h.doc, h.count)])
                    anchor = np.concatenate([r.anchor, np.full(len(alone), _ALONE)])
                    hash_ = r.rolling.slices(start, start + count + spec.size - 1)
                    key = np.concatenate([r.key, K.mix(hash_[len(r.start) :])])
                    id_, th, place = ids[c.first + doc], ths[c.first + doc], start - r.at[doc] + before
                    pick, n = merged(hash_, id_, th, place, np.ones(len(hash_), np.int64))
                    length = np.where(anchor[pick] == _ALONE, 0, count[pick] + spec.size - 1)
                    found.append([key[pick], hash_[pick], id_[pick], th[pick], place[pick], count[pick], n, anchor[pick], length, r.symbols[K.slices_of(start[pick], length)]])
                if size >= merge:
                    yield from stretches(found)
                    found, size = [], 0
            yield from stretches(found)

    def stretches(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        key, hash_, id_, th, start, count, n, anchor, length, symbols = (np.concatenate(x) for x in zip(*found, strict=True))
        pick, n = merged(hash_, id_, th, start, n)
        body = symbols[K.slices_of((np.cumsum(length) - length)[pick], length[pick])]
        off = np.append(0, np.cumsum(length[pick] * spec.symbol_bytes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[pick].view(np.int64)), pa.array(hash_[pick].view(np.int64)), pa.array(id_[pick]), pa.array(th[pick]), pa.array(start[pick].astype(np.int32)),
                pa.array(count[pick].astype(np.int32)), pa.array(n), pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(off), pa.py_buffer(body.tobytes())]), pa.array(anchor[pick].astype(np.int32)),
            ],
            schema=_CONTEXT,
        )

    return prep.select("_id", "_th", "_text").mapInArrow(emit, CONTEXT)


@dataclass
class Block:
    """Distinct stretches of whole anchor groups: the earliest occurrence of each, and how many there are."""

    id: np.ndarray
    th: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    n: np.ndarray
    symbols: np.ndarray
    at: np.ndarray  # in symbols
    anchor: np.ndarray

    def window_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows: the stretch, and the place in ``symbols``."""
        return np.repeat(np.arange(len(self.id)), self.windows), K.slices_of(self.at[:-1], self.windows)


FLAGS = "id long, th long, start int, windows int, flags binary"


def _table(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _merge(t: pa.RecordBatch) -> pa.RecordBatch:
    col = lambda k: t.column(k).to_numpy(zero_copy_only=False)
    pick, n = merged(col(1), col(2), col(3), col(4), col(6))
    order = np.argsort(pick)
    out = t.take(pa.array(pick[order]))
    return out.set_column(6, "n", pa.array(n[order]))


def _block(t: pa.RecordBatch, spec: Windows) -> Block:
    data, off = K.text_buffers(t.column(7))
    body = data[off[0] : off[-1]]
    body = body.copy().view(np.uint32) if spec.by_word else body
    col = lambda k: t.column(k).to_numpy(zero_copy_only=False)
    return Block(col(2), col(3), col(4).astype(np.int64), col(5).astype(np.int64), col(6), body, (off - off[0]) // spec.symbol_bytes, col(8).astype(np.int64))


def solve(ctx: DataFrame, spec: Windows, solver: Callable[[Block], np.ndarray], alone: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``solver`` gives one boolean for each window of a block: True where the default does not hold.

    ``alone`` gives it for the earliest window of each class of equal ones, from their numbers.
    """
    block = BLOCK_BYTES

    def rows(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = _merge(t)
        hot = t.column(8).to_numpy(zero_copy_only=False) == _ALONE
        one, t = t.filter(pa.array(hot)), t.filter(pa.array(~hot))
        if one.num_rows:
            hit = pa.array(alone(one.column(6).to_numpy(zero_copy_only=False)))
            one = one.filter(hit)
            yield flagged(*(one.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5)), [b"\1"] * one.num_rows)
        if not t.num_rows:
            return
        b = _block(t, spec)
        flags = solver(b)
        at = np.append(0, np.cumsum(b.windows))
        hit = np.flatnonzero(np.add.reduceat(flags, at[:-1])) if len(flags) else np.zeros(0, np.int64)
        packed = [np.packbits(flags[at[i] : at[i + 1]], bitorder="little").tobytes() for i in hit]
        yield flagged(b.id[hit], b.th[hit], b.start[hit], b.windows[hit], packed)

    def flagged(id_: np.ndarray, th: np.ndarray, start: np.ndarray, windows: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
        cols = [pa.array(id_, mask=id_ == _LAST), pa.array(th), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["id", "th", "start", "windows", "flags"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, block
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < limit:
                continue
            t = _table(held)
            key = t.column(0).to_numpy(zero_copy_only=False)
            # Cut where the budget is reached at the end of an anchor group; the last group may go on.
            ends = np.flatnonzero(np.diff(key)) + 1
            _, off = K.text_buffers(t.column(7))
            begin = 0
            for e in ends:
                if off[e] - off[begin] >= block or e == ends[-1]:
                    yield from rows(t.slice(begin, e - begin))
                    begin = e
            rest = t.slice(begin)
            held = [_merge(rest) if not begin else rest]  # one huge group: equal stretches become one row
            size = held[0].nbytes
            limit = max(block, 2 * size)
        if held:
            yield from rows(_table(held))

    n = ctx.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return ctx.repartition(int(n), "key").sortWithinPartitions("key").mapInArrow(work, FLAGS)


def apply(prep: DataFrame, spec: Windows, by: Routes, flags: DataFrame, out: str, rewrite: Callable[[K.Chunk, np.ndarray, np.ndarray], Iterator[pa.Array]]) -> DataFrame:
    """``rewrite(chunk, symbols before each document, covered symbols)`` gives the columns ``out`` after ``id``."""
    grouped = flags.groupBy("id", "th").agg(F.collect_list(F.struct("start", "windows", "flags")).alias("_flags"))
    joined = prep.join(grouped, prep["_id"].eqNullSafe(grouped["id"]) & (prep["_th"] == grouped["th"]), "left").select("_id", "_text", "_flags")

    def covered(r: Runs, start: np.ndarray, count: np.ndarray, bit: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Symbols that a window covers which is flagged or, by default, has a repeated anchor; ``start`` counts in the piece."""
        default = np.repeat(True, int(r.count.sum()))
        begin = np.append(0, np.cumsum(r.count))
        run = np.searchsorted(r.start, start, "right") - 1
        default[K.slices_of(begin[run] + start - r.start[run], count)] = bit[K.slices_of(source, count)] == 0
        window = K.slices_of(r.start, r.count)[default]
        step = np.zeros(len(r.symbols) + 1, np.int32)
        step += np.bincount(window, minlength=len(step)).astype(np.int32)
        step -= np.bincount(window + spec.size, minlength=len(step)).astype(np.int32)
        return np.cumsum(step)[:-1] > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(by.repeated.value, np.uint8)
        for batch in batches:
            lists = batch.column(2)
            for c in spec.chunks(batch.column(1)):
                part = lists.slice(c.first, len(c))
                size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                data, off = K.text_buffers(flat.field(2))
                bit = np.unpackbits(data[off[0] : off[-1]], bitorder="little") if len(flat) else np.zeros(0, np.uint8)
                source = (off[:-1] - off[0]) * 8
                start, count = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                found = []
                for p, before in spec.pieces(c):
                    r = runs(spec, p)
                    r = r.keep(in_bitmap(bits, r.key))
                    at = start + np.repeat(r.at[:-1], size) - before
                    mine = np.flatnonzero((at >= 0) & (at < len(r.symbols) - spec.size + 1))
                    found.append((before, r.at, covered(r, at[mine], count[mine], bit, source[mine])))
                ends, gone = found[0][1:]
                if len(found) > 1:  # one long document
                    total = max(before + len(x) for before, _, x in found)
                    ends, gone = np.array([0, total]), np.zeros(total, bool)
                    for before, _, x in found:
                        gone[before : before + len(x)] |= x
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)), *rewrite(c, ends, gone)], ["id", *[x.split()[0] for x in out.split(", ")]])

    return joined.mapInArrow(work, f"id long, {out}")
