"""N-gram Jaccard join with signature trees; exact components of links at a threshold.

The query's contract is 4 words and 85 %; callers may give others.

1. Documents with equal shingle sets are one class.
2. Routing (exact, no link is lost): shingles fall into m hashed parts. Two linked sets
   differ in at most d shingles, so of m = d + 1 + s parts they agree on s + 1 whole ones or
   more; classes that agree on a part meet. The s parts of a set that say least are not used:
   they are the ones that unlike texts with a common line may agree on, having no shingle but
   such as many sets have (``_common``) or few at all. m, d and s follow the size of the sets, and each class takes part at two neighbouring size levels so that all
   compatible sizes meet. Shared passages bring few together: a part agrees only if nothing
   else is in it.
3. Classes that meet, directly or through others, form a group. Each group becomes a
   *signature tree*: leaves are classes, nodes hold the OR of token bitmaps, size ranges
   and whether all below are already connected. The tree is traversed against itself;
   a pair of nodes is pruned when sizes cannot fit, when the largest possible overlap is
   too small, or when it could add no new connection; surviving leaves are compared
   exactly. Groups over a memory budget are split into blocks: every block alone, then, where
   parts are still unconnected, one class of each part, each block with the first, and
   at last all pairs of blocks.
4. Components of the links found, then of all documents.

Words: maximal runs of characters other than space and \\t..\\r, A-Z lower-cased. A set
with fewer words than a shingle is the whole sequence; no words or null text: empty, linked
with nothing. Rows sharing a doc_id are separate rows; a null id joins as the largest and
is reported as null only if its whole component has no other. Empty table: empty result.
Texts of any length are read whole; ties play no part. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from . import components as C
from . import kernels as K
from .components import connected, saved

WORDS = 4
NUM, DEN = 85, 100
#: Bytes of shingle hashes in one tree.
BLOCK_BYTES = 16 << 20
FANOUT = 8
#: Classes that have a shingle before it counts as common.
COMMON = 8
_NONE = np.iinfo(np.int64).max


def shingles(c: K.Chunk, size: int = WORDS, piece: int = K.PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the offsets of the documents."""
    pieces = [p for p, _ in K.cut_words(c, size - 1, piece)]
    if len(pieces) > 1:  # one long document; a piece with too few words for a shingle has none of its own
        pieces = [p for p in pieces if len(K.words(p).start) >= size]
    if len(pieces) <= 1:
        return _shingles(c, size)
    h = np.unique(np.concatenate([_shingles(p, size)[0] for p in pieces]))
    return h, np.array([0, len(h)])


def _shingles(c: K.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    w = K.words(c)
    rolling = K.Rolling(K.word_hashes(c, w, lower=True))
    n = np.diff(w.at)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    start = K.slices_of(w.at[:-1], count)
    end = np.minimum(start + size, np.repeat(w.at[1:], count))
    h = rolling.slices(start, end)
    off = np.append(0, np.cumsum(count))
    for a, b in zip(off[:-1], off[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[off[:-1][count > 0]] = True
    return h[new], np.append(0, np.cumsum(new))[off]


def class_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    out = np.zeros(len(off) - 1, np.uint64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        one = np.add.reduceat(K.mix(h ^ np.uint64(0x51ED270B0A1F39C1)), off[full])
        two = np.bitwise_xor.reduceat(K.mix(h + np.uint64(0x3C6EF372FE94F82B)), off[full])
        out[full] = K.mix(one ^ K.mix(two + np.diff(off)[full].astype(np.uint64))) | np.uint64(1)
    return out.view(np.int64)


@lru_cache(maxsize=4)
def levels(num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size levels: first size of each, and for a set of level j and one of level j or j+1 the most shingles d in which they differ if linked, and how many of the parts need not be used."""
    edge = [1]
    while edge[-1] < 1 << 40:
        edge.append(max(edge[-1] + 1, (edge[-1] - 1) * den // num + 1))
    e = np.array(edge, np.int64)
    d = (e[1:-1] + e[2:] - 2) * (den - num) // (den + num)  # two sets of level j+1 meet by the parts of that level
    return e, d, (d + 2) // 5


def parts(h: np.ndarray, off: np.ndarray, num: int = NUM, den: int = DEN, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed parts of every set as (number of the set, hash of scheme, part and content); ``common`` marks shingles of many sets."""
    rare = np.ones(len(h), bool) if common is None else ~common
    edge, most, spare = levels(num, den)
    n = np.diff(off)
    level = np.searchsorted(edge, n, "right") - 1
    sets, out = [], []
    for step in (0, 1):
        scheme = level - step
        use = np.flatnonzero((n > 0) & (scheme >= 0))
        m = most[scheme[use]] + 1 + spare[scheme[use]]
        begin = np.cumsum(m) - m
        size = n[use]
        rows = K.slices_of(off[use], size)
        x = h[rows]
        at = (x >> np.uint64(8)) % np.repeat(m, size).astype(np.uint64) + np.repeat(begin, size).astype(np.uint64)
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, at.astype(np.int64), K.mix(x))
        owner = np.repeat(np.arange(len(use)), m)
        # Linked sets agree on one part more than are spare, and what they agree on scores the same in both: the parts
        # that say least (fewest rare shingles, then smallest) may go in each, as long as all of a score go and no more than are spare.
        many, all_ = (np.bincount(at.astype(np.int64), x, len(total)).astype(np.int64) for x in (rare[rows], None))
        score = np.minimum(many, (1 << 19) - 1) << 20 | np.minimum(all_, (1 << 20) - 1)
        order = np.sort(owner << 40 | score)
        least = order[begin + spare[scheme[use]]] & ((1 << 40) - 1) if len(use) else order
        keep = score >= least[owner]
        place = np.arange(len(total)) - begin[owner] + scheme[use][owner] * (1 << 34)
        sets.append(use[owner[keep]])
        out.append(K.mix(total[keep] + K.mix(place[keep].astype(np.uint64))))
    return np.concatenate(sets), np.concatenate(out)


class Tree:
    """A signature tree over sets of hashes; ``links`` joins what is linked and not yet connected."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        size = np.array([len(s) for s in sets], np.int64)
        first = np.array([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((first, size))
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]
        self.root = self._numbered(label[self.order])
        bits = int(min(1 << 15, max(256, 1 << int(2 * self.size.max()).bit_length())))
        leaf = np.zeros((len(sets), bits // 64), np.uint64)
        for k, s in enumerate(self.sets):
            b = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(leaf[k], b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        hidden = self.size - np.bitwise_count(leaf).sum(1)
        self.nodes = [(leaf, self.size, self.size, hidden)]
        while len(self.nodes[-1][0]) > 1:
            o, lo, hi, hid = self.nodes[-1]
            at = np.arange(0, len(o), FANOUT)
            self.nodes.append((np.bitwise_or.reduceat(o, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)))

    @staticmethod
    def _numbered(label: np.ndarray) -> np.ndarray:
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        return first[inverse].copy()

    def _one(self, level: int) -> np.ndarray:
        """Of each node: the component of all below, or -1 if there are several."""
        one = self.root
        for _ in range(level):
            at = np.arange(0, len(one), FANOUT)
            lo, hi = np.minimum.reduceat(one, at), np.maximum.reduceat(one, at)
            one = np.where(lo == hi, lo, -1)
        return one

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        o, lo, hi, hid = self.nodes[level]
        fits = (self.den * np.minimum(hi[i], hi[j]) >= self.num * np.maximum(lo[i], lo[j]))
        one = self._one(level)
        fits &= (one[i] != one[j]) | (one[i] < 0)
        k = np.flatnonzero(fits)
        for a in range(0, len(k), 4096):
            p = k[a : a + 4096]
            overlap = np.bitwise_count(o[i[p]] & o[j[p]]).sum(1, dtype=np.int64) + np.minimum(hid[i[p]], hid[j[p]])
            fits[p] = (self.num + self.den) * overlap >= self.num * (lo[i[p]] + lo[j[p]])
        return fits

    def _linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return self.den * both >= self.num * (len(x) + len(y) - both)

    def _join(self, a: int, b: int, out: list) -> None:
        if self.root[a] != self.root[b] and self._linked(a, b):
            out.append((self.order[a], self.order[b]))
            old, new = sorted((self.root[a], self.root[b]))[::-1]
            self.root[self.root == old] = new

    def links(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of input numbers that connect what links connect; with ``side``, only pairs across its two values are sought."""
        out: list[tuple[int, int]] = []
        side = None if side is None else side[self.order]
        across = lambda a, b: side is None or side[a] != side[b]
        for a in range(len(self.sets) - 1):  # neighbours first: they connect most of a group
            if across(a, a + 1):
                self._join(a, a + 1, out)
        top = len(self.nodes) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            keep = self._possible(level, i, j) if level or len(i) > 1 or i[0] != j[0] else np.zeros(1, bool)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if across(a, b):
                        self._join(a, b, out)
                continue
            below = len(self.nodes[level - 1][0])
            ci = (i[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            cj = (j[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            ci, cj = (x.ravel() for x in np.broadcast_arrays(ci, cj))
            ok = (ci < below) & (cj < below) & (ci < cj if level == 1 else ci <= cj)
            ci, cj = ci[ok], cj[ok]
            for a in range(0, len(ci), 1 << 14):
                todo.append((level - 1, ci[a : a + (1 << 14)], cj[a : a + (1 << 14)]))
        return out


def _shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _classes(read: DataFrame, words: int) -> DataFrame:
    """(id, th, cid, n) of every document; rows with n = -1 count shingles (id) that several classes of a batch have (th)."""

    chunk, piece = K.CHUNK_BYTES, K.PIECE_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, known = [], np.zeros(0, np.int64)
            for c in K.chunks(batch.column(1), chunk):
                h, off = shingles(c, words, piece)
                cid, n = class_ids(h, off), np.diff(off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)), batch.column(2).slice(c.first, len(c)), pa.array(cid), pa.array(n)], ["id", "th", "cid", "n"])
                pick = _unlike(cid, known)
                known = np.append(known, cid[pick])
                sets.append(h[K.slices_of(off[pick], n[pick])])
                if sum(map(len, sets)) >= 4 * C.BATCH:
                    yield counted(sets)
                    sets = []
            yield counted(sets)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        key, n = key[n > 1].view(np.int64), n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.zeros(len(n), np.int64)), pa.array(np.full(len(n), -1))], ["id", "th", "cid", "n"])

    return read.mapInArrow(work, "id long, th long, cid long, n long")


def _unlike(cid: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One row of each class that is not known, the class of no words left out."""
    _, pick = np.unique(cid, return_index=True)
    return pick[(cid[pick] != 0) & ~np.isin(cid[pick], known)]


def _common(rows: DataFrame) -> Broadcast:
    """A bitmap of the shingles that ``COMMON`` classes have or more, as far as batches saw them repeated. What it leaves out or adds costs work, never a link."""
    keys = rows.where("n < 0").groupBy(F.col("id").alias("key")).agg(F.sum("th").alias("c")).where(F.col("c") >= COMMON).select("key")
    keys = saved(keys)
    return rows.sparkSession.sparkContext.broadcast(A.bitmap_of(keys, keys.count()))


def _met(key: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys one row is enough: (rows that stay, and the pairs (class, class of the row that stays) of the others)."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0) if len(key) else np.zeros(0, bool)
    lead = order[new]
    pair = np.stack([cid[order[~new]], cid[lead[np.cumsum(new) - 1][~new]]])
    pair = pair[:, pair[0] != pair[1]]
    return lead, pair[0], pair[1]


def _meetings(read: DataFrame, words: int, num: int, den: int, common: Broadcast) -> DataFrame:
    """Links between classes that agree on a part, as a forest for ``components.contracted``.

    A task sends one row for each part, however many of its classes agree on it, and the links between these.
    """

    chunk, piece, most = K.CHUNK_BYTES, K.PIECE_BYTES, C.BATCH

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        bits = np.frombuffer(common.value, np.uint8)

        def done() -> pa.RecordBatch:
            key, cid = np.concatenate(held, axis=1)
            lead, a, b = _met(key, cid)
            node, root = C.union_find(a, b)
            node, root = node[node != root], root[node != root]
            link = K.mix(node.view(np.uint64) + K.mix(root.view(np.uint64))).view(np.int64)  # a part of its own that two classes agree on
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[lead], link, link])), pa.array(np.concatenate([cid[lead], node, root]))], ["key", "cid"])

        for batch in batches:
            seen = np.zeros(0, np.int64)
            for c in K.chunks(batch.column(1), chunk):
                h, off = shingles(c, words, piece)
                cid = class_ids(h, off)
                pick = _unlike(cid, seen)  # once per class and batch
                seen = np.append(seen, cid[pick])
                n = np.diff(off)[pick]
                h = h[K.slices_of(off[pick], n)]
                owner, key = parts(h, np.append(0, np.cumsum(n)), num, den, A.in_bitmap(bits, h))
                held.append(np.stack([key.view(np.int64), cid[pick][owner]]))
                size += len(key)
                if size >= most:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, size = [], 0
        held = None  # the last part, and the class that its others are linked with
        for batch in batches:  # sorted by key
            key, cid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(key):
                continue
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lead = cid[head].copy()
            if held is not None and key[0] == held[0]:
                lead[0] = held[1]
            held = key[-1], lead[-1]
            pair = np.stack([cid, np.repeat(lead, np.diff(np.append(head, len(key))))])
            links.append(pair[:, pair[0] != pair[1]])
            size += links[-1].shape[1]
            if size >= most:
                yield from C.forest(*np.concatenate(links, axis=1))
                links, size = [], 0
        if size:
            yield from C.forest(*np.concatenate(links, axis=1))

    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = read.select("id", "text").mapInArrow(emit, "key long, cid long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, C.FOREST)


def _bodies(read: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """``units`` (cid, rep, unit, side, label) with the sets (body), read again from the representatives."""
    reps = units.select(F.xxhash64("rep").alias("key"))
    bitmap = A.bitmap_of(reps, reps.count())
    shared = read.sparkSession.sparkContext.broadcast(bitmap)
    chunk, piece = K.CHUNK_BYTES, K.PIECE_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            key = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.filter(pa.array(A.in_bitmap(bits, key)))
            for c in K.chunks(part.column(1), chunk):
                h, off = shingles(c, words, piece)
                ids = part.column(0).slice(c.first, len(c))
                body = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([ids, pa.array(class_ids(h, off)), body], ["rep", "cid", "body"])

    id_ = F.coalesce("id", F.lit(_NONE)).alias("id")
    found = read.select(id_, "text").withColumn("k", F.xxhash64("id")).mapInArrow(emit, "rep long, cid long, body binary")
    return found.join(units, ["rep", "cid"])


def _tree_links(rows: DataFrame, cross: bool, num: int, den: int) -> DataFrame:
    """Links in each unit (columns unit, side, cid, label, body)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # by class: a repeated row brings its set again
        unit = None

        def solved() -> pa.RecordBatch:
            cid = np.array(list(held), np.int64)
            side, label, body = zip(*held.values(), strict=True)
            tree = Tree([np.frombuffer(x, np.uint64) for x in body], np.array(label, np.int64), num, den)
            found = tree.links(np.array(side) if cross else None)
            i, j = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j])], ["a", "b"])

        for batch in batches:
            for u, side, cid, label, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and u != unit:
                    yield solved()
                    held = {}
                unit = u
                held.setdefault(cid, (side, label, body))
        if held:
            yield solved()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("unit", "side", "cid", "label", "body").repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(work, "a long, b long")


def _links(read: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links that connect each group; ``members`` are (cid, rep, n, group). Sets travel only to the trees that need them."""
    blocks = members.groupBy("group").agg((F.floor(F.sum(F.col("n") * 8 + 64) / BLOCK_BYTES) + 1).alias("blocks"))
    placed = saved(members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    none = F.lit(0).alias("side")
    links = saved(_tree_links(_bodies(read, placed.select("cid", "rep", F.xxhash64("group", "block").alias("unit"), none, F.col("cid").alias("label")), words), False, num, den))
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    for step in ("samples", "first block", "all blocks"):
        labels = connected(links.join(large.select(F.col("cid").alias("a")), "a", "left_semi")).withColumnRenamed("node", "cid")
        now = large.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        split = now.groupBy("group").agg(F.count_distinct("label").alias("c")).where("c > 1").select("group")
        now = saved(now.join(split, "group", "left_semi"))
        if now.isEmpty():
            break
        if step == "samples":  # one class of the main component of each block: the parts of a family find each other
            parts_ = now.groupBy("group", "block", "label").agg(F.count("*").alias("c"), F.min("cid").alias("cid"))
            pick = parts_.groupBy("group", "block").agg(F.max(F.struct("c", "cid")).alias("m")).select("m.cid")
            some = now.join(pick, "cid", "left_semi")
            units = some.select("cid", "rep", F.xxhash64("group", F.lit(-1)).alias("unit"), none, "label")
        elif step == "first block":
            meets = F.when(F.col("block") == 0, F.filter(every, lambda x: x > 0)).otherwise(F.array(F.col("block")))
            pair = now.withColumn("o", F.explode(meets))
            units = pair.select("cid", "rep", F.xxhash64("group", "o").alias("unit"), (F.col("block") > 0).cast("int").alias("side"), "label")
        else:
            pair = now.withColumn("o", F.explode(F.filter(every, lambda x: x != F.col("block"))))
            low, high = F.least("block", "o"), F.greatest("block", "o")
            units = pair.where(low > 0).select("cid", "rep", F.xxhash64("group", low, high).alias("unit"), (F.col("block") > F.col("o")).cast("int").alias("side"), "label")
        links = saved(links.unionByName(_tree_links(_bodies(read, units, words), step != "samples", num, den)))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: id, th (xxhash64 of the text), cid (class), label (least class of the component), n_shingles, component_id; shingles of ``words``, linked from num/den."""
    read = _shingled(docs, id_col, text_col)
    every = saved(_classes(read, words))
    rows = every.where("n >= 0")
    least = rows.where("n > 0").groupBy("cid").agg(F.min(F.coalesce("id", F.lit(_NONE))).alias("rep"), F.max("n").alias("n"))
    groups = C.contracted(_meetings(read, words, num, den, _common(every))).select(F.col("node").alias("cid"), F.col("label").alias("group"))
    members = saved(groups.join(least, "cid"))
    labels = connected(_links(read, members, words, num, den)).withColumnRenamed("node", "cid")
    whole = labels.join(least, "cid").groupBy("label").agg(F.min("rep").alias("component"))
    linked = labels.join(whole, "label").select("cid", "component", "label")
    final = saved(least.join(linked, "cid", "left").select("cid", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "cid").alias("label")))
    out = rows.join(final, "cid", "left").withColumn("component", F.when(F.col("component") < _NONE, F.col("component")))
    return out.select("id", "th", "cid", "label", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, n, i, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)) AS h FROM p),
s AS MATERIALIZED (SELECT DISTINCT doc_id, h FROM k WHERE i <= greatest(n - {WORDS - 1}, 1)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN c x ON x.doc_id = b.a JOIN c y ON y.doc_id = b.b WHERE {DEN} * b.n >= {NUM} * (x.n + y.n - b.n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(least(m.c, d.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""
