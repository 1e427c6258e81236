"""Substring dedup: words that a repeated 20-word passage covers go, its first occurrence stays.

Prefix-partitioned suffix trees. The suffixes that can matter are those whose first 20
words occur twice. ``anchors`` deals them out by variable-length prefixes: by a gram of eight
words that a group shares, and where such a group would not fit its memory by all 20 words.
Within a group, longer prefixes split the suffixes into subtrees, top down, two words a
level: a subtree of one suffix is a leaf and is dropped, what is left at a depth of 20 words
are the deep internal nodes, each a maximal class of equal windows; ``maximal_repeats``
follows their edges on to the words where their suffixes part.

Order of occurrences: doc_id (null last), then a hash of the text (of rows that share a doc_id),
then start. Texts of any length are read whole. Defined results: null text: no words. Rows with equal doc_id and text are the same
document twice: both stay whole. Fewer than 20 words: nothing is removed. Empty table:
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from . import kernels as K

SIZE = 20
GRAM = 8
#: Suffixes that one subtree may start from; more are split by a longer prefix first.
SUBTREE_SUFFIXES = 1 << 20


def deep_nodes(symbols: np.ndarray, start: np.ndarray, size: int, budget: int = SUBTREE_SUFFIXES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Internal nodes at depth ``size``: pairs (suffix numbers, node number) of suffixes that share ``size`` symbols."""
    todo, out = [(np.arange(len(start)), np.zeros(len(start), np.int64), 0)], []
    while todo:
        rows, node, depth = todo.pop()
        while depth < size and len(rows):
            take = min(2, size - depth)
            edge = symbols[start[rows] + depth].astype(np.uint64)
            if take == 2:
                edge = edge << np.uint64(32) | symbols[start[rows] + depth + 1].astype(np.uint64)
            order = np.lexsort((edge, node))
            rows, node, edge = rows[order], node[order], edge[order]
            new = np.append(True, (np.diff(node) != 0) | (edge[1:] != edge[:-1]))
            child = np.cumsum(new) - 1
            inner = np.bincount(child)[child] > 1
            rows, node, depth = rows[inner], child[inner], depth + take
            if len(rows) > budget and depth < size:  # a longer prefix for each part
                cut = np.flatnonzero(np.append(True, np.diff(node) != 0))
                cut = cut[np.append(True, np.diff(cut // budget) != 0)]
                if len(cut) > 1:
                    todo += [(rows[a:b], node[a:b], depth) for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
                    rows = rows[:0]
        if len(rows):
            out.append((rows, node))
    return out


def maximal_repeats(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = SIZE) -> list[tuple[np.ndarray, int]]:
    """(suffix numbers, length) of the deep internal nodes: sets of suffixes symbols[start:end] that share ``size`` symbols or more, and all that they share."""
    out = []
    whole = start + size <= end
    number = np.flatnonzero(whole)
    for rows, node in deep_nodes(symbols, start[whole], size):
        rows = number[rows]
        head = np.flatnonzero(np.append(True, np.diff(node) != 0))
        which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(rows))))
        length = np.full(len(head), size)
        grows = np.ones(len(head), bool)
        while grows.any():  # along the edge below the node, until the suffixes part or one ends
            at = start[rows] + length[which]
            inside = at < end[rows]
            next_ = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)].astype(np.int64), -1)
            grows &= np.logical_and.reduceat(inside & (next_ == next_[head][which]), head)
            length += grows
        out += [(r, int(n)) for r, n in zip(np.split(rows, head[1:]), length, strict=True)]
    return out


def first_windows(b: A.Block) -> np.ndarray:
    """True for a window of a stretch's earliest occurrence that starts nowhere earlier."""
    owner, start = b.window_starts()
    flags = np.ones(len(owner), bool)
    place = b.start[owner] + (start - b.at[owner])
    for rows, node in deep_nodes(b.symbols, start, SIZE):
        order = np.lexsort((place[rows], b.th[owner[rows]], b.id[owner[rows]], node))
        rows, node = rows[order], node[order]
        flags[rows[np.append(False, np.diff(node) == 0)]] = False
    return flags


def _rewrite(c: K.Chunk, at: np.ndarray, covered: np.ndarray) -> Iterator[pa.Array]:
    removed = np.diff(np.append(0, np.cumsum(covered))[at])
    kept = []
    for d in range(len(c)):
        found = c.data[c.off[d] : c.off[d + 1]].tobytes().split()
        if removed[d]:
            found = compress(found, ~covered[at[d] : at[d + 1]])
        kept.append(b" ".join(found))
    return iter([pa.array(np.diff(at).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words left, joined by one space)."""
    spec, prep = A.Windows(SIZE, GRAM, True), A.prepared(docs, id_col, text_col)
    by = A.routes(prep, spec)
    flags = A.solve(A.contexts(prep, spec, by), spec, first_windows, lambda n: np.ones(len(n), bool))
    return A.apply(prep, spec, by, flags, "n_words long, n_removed long, kept string", _rewrite)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, count(*) OVER o AS n, md5(string_agg(x, ' ') OVER o) AS h FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {SIZE - 1} FOLLOWING)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k WHERE n = {SIZE}),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS i FROM f WHERE r > 1),
s AS (SELECT doc_id, count(g.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM p LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""
