"""Suffix-array dedup: bytes that any repeated 200-byte string covers go, wherever they stand.

Difference-cover suffix sorting. ``anchors`` deals the stretches that can hold a repeat
into groups of equal anchors. In a group equal strings stand at equal distances from the
anchor, so the cover is taken relative to it: every eighth byte is a sample position.
Sample suffixes are strings of eight-byte symbols; ``suffixes.suffix_array`` sorts them
(triples of symbols, recursion on their names, merging the rest). The remaining suffixes,
the starts between samples, are sorted by the few bytes up to the next sample and its
rank, and neighbours in that order are compared over 200 bytes.

Defined results: null text: no bytes. Texts under 200 bytes: nothing is removed; texts of any
length are read whole. Rows with equal doc_id and text are two occurrences: both lose the
repeat, so that ties need no order. Empty table: empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from . import kernels as K
from . import suffixes as S

SIZE = 200
GRAM = 32
STEP = 8


def repeated_windows(symbols: np.ndarray, at: np.ndarray, anchor: np.ndarray, owner: np.ndarray, start: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Whether the string of ``size`` bytes at ``start`` occurs at another of the starts.

    Stretch j is symbols[at[j]:at[j+1]]; equal strings have equal distances to their anchors.
    """
    base = at[:-1] + anchor % STEP  # first sample of each stretch
    count = np.maximum(-(-(at[1:] - base) // STEP), 0)
    first = np.cumsum(count) - count
    eight = S.eights(symbols)
    names = S._ranks_of(eight[np.repeat(base - first * STEP, count) + np.arange(int(count.sum())) * STEP])
    order = S.suffix_array(names + 1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    behind = (base[owner] - start) % STEP  # bytes up to the next sample
    sample = first[owner] + (start + behind - base[owner]) // STEP
    lead = np.where(behind > 0, eight[start] >> ((8 - behind) * 8 % 64).astype(np.uint64), np.uint64(0))
    # The class of a start is its distance to the anchor modulo 8: behind. Lead bytes tell the rest.
    lead = lead << np.uint64(3) | behind.astype(np.uint64)
    key = S._ranks_of(lead, rank[sample])
    by = np.argsort(key)
    i, j = start[by[:-1]], start[by[1:]]
    same = (behind[by[:-1]] == behind[by[1:]]) & S.same_prefix(symbols, i, j, size) if len(by) > 1 else np.zeros(0, bool)
    out = np.zeros(len(start), bool)
    out[by[:-1][same]] = True
    out[by[1:][same]] = True
    return out


def single_windows(b: A.Block) -> np.ndarray:
    """True for a window that occurs once in the whole table."""
    owner, start = b.window_starts()
    if not len(owner):
        return np.zeros(0, bool)
    return ~repeated_windows(b.symbols, b.at, b.anchor, owner, start) & (b.n[owner] == 1)


def _rewrite(c: K.Chunk, off: np.ndarray, covered: np.ndarray) -> Iterator[pa.Array]:
    total = np.append(0, np.cumsum(covered))
    removed = np.diff(total[off])
    begin = covered.copy()
    begin[1:] &= ~covered[:-1]
    inner = off[(off > 0) & (off < len(covered))]
    begin[inner] = covered[inner]
    spans = np.diff(np.append(0, np.cumsum(begin))[off])
    left = c.data[~covered]
    kept = np.append(0, np.cumsum(np.diff(off) - removed)).astype(np.int64)
    body = pa.Array.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(kept), pa.py_buffer(left.tobytes())]).cast(pa.binary())
    return iter([pa.array(np.diff(off)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), body])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    spec, prep = A.Windows(SIZE, GRAM, False), A.prepared(docs, id_col, text_col)
    by = A.routes(prep, spec)
    flags = A.solve(A.contexts(prep, spec, by), spec, single_windows, lambda n: n == 1)
    return A.apply(prep, spec, by, flags, "n_bytes long, n_removed long, n_spans long, kept binary", _rewrite)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Windows are cut from pairs of neighbouring pieces of SIZE bytes, as hex digits.
SQL = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
q AS (SELECT doc_id, n, j, substr(h, {2 * SIZE} * j + 1, {4 * SIZE}) AS two FROM (SELECT doc_id, h, n, unnest(range(n // {SIZE} + 1)) AS j FROM d)),
k AS MATERIALIZED (SELECT doc_id, {SIZE} * j + r AS i, md5_number(substr(two, 2 * r + 1, {2 * SIZE})) AS m FROM q, range({SIZE}) t(r) WHERE {SIZE} * j + r + {SIZE} <= n),
c AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
w AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k WHERE m IN (SELECT m FROM c)),
s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM w),
e AS (SELECT doc_id, span, min(i) AS a, max(i) + {SIZE} AS b FROM s GROUP BY 1, 2),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM e),
r AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""
