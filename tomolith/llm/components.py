"""Connected components of a link table, by contraction in few shuffles.

Links are kept as (child, parent) with parent < child. A round deals them out by child, joins
what meets in a partition (a union-find over the whole partition, in bounded batches) and
emits stars around the least node. A node that is nobody's parent hangs on its star for good
and *retires*; whether it is a parent is told by a marker, one per node and task, so that the
hub of a large star receives no row per child. What is left are the local roots, far fewer.
Graphs that do not shrink this way (long chains) go on with links dealt by both ends, which
halves distances in each round. Retired nodes get their labels at last, latest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60
#: Rounds that retire leaves before links are dealt by both ends.
LEAF_ROUNDS = 6
#: Links that one union-find holds; a partition with more is joined in batches.
BATCH = 1 << 20

EDGE, PARENT, LEAF, OPEN = 0, 1, 2, 3
FOREST = "key long, val long, kind int"


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (a, b), sorted, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        open_ = rx != ry
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:  # every node points at a root again
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def rows(key: np.ndarray, val: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
    kind = np.broadcast_to(np.int32(kind), len(key)) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(val), pa.array(np.ascontiguousarray(kind, np.int32))], ["key", "val", "kind"])


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The links (a, b) as stars around least nodes: EDGE rows (child, root) and a PARENT row for each root."""
    nodes, root = union_find(a, b)
    child = nodes != root
    yield rows(nodes[child], root[child], EDGE)
    top = np.unique(root[child])
    yield rows(top, top, PARENT)


def _leaf_round(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """By child: EDGE and PARENT rows in, LEAF, EDGE and PARENT rows out."""
    held: list[np.ndarray] = []

    def done(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, val, kind = t
        edge = kind == EDGE
        if not edge.any():
            return
        nodes, root = union_find(key[edge], val[edge])
        here, marked = np.isin(nodes, key[edge]), np.isin(nodes, key[~edge])
        child = nodes != root
        leaf = child & here & ~marked
        yield rows(nodes[leaf], root[leaf], LEAF)
        on = child & ~leaf
        yield rows(nodes[on], root[on], EDGE)
        top = np.unique(root[on])
        yield rows(top, top, PARENT)

    size, limit = 0, most
    for batch in batches:  # sorted by key
        t = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        held.append(t)
        size += t.shape[1]
        if size >= limit:  # whole keys only: the last one may go on
            t = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(t[0], t[0, -1], "left"))
            yield from done(t[:, :cut])
            held, size = [t[:, cut:]], t.shape[1] - cut
            limit = max(most, 2 * size)
    if held:
        yield from done(np.concatenate(held, axis=1))


def _star_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By either end: links (key, val) in, EDGE rows out, and OPEN rows while some node is neither a root nor a leaf."""
    held = [np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]) for batch in batches]
    if not held:
        return
    key, val = np.unique(np.concatenate(held, axis=1), axis=1)
    less, total = val < key, np.unique(key, return_index=True, return_counts=True)
    below = np.add.reduceat(less, total[1])
    nodes, root = union_find(key, val)
    child = nodes != root
    yield rows(nodes[child], root[child], EDGE)
    if ((below > 0) & (total[2] > 1)).any():
        yield rows(key[:1], val[:1], OPEN)


def contracted(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (columns of FOREST); label is the least node reached, roots included."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, now, levels = BATCH, saved(links), []
    for _ in range(LEAF_ROUNDS):
        if now.where(F.col("kind") == EDGE).isEmpty():
            break
        now = saved(now.where(F.col("kind") != LEAF).repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda b: _leaf_round(b, most), FOREST))
        levels.append(now.where(F.col("kind") == LEAF).select(F.col("key").alias("node"), F.col("val").alias("up")))
    else:
        now = now.where(F.col("kind") == EDGE)
        for _ in range(MAX_ROUNDS):
            both = now.select("key", "val").unionByName(now.select(F.col("val").alias("key"), F.col("key").alias("val")))
            out = saved(both.repartition(n, "key").mapInArrow(_star_round, FOREST))
            now = out.where(F.col("kind") == EDGE)
            if out.where(F.col("kind") == OPEN).isEmpty():
                break
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        levels.append(now.select(F.col("key").alias("node"), F.col("val").alias("up")).distinct())
    labels = None
    for level in reversed(levels):
        if labels is None:
            labels = level.select("node", F.col("up").alias("label"))
            continue
        later = labels.select(F.col("node").alias("up"), "label")
        labels = labels.unionByName(level.join(later, "up", "left").select("node", F.coalesce("label", "up").alias("label")))
    if labels is None:
        labels = now.select(F.col("key").alias("node"), F.col("val").alias("label"))
    labels = saved(labels)
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]))
        size += batch.num_rows
        if size >= most:
            yield from forest(*np.concatenate(held, axis=1))
            held, size = [], 0
    if held:
        yield from forest(*np.concatenate(held, axis=1))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link between two different nodes; label is the least node reached."""
    most = BATCH
    return contracted(links.select(F.col(a).cast("long"), F.col(b).cast("long")).where(F.col(a) != F.col(b)).mapInArrow(lambda b: _stars(b, most), FOREST))
