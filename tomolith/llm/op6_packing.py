"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

Documents longer than a bin are cut into full pieces and a rest; pieces are dealt by hash
to packing groups of about ``GROUP`` pieces (so that copies and hot sources spread evenly),
and each group is packed on its own, largest piece first: the tightest bin is that of the group. Bins are kept ordered by what is
left in them and carry two bitmaps, of sources and of duplicate clusters. A piece goes to
the tightest bin that fits and shares neither a source nor a cluster with it: the search
starts at the first bin with room enough and moves to the successor until one is compatible;
a new bin is opened if none is. Only ids and sizes are shuffled, never texts.

Duplicate clusters are those of ``cluster_col``, any column that equal members share (the
component of a near-duplicate search, for instance); without one they are exact copies up to case.

Sizes are words. Null or wordless texts take no room and get no bin (bin_id null, piece 0).
A null source is a source of its own; rows of one id are told apart by their text; ties in
size are broken by cluster, id and piece. Repeated rows conflict with themselves and so
never share a bin; a null cluster is one of its own. Texts of any length are cut into pieces. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native as N
from .components import saved

CAPACITY = 1024
GROUP = 4096


def best_fit(pieces: Sequence[tuple[int, str, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for pieces (size, source, cluster) given in packing order."""
    sources: dict[str, int] = {}
    copies = Counter(c for _, _, c in pieces)
    clusters: dict[int, int] = {}
    bins: list[tuple[int, int]] = []  # (room left, number), ordered
    held: list[list[int]] = []  # bitmaps of sources and clusters
    out = []
    for size, source, cluster in pieces:
        s = 1 << sources.setdefault(source, len(sources))
        c = 1 << clusters.setdefault(cluster, len(clusters)) if copies[cluster] > 1 else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held[bins[at][1]][0] & s or held[bins[at][1]][1] & c):
            at += 1
        if at < len(bins):
            room, number = bins.pop(at)
        else:
            room, number = capacity, len(held)
            held.append([0, 0])
        out.append((number, capacity - room))
        held[number][0] |= s
        held[number][1] |= c
        if room > size:
            insort(bins, (room - size, number))
    return out


PACKED = "id long, piece int, n_words int, bin_id long, bin_offset int"


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group: int = GROUP, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, n_words, bin_id, bin_offset."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = F.xxhash64(F.lower(text))
    cluster = own if cluster_col is None else F.when(docs[cluster_col].isNotNull(), F.xxhash64(docs[cluster_col].cast("string"))).otherwise(F.xxhash64(own, docs[id_col]))
    items = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), cluster.alias("cluster"), F.size(N.words(text)).alias("size"))
    items = saved(items)  # the texts are read once; what follows needs ids and sizes only
    number = F.greatest(F.ceil(F.col("size") / capacity).cast("int"), F.lit(1))
    groups = (items.agg(F.sum(number)).first()[0] or 0) // group + 1
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("n_words", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)))
    items = items.withColumn("g", F.pmod(F.xxhash64("cluster", "id", "piece"), F.lit(groups)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> pa.RecordBatch:
            empty = [r for r in held if r[5] == 0]
            full = [r for r in held if r[5]]
            places = best_fit([(r[5], r[2], r[3]) for r in full], capacity)
            rows = [(r[1], r[4], 0, None, None) for r in empty] + [(r[1], r[4], r[5], (at << 32) + b, o) for r, (b, o) in zip(full, places, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != at:
                    yield done()
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield done()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select("g", "id", "source", "cluster", "piece", "n_words").repartition(n, "g")
    return dealt.sortWithinPartitions("g", F.desc("n_words"), "cluster", "id", "source", "piece").mapInArrow(work, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
