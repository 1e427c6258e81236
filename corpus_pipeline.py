"""The corpus pipeline: documents in, packed training bins out.

Five stages, each over all that the one before kept; the stage functions take
(spark, docs, sf_dir) and all but the last return the columns of ``documents``, extra
columns of their input being dropped.

Defined results: a null or wordless text fails the quality rules; a stage called by itself
keeps such documents (near duplicates: they are linked with nothing) except packing, which
gives them no bin. Null ids, sources and languages are carried; of rows that share an id each
is judged by its own text. Repeated rows count as copies: one of them stays. Texts of any
length are processed whole. Ties among near copies go to the least id, then the least text
hash, then the least source. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolith.llm import anchors, native, op1_lines, op2_decontaminate, op3_quality, op6_packing, op10_jaccard
from tomolith.llm.components import saved

#: Shingle size and similarity of near copies; op10's query has a contract of its own.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
#: Share of a document's characters that boilerplate may be; beyond it the document is a copy.
SPARE = 0.5
#: Ids and hashes that may be broadcast: 16 MB.
BROADCAST_IDS = 1 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op3_quality.with_verdict(docs).where("_kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that held nothing else; a document mostly made of them is a copy, left whole for the next stage."""
    out = op1_lines.remove_boilerplate(docs, spare=SPARE)
    touched = F.col("_n_removed") > 0
    kept = out.where(~touched | (native.without_white(F.col("_kept")) != ""))
    n_chars = F.when(touched, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.when(touched, F.col("_kept")).otherwise(F.col("text")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays (of rows with that id, the one with the least text hash).

    Only rows that a bitmap of the ids and hashes of copies marks are dealt out, to tell copies from what it marks besides; all others stay where they are.
    """
    groups = op10_jaccard.near_duplicates(docs, words=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)
    key = lambda c: F.coalesce(F.col(c), F.lit(2**63 - 1))
    texts = saved(groups.groupBy(key("id").alias("k"), F.col("th").alias("t")).agg(F.count("*").alias("n"), F.max(F.when(F.col("n_shingles") > 0, F.col("label"))).alias("c")))
    first = saved(texts.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("k", "t")).alias("first"), F.count("*").alias("m")).where("m > 1").select("c", "first"))
    if first.count() <= BROADCAST_IDS:  # a large group then needs no task of its own
        first = F.broadcast(first)
    later = saved(texts.join(first, "c").where(F.struct("k", "t") != F.col("first")).select("k", "t"))
    marked = saved(later.unionByName(texts.where("n > 1").select("k", "t")).select(F.xxhash64("k", "t").alias("key")))
    shared = spark.sparkContext.broadcast(anchors.bitmap_of(marked, marked.count()))

    @F.arrow_udf("boolean")
    def may_go(hashed: pa.Array) -> pa.Array:
        return pa.array(anchors.in_bitmap(np.frombuffer(shared.value, np.uint8), hashed.to_numpy(zero_copy_only=False).view(np.uint64)))

    keyed = docs.select(*COLUMNS).withColumns({"k": key("doc_id"), "t": F.xxhash64(F.coalesce("text", F.lit("")))}).withColumn("may_go", may_go(F.xxhash64("k", "t")))
    kept = keyed.where("may_go").join(later, ["k", "t"], "left_anti")
    once = kept.withColumn("_row", F.row_number().over(Window.partitionBy("k", "t").orderBy("source"))).where("_row = 1")
    return keyed.where("NOT may_go").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that share an id are told apart by their text."""
    pairs = op2_decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = saved(pairs.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    if found.count() <= BROADCAST_IDS:  # documents then stay where they are
        found = F.broadcast(found)
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (th == found["_th"]), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.packed(docs).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Near duplicates and packing are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{shared or '/tmp/checkpoints'}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            out = docs = spark.read.parquet(f"{folder}/{k}")
    return out
