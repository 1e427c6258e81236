"""Vectors and operators read from the driver's tables; keys there are dense from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.operators.linear import Relation

from .descriptor import Grid
from .vector import Vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROWS: dict[tuple[str, str, str], int] = {}


def rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of rows of a table, counted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ROWS:
        _ROWS[key] = table(spark, sf_dir, name).count()
    return _ROWS[key]


def _column(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, scale: float) -> Vector:
    df = table(spark, sf_dir, name)
    return Vector(df.select(F.col(key).cast("long").alias("idx"), (F.col(value).cast("double") / scale).alias("val")), Grid((rows(spark, sf_dir, name),)))


def prices(spark: SparkSession, sf_dir: str) -> Vector:
    """Order totals in thousands, by order key."""
    return _column(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", 1000.0)


def balances(spark: SparkSession, sf_dir: str) -> Vector:
    """Customer balances in thousands (some negative), by customer key."""
    return _column(spark, sf_dir, "customer", "c_custkey", "c_acctbal", 1000.0)


def retail(spark: SparkSession, sf_dir: str) -> Vector:
    return _column(spark, sf_dir, "part", "p_partkey", "p_retailprice", 1000.0)


def image(spark: SparkSession, sf_dir: str) -> Vector:
    """A 32 x 32 histogram of parts by size and key; pixels without parts are 0."""
    grid = Grid((32, 32))
    idx = F.col("p_size") % 32 + 32 * (F.col("p_partkey") % 32)
    parts = table(spark, sf_dir, "part").select(idx.cast("long").alias("idx"), F.lit(1.0).alias("val"))
    zero = spark.range(grid.size).select(F.col("id").alias("idx"), F.lit(0.0).alias("val"))
    return Vector(parts.unionByName(zero).groupBy("idx").agg(F.sum("val").alias("val")), grid)


def trade(spark: SparkSession, sf_dir: str) -> Relation:
    """Quantities in hundreds, from suppliers (columns) to customers (rows)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    entries = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col")).agg((F.sum("l_quantity") / 100.0).alias("w"))
    return Relation(entries, Grid((rows(spark, sf_dir, "supplier"),)), Grid((rows(spark, sf_dir, "customer"),)))


def supplier_balances(spark: SparkSession, sf_dir: str) -> Vector:
    return _column(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", 1000.0)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def segments(spark: SparkSession, sf_dir: str) -> tuple[Relation, Vector]:
    """A small dense problem: mean balance by nation (rows) and segment (columns); the right side is the nation's mean."""
    place = F.lit(0)
    for i, s in enumerate(SEGMENTS):
        place = F.when(F.col("c_mktsegment") == s, i).otherwise(place)
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("row"), place.cast("long").alias("col"), (F.col("c_acctbal") / 1000.0).alias("v"))
    a = c.groupBy("row", "col").agg((F.sum("v") / F.count("*")).alias("w"))
    zero = spark.range(25).select(F.col("id").alias("row"), F.lit(0.0).alias("v"))
    b = c.select("row", "v").unionByName(zero).groupBy(F.col("row").alias("idx")).agg((F.sum("v") / F.count("*")).alias("val"))
    return Relation(a, Grid((len(SEGMENTS),)), Grid((25,))), Vector(b, Grid((25,)))


def order_fit(spark: SparkSession, sf_dir: str) -> tuple[Relation, Vector, list[float]]:
    """Orders against their number of lines, quantity and discount: columns of unit norm, and the norms."""
    orders = rows(spark, sf_dir, "orders")
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.count("*").cast("double").alias("c0"), F.sum("l_quantity").alias("c1"), F.sum("l_discount").alias("c2"), F.sum("l_extendedprice").alias("b"))
    norms = per.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("c0", "c1", "c2")]).first()
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("col"), (F.col(f"c{i}") / norms[i]).alias("w")) for i in range(3)])
    entries = per.select("row", F.inline(parts))
    b = per.select(F.col("row").alias("idx"), F.col("b").alias("val")).unionByName(spark.range(orders).select(F.col("id").alias("idx"), F.lit(0.0).alias("val")))
    return Relation(entries, Grid((3,)), Grid((orders,))), Vector(b.groupBy("idx").agg(F.sum("val").alias("val")), Grid((orders,))), list(norms)
