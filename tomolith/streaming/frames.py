"""Time series of measurements: every frame solved with the same operator, one after the other.

``reconstruct_frames`` takes frames as they are; ``reconstruct_stream`` reads them from a
stream and writes each solution to a folder of its own, which survives a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomolith.functions.proximal import ProximalBoxConstraint
from tomolith.operators.linear import LinearOperator
from tomolith.plans.descriptor import Grid
from tomolith.plans.solvers import APGD, Solver
from tomolith.plans.vector import Vector

Make = Callable[[LinearOperator, Vector], Solver]


def _non_negative(a: LinearOperator, b: Vector) -> Solver:
    return APGD(a, b, ProximalBoxConstraint(0.0))


def reconstruct_frames(a: LinearOperator, frames: Iterable[Vector], iterations: int, solver: Make | None = None, warm_start: bool = True) -> Iterator[Vector]:
    """Yields the reconstruction of each frame; a frame starts from the one before unless told otherwise."""
    make, x = solver or _non_negative, None
    for b in frames:
        x = make(a, b).solve(iterations, x if warm_start else None).saved()
        yield x


def _written(spark: SparkSession, folder: str, frame: int, grid: Grid) -> Vector | None:
    """The solution of the latest frame before ``frame`` in ``folder``."""
    try:
        done = spark.read.schema("idx long, val double, frame long").parquet(folder).where(F.col("frame") < frame)
    except AnalysisException:  # nothing is written yet
        return None
    last = done.agg(F.max("frame")).first()[0]
    return None if last is None else Vector(done.where(F.col("frame") == last).select("idx", "val"), grid).saved()


def reconstruct_stream(a: LinearOperator, frames: DataFrame, folder: str, checkpoint: str, iterations: int, solver: Make | None = None, warm_start: bool = True, once: bool = False) -> StreamingQuery:
    """Solves the frames of a stream (frame, idx, val) in order and writes each to ``folder``/frame=...

    A frame must arrive within one micro-batch (a file for each frame, say); measurements that it lacks count as 0,
    repeated ones add up. A micro-batch that is run again writes the same folders again. ``once`` ends with what is there.
    """
    make = solver or _non_negative

    def batch(rows: DataFrame, _: int) -> None:
        spark, rows = rows.sparkSession, rows.persist()
        for frame in [r.frame for r in rows.select("frame").distinct().orderBy("frame").toLocalIterator()]:
            zero = spark.range(a.range.size).select(F.col("id").alias("idx"), F.lit(0.0).alias("val"))
            whole = rows.where(F.col("frame") == frame).select("idx", "val").unionByName(zero).groupBy("idx").agg(F.sum("val").alias("val"))
            start = _written(spark, folder, frame, a.domain) if warm_start else None
            x = make(a, Vector(whole, a.range).saved()).solve(iterations, start)
            x.df.select("idx", "val").write.mode("overwrite").parquet(f"{folder}/frame={frame}")
        rows.unpersist()

    stream = frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
