from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolith import errors
from tomolith.operators import linear as OL
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector
from tomolith.streaming.frames import reconstruct_frames, reconstruct_stream

RNG = np.random.default_rng(3)


def test_a_stream_of_frames_goes_on_after_a_restart(spark, tmp_path):
    m = RNG.normal(size=(7, 4))
    rows = [(i, j, float(m[i, j])) for i in range(7) for j in range(4)]
    a = OL.Relation(spark.createDataFrame(rows, "row long, col long, w double").persist(), Grid((4,)), Grid((7,)))
    b = [Vector.from_array(spark, m @ (x * np.array([1.0, 0.0, 2.0, 3.0]))) for x in (1.0, 1.5, 2.0)]
    b[1] = Vector.from_array(spark, np.where(np.arange(7) == 5, 0.0, b[1].local))
    places = [str(tmp_path / n) for n in ("in", "out", "state")]

    def arrive(k: int) -> None:
        part = b[k].df if k != 1 else b[k].df.where("idx <> 5")  # a missing measurement counts as 0
        part.select(F.lit(k).cast("long").alias("frame"), "idx", "val").coalesce(1).write.mode("append").parquet(places[0])

    def run() -> None:
        frames = spark.readStream.schema("frame long, idx long, val double").parquet(places[0])
        reconstruct_stream(a, frames, places[1], places[2], 3, once=True).awaitTermination()

    arrive(0)
    arrive(1)
    run()
    arrive(2)
    run()
    want = [v.to_array().ravel() for v in reconstruct_frames(a, b, 3)]
    got = spark.read.parquet(places[1])
    for k in range(3):
        part = got.where(F.col("frame") == k).orderBy("idx").toPandas()["val"].to_numpy()
        assert np.allclose(part, want[k], atol=1e-9), k
    assert got.count() == 12


def test_errors_are_of_this_library_and_builtin(spark):
    v = Vector.from_array(spark, np.arange(4.0))
    for call, kind, builtin in ((lambda: v + Vector.from_array(spark, np.arange(3.0)), errors.InvalidArgumentError, ValueError), (lambda: v[9], errors.OutOfRangeError, IndexError), (lambda: Grid((0,)), errors.InvalidArgumentError, ValueError)):
        with pytest.raises(kind) as caught:
            call()
        assert isinstance(caught.value, errors.Error) and isinstance(caught.value, builtin)
