"""Fourier and shearlet transforms.

The n-dimensional transform is separable: for each dimension the lines are gathered by
their other coordinates and transformed as a batch in NumPy; lines are the unit of work, so
a task holds a few lines and never the whole volume.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import BadCastError, InvalidArgumentError
from tomolith.functions import columns as C
from tomolith.plans.descriptor import Grid, identical_blocks
from tomolith.plans.vector import Vector, small

from .linear import LinearOperator

FORWARD, ORTHO, BACKWARD = "forward", "ortho", "backward"


def transform(df: DataFrame, grid: Grid, norm: str, inverse: bool) -> DataFrame:
    """Transforms (idx, re, im) along all dimensions; idx may count several grids one after the other."""
    if norm not in (FORWARD, ORTHO, BACKWARD):
        raise InvalidArgumentError("norm is forward, ortho or backward")
    for n, stride in zip(grid.shape, grid.strides, strict=True):
        if n == 1:
            continue

        def lines(batches: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            """Rows come sorted by line; whole lines are cut off and transformed together."""
            held = pd.DataFrame()
            for batch in batches:
                held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
                full = len(held) // n * n
                if full:
                    yield done(held.iloc[:full], n)
                    held = held.iloc[full:]
            if len(held):
                raise InvalidArgumentError("a line is incomplete: the vector is not dense")

        def done(part: pd.DataFrame, n: int) -> pd.DataFrame:
            z = (part["re"].to_numpy() + 1j * part["im"].to_numpy()).reshape(-1, n)
            z = (np.fft.ifft if inverse else np.fft.fft)(z, axis=1, norm=norm).ravel()
            return pd.DataFrame({"idx": part["idx"].to_numpy(), "re": z.real, "im": z.imag})

        at = (F.col("idx") - F.col("idx") % stride) / stride
        line = F.col("idx") - (at.cast("long") % n) * stride
        keyed = df.withColumn("_line", line).repartition("_line").sortWithinPartitions("_line", "idx")
        df = keyed.select("idx", "re", "im").mapInPandas(lines, "idx long, re double, im double")
    return df


def _flat(v: Vector) -> DataFrame:
    return v.as_complex().df.select("idx", F.col("val.re").alias("re"), F.col("val.im").alias("im"))


def _vector(df: DataFrame, grid: Grid) -> Vector:
    return Vector(df.select("idx", C.complex_of(F.col("re"), F.col("im")).alias("val")), grid)


def fft(v: Vector, norm: str = BACKWARD) -> Vector:
    return _vector(transform(_flat(v), v.desc, norm, False), v.desc)


def ifft(v: Vector, norm: str = BACKWARD) -> Vector:
    return _vector(transform(_flat(v), v.desc, norm, True), v.desc)


class FourierTransform(LinearOperator):
    """The discrete Fourier transform; what counts as its adjoint is the inverse with the same norm
    (the true adjoint for the ortho norm)."""

    def __init__(self, grid: Grid, norm: str = BACKWARD, inverse: bool = False):
        self.domain = self.range = grid
        self.norm, self.inverse = norm, inverse

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        if not x.is_complex:
            raise BadCastError("the Fourier transform takes complex vectors")
        return (ifft if self.inverse else fft)(x, self.norm)

    def adjoint(self) -> LinearOperator:
        return FourierTransform(self.domain, self.norm, not self.inverse)


class ShearletTransform(LinearOperator):
    """Cone-adapted band-limited shearlets of a 2-D image: one filtered image for each layer.

    Layers: 0 is the low pass; scale j starts at layer 2**(j+2) - 3 and holds 2**(j+2) layers.
    The spectra are a relation (idx, s) of all layers, computed by column expressions.
    """

    def __init__(self, grid: Grid, scales: int | None = None, spectra: DataFrame | None = None):
        if grid.ndim != 2:
            raise InvalidArgumentError("shearlets are two-dimensional")
        self.scales = int(math.log2(max(grid.shape)) / 2) if scales is None else scales
        self.layers = 2 ** (self.scales + 2) - 3
        self.domain, self.range = grid, identical_blocks(grid, self.layers)
        self._spectra = spectra

    def _kinds(self) -> list[tuple[int, str, int, int]]:
        """(layer, kind, scale, shear) of all layers but the first."""
        out = []
        for j in range(self.scales):
            first, wide, around = 2 ** (j + 2) - 3, 2**j, 2 ** (j + 2)
            out.append((first + wide, "seam", j, -wide))
            for step, k in enumerate(range(-wide + 1, wide), 1):
                out.append((first + (wide - step) % around, "wide", j, k))
                out.append((first + wide + step, "tall", j, k))
            out.append((first + 3 * wide, "seam", j, wide))
        return out

    def spectra(self, spark: SparkSession) -> DataFrame:
        if self._spectra is None:
            w, h = self.domain.shape
            signed = lambda c, n: F.when(c < n - n // 2, c).otherwise(c - n)
            base = spark.range(self.domain.size).select(F.col("id").alias("i"), signed(F.col("id") % w, w).cast("double").alias("w"), signed(self.domain.column(F.col("id"), 1), h).cast("double").alias("h"))
            low = base.select(F.col("i").alias("idx"), C.shearlet_low(F.col("w"), F.col("h")).alias("s"))
            kinds = self._kinds()
            if kinds:
                layers = spark.createDataFrame(kinds, "layer int, kind string, j int, k int")
                rows = base.crossJoin(small(layers, len(kinds)))  # a table of shapes, 2**(scales + 2) rows
                flat = F.abs("h") <= F.abs("w")
                a, b = F.when(flat, F.col("w")).otherwise(F.col("h")), F.when(flat, F.col("h")).otherwise(F.col("w"))
                four, two = F.pow(F.lit(4.0), -F.col("j")), F.pow(F.lit(2.0), -F.col("j"))
                value = C.shearlet_cone(four * a, four * F.col("k") * a + two * b)
                shown = (F.col("kind") == "seam") | ((F.col("kind") == "wide") & flat) | ((F.col("kind") == "tall") & ~flat)
                cones = rows.select((F.col("layer") * self.domain.size + F.col("i")).alias("idx"), F.when(shown, value).otherwise(0.0).alias("s"))
                low = low.unionByName(cones)
            self._spectra = low.persist()
        return self._spectra

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        n = self.domain.size
        hat = small(_flat(fft(x)).select(F.col("idx").alias("i"), "re", "im"), n)
        rows = self.spectra(x.spark).join(hat, F.col("idx") % n == F.col("i")).select("idx", (F.col("re") * F.col("s")).alias("re"), (F.col("im") * F.col("s")).alias("im"))
        out = _vector(transform(rows, self.domain, BACKWARD, True), self.range)
        return out if x.is_complex else out.real()

    def apply_adjoint(self, y: Vector) -> Vector:
        n = self.domain.size
        hat = transform(_flat(y), self.domain, BACKWARD, False)
        rows = hat.join(self.spectra(y.spark), "idx").groupBy((F.col("idx") % n).alias("idx")).agg(F.sum(F.col("re") * F.col("s")).alias("re"), F.sum(F.col("im") * F.col("s")).alias("im"))
        out = _vector(transform(rows, self.domain, BACKWARD, True), self.domain)
        return out if y.is_complex else out.real()

    def adjoint(self) -> LinearOperator:
        return _Adjoint(self)


class _Adjoint(LinearOperator):
    def __init__(self, a: LinearOperator):
        self.a, self.domain, self.range = a, a.range, a.domain

    def apply(self, x: Vector) -> Vector:
        return self.a.apply_adjoint(x)

    def adjoint(self) -> LinearOperator:
        return self.a
