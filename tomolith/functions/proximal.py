"""Proximal operators: apply(v, t). Any object with such a method serves as well."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions import columns as C
from tomolith.plans.descriptor import Blocks, Grid
from tomolith.plans.vector import Vector, concatenate, lincomb, small


class ProximalOperator(Protocol):
    def apply(self, v: Vector, t: float) -> Vector: ...


def prox_apply(p: ProximalOperator, v: Vector, t: float) -> Vector:
    if t <= 0:
        raise InvalidArgumentError("the threshold must be positive")
    return p.apply(v, t)


class ProximalIdentity:
    def apply(self, v: Vector, t: float) -> Vector:
        return v


class ProximalL1:
    """Soft thresholding by t * sigma."""

    def __init__(self, sigma: float = 1.0):
        self.sigma = sigma

    def apply(self, v: Vector, t: float) -> Vector:
        cut = float(t * self.sigma)
        return v.map(lambda x: C.sign(x) * F.greatest(F.abs(x) - cut, F.lit(0.0)))


class ProximalL0:
    """Hard thresholding: what does not exceed t becomes 0."""

    def apply(self, v: Vector, t: float) -> Vector:
        return v.map(lambda x: F.when(F.abs(x) > float(t), x).otherwise(0.0))


class ProximalL2Squared:
    def __init__(self, b: Vector | None = None, sigma: float = 1.0):
        self.b, self.sigma = b, sigma

    def apply(self, v: Vector, t: float) -> Vector:
        s = t * self.sigma
        return v * (1 / (1 + s)) if self.b is None else lincomb(1 / (1 + s), v, s / (1 + s), self.b)


class ProximalHuber:
    def __init__(self, delta: float = 1e-4):
        if delta <= 0:
            raise InvalidArgumentError("delta must be positive")
        self.delta = delta

    def apply(self, v: Vector, t: float) -> Vector:
        return v * (1 - t / (max(v.l2(), t) + self.delta))


class ProximalMixedL21Norm:
    """Shrinks the norms over identical blocks, point by point; one plan, no driver scalar."""

    def __init__(self, sigma: float = 1.0):
        self.sigma = sigma

    def apply(self, v: Vector, t: float) -> Vector:
        cut = float(t * self.sigma)
        norm = v.pl2()
        n = norm.size
        right = small(norm.df.select(F.col("idx").alias("_p"), F.col("val").alias("_n")), n)
        factor = 1 - cut / F.greatest(F.col("_n"), F.lit(cut))
        return Vector(v.df.join(right, F.col("idx") % n == F.col("_p")).select("idx", (F.col("val") * factor).alias("val")), v.desc)


class ProximalBoxConstraint:
    """Projection on [low, high]; a bound that is None does not bind."""

    def __init__(self, low: float | None = None, high: float | None = None):
        self.low, self.high = low, high

    def apply(self, v: Vector, t: float) -> Vector:
        if self.low is not None:
            v = v.maximum(self.low)
        return v if self.high is None else v.minimum(self.high)


class CombinedProximal:
    """A proximal operator for each block, with a common t."""

    def __init__(self, *parts: ProximalOperator):
        self.parts = [p for x in parts for p in (x if isinstance(x, Sequence) else (x,))]

    def add(self, p: ProximalOperator) -> CombinedProximal:
        return CombinedProximal(*self.parts, p)

    def apply(self, v: Vector, t: float) -> Vector:
        if not isinstance(v.desc, Blocks) or v.blocks != len(self.parts):
            raise InvalidArgumentError("as many blocks as proximal operators are needed")
        done = [p.apply(v.block(i), t) for i, p in enumerate(self.parts)]
        return concatenate(*[d.view_as(Grid((d.size,))) for d in done]).view_as(v.desc)
