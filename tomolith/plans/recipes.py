"""Whole reconstructions built from the parts: preprocessing, priors, filtered back-projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tomolith.functions import columns as C
from tomolith.functions.functionals import FunctionalScalarMul, FunctionalSum, L2Reg, L2Squared, LeastSquares
from tomolith.functions.proximal import ProximalBoxConstraint, ProximalL1, ProximalOperator
from tomolith.operators.basic import FiniteDifferences
from tomolith.operators.fourier import fft, ifft
from tomolith.operators.linear import LinearOperator, Relation

from .descriptor import Grid
from .solvers import ADMML2, APGD, FGM, OGM
from .vector import Vector


def background_mean(v: Vector, lower: tuple[int, int], upper: tuple[int, int]) -> float:
    """Mean over a window of the first two dimensions."""
    d, i = v.desc, F.col("idx")
    inside = F.lit(True)
    for k in (0, 1):
        inside = inside & (d.column(i, k) >= lower[k]) & (d.column(i, k) < upper[k])
    return v.df.where(inside).agg(F.avg("val")).first()[0]


def rebin(v: Vector, factor: int) -> Vector:
    """Means over blocks of factor x factor of the first two dimensions."""
    d = v.desc
    out = Grid((d.shape[0] // factor, d.shape[1] // factor, *d.shape[2:]), tuple(s * factor if k < 2 else s for k, s in enumerate(d.spacing)))
    at = [d.column(F.col("idx"), k) for k in range(d.ndim)]
    at[:2] = [F.floor(c / factor) for c in at[:2]]
    index = sum((c * s for c, s in zip(at, out.strides, strict=True)), F.lit(0).cast("long"))
    inside = (at[0] < out.shape[0]) & (at[1] < out.shape[1])
    return Vector(v.df.where(inside).groupBy(index.alias("idx")).agg(F.avg("val").alias("val")), out)


def absorption(v: Vector, i0: float) -> Vector:
    """-log(intensity / background)."""
    return v.map(lambda x: -C.ln0(x / i0))


def beam_hardening(v: Vector, coefficients: tuple[float, ...]) -> Vector:
    """A polynomial without constant term, lowest power first."""
    return v.map(lambda x: sum((float(c) * F.pow(x, k + 1) for k, c in enumerate(coefficients)), F.lit(0.0)))


def non_negative_least_squares(a: LinearOperator, b: Vector, n: int) -> Vector:
    return APGD(a, b, ProximalBoxConstraint(0.0)).solve(n)


def lasso(a: LinearOperator, b: Vector, weight: float, n: int) -> Vector:
    return APGD(a, b, ProximalL1(weight)).solve(n)


def total_variation(a: LinearOperator, b: Vector, weight: float, tau: float, n: int) -> Vector:
    return ADMML2(a, b, FiniteDifferences(a.domain), ProximalL1(weight), tau).solve(n)


def plug_and_play(a: LinearOperator, b: Vector, prior: ProximalOperator, identity: LinearOperator, tau: float, n: int) -> Vector:
    """ADMM with any denoiser that has apply(v, t) as its prior."""
    return ADMML2(a, b, identity, prior, tau).solve(n)


def tikhonov(a: LinearOperator, b: Vector, weight: float, n: int, reg: LinearOperator | None = None, optimised: bool = False) -> Vector:
    term = L2Squared(a.domain) if reg is None else L2Reg(a=reg)
    f = FunctionalSum(LeastSquares(a, b), FunctionalScalarMul(weight, term))
    return (OGM if optimised else FGM)(f, b.spark).solve(n)


def ramp_filtered(sinogram: Vector) -> Vector:
    """Each projection, padded with zeros to a power of two, times |frequency|."""
    d = sinogram.desc
    n, poses = d.shape[0], int(np.prod(d.shape[1:]))
    wide = 1 << (2 * n - 1).bit_length()
    line = Grid((wide,))
    from tomolith.operators.fourier import BACKWARD, transform

    rows = sinogram.df.select((F.floor(F.col("idx") / n) * wide + F.col("idx") % n).cast("long").alias("idx"), F.col("val").alias("re"), F.lit(0.0).alias("im"))
    pad = sinogram.spark.range(wide * poses).where(F.col("id") % wide >= n).select(F.col("id").alias("idx"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    hat = transform(rows.unionByName(pad), line, BACKWARD, False)
    k = F.col("idx") % wide
    ramp = 2 * F.least(k, wide - k) / wide
    hat = hat.select("idx", (F.col("re") * ramp).alias("re"), (F.col("im") * ramp).alias("im"))
    back = transform(hat, line, BACKWARD, True).where(F.col("idx") % wide < n)
    return Vector(back.select((F.floor(F.col("idx") / wide) * n + F.col("idx") % wide).cast("long").alias("idx"), F.col("re").alias("val")), d)


def filtered_back_projection(a: Relation, sinogram: Vector) -> Vector:
    return a.apply_adjoint(ramp_filtered(sinogram)) * (np.pi / 2 / max(1, sinogram.desc.shape[-1]))


__all__ = ["absorption", "background_mean", "beam_hardening", "fft", "filtered_back_projection", "ifft", "lasso", "non_negative_least_squares", "plug_and_play", "ramp_filtered", "rebin", "tikhonov", "total_variation"]
