"""Scalar functions as columns, with IEEE results where Spark would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: Least magnitude that counts as not zero: the spacing of single precision at 1.
EPSILON = 2.0**-23


def div0(a: Column, b: Column) -> Column:
    """a / b as floating-point hardware gives it: +-inf or NaN where b is zero."""
    a, b = F.lit(a), F.lit(b)
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(F.isnan(a) | (a == 0), NAN).otherwise(F.when(a > 0, INF).otherwise(-INF)))


def ln0(a: Column) -> Column:
    """log(a): -inf at zero, NaN below."""
    a = F.lit(a)
    return F.when(a > 0, F.ln(a)).otherwise(F.when(a == 0, -INF).otherwise(NAN))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """NaN passes through."""
    return F.when(F.isnan(x), x).otherwise(F.when(x < low, low).otherwise(F.when(x > high, high).otherwise(x)))


def minimum(x: Column, s: float | Column) -> Column:
    return F.when(x < s, x).otherwise(s)


def maximum(x: Column, s: float | Column) -> Column:
    return F.when(x > s, x).otherwise(s)


def complex_of(re: Column, im: Column | float = 0.0) -> Column:
    return F.struct(F.lit(re).cast("double").alias("re"), F.lit(im).cast("double").alias("im"))


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(F.when(x < 0, -1.0).otherwise(0.0))


def complex_sign(z: Column) -> Column:
    """The sign of the real part, or of the imaginary part where that is zero."""
    return F.when(z["re"] != 0, sign(z["re"])).otherwise(sign(z["im"]))


def factorial(n: Column) -> Column:
    """n! for 0 to 20, else null."""
    return F.factorial(n.cast("int"))


def binom(n: Column, k: Column) -> Column:
    """Binomial coefficients for n up to 20; 0 for k outside 0 to n."""
    inside = (k >= 0) & (k <= n)
    return F.when(inside, (factorial(n) / (factorial(F.when(inside, k)) * factorial(F.when(inside, n - k)))).cast("long")).otherwise(F.lit(0).cast("long"))


def heaviside(x: Column, at_zero: float) -> Column:
    return F.when(x > 0, 1.0).otherwise(F.when(x < 0, 0.0).otherwise(at_zero))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def meyer(x: Column) -> Column:
    """A smooth step from 0 at 0 to 1 at 1, of degree 7."""
    inside = F.pow(x, 4) * (35 - 84 * x + 70 * x * x - 20 * x * x * x)
    return F.when(x < 0, 0.0).otherwise(F.when(x <= 1, inside).otherwise(1.0))


def _bump(w: Column) -> Column:
    a, half_pi = F.abs(w), F.pi() / 2
    return F.when((a >= 1) & (a <= 2), F.sin(half_pi * meyer(a - 1))).otherwise(F.when((a > 2) & (a <= 4), F.cos(half_pi * meyer(a / 2 - 1))).otherwise(0.0))


def shearlet_low(w: Column, h: Column) -> Column:
    """Low-frequency generator on the frequency square."""
    a = F.greatest(F.abs(w), F.abs(h))
    return F.when(a <= 0.5, 1.0).otherwise(F.when(a < 1, F.cos(F.pi() / 2 * meyer(2 * a - 1))).otherwise(0.0))


def shearlet_cone(w: Column, h: Column) -> Column:
    """Band-limited shearlet generator: radial bumps times an angular window of h / w."""
    radial = F.sqrt(F.pow(_bump(2 * w), 2) + F.pow(_bump(w), 2))
    slope = h / F.when(w != 0, w)
    return F.when(w == 0, 0.0).otherwise(radial * F.sqrt(meyer(1 - F.abs(slope))))
