"""Driver-side special functions: Bessel functions, blobs, B-splines, lookup tables, statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from tomolith.errors import InvalidArgumentError


def bessel_i(order: int, x: np.ndarray | float) -> np.ndarray:
    """Modified Bessel function of the first kind and integer order, by its power series."""
    x = np.asarray(x, float)
    half = x / 2
    term = half**order / math.factorial(order)
    total = term.copy()
    for k in range(1, 500):
        term = term * half * half / (k * (k + order))
        total = total + term
        if np.all(np.abs(term) <= 1e-17 * np.abs(total)):
            break
    return total


def blob(r: np.ndarray, radius: float, alpha: float, order: int) -> np.ndarray:
    """Kaiser-Bessel blob at distance r from its centre."""
    w = 1 - (np.asarray(r, float) / radius) ** 2
    arg = np.sqrt(np.maximum(w, 0))
    return np.where(w >= 0, bessel_i(order, alpha * arg) / bessel_i(order, alpha) * arg**order, 0.0)


def blob_projected(s: np.ndarray, radius: float = 2.0, alpha: float = 10.83, order: int = 2) -> np.ndarray:
    """Integral of a blob along a line at distance s: the half-integer Bessel function is elementary."""
    s = np.asarray(s, float)
    w = 1 - (s / radius) ** 2
    inside = w > 1e-10
    root = np.sqrt(np.where(inside, w, 1.0))
    z = alpha * root
    if order == 0:
        shape = np.sinh(z)
    elif order == 1:
        shape = root * (np.cosh(z) - np.sinh(z) / z)
    elif order == 2:
        shape = root**2 * ((3 / z**2 + 1) * np.sinh(z) - 3 / z * np.cosh(z))
    else:
        raise InvalidArgumentError("blobs are projected for orders 0 to 2")
    return np.where(inside, 2 * radius / alpha * shape / bessel_i(order, alpha), 0.0)


def blob_derivative_projected(s: np.ndarray, radius: float = 2.0, alpha: float = 10.83, order: int = 2) -> np.ndarray:
    return np.asarray(s, float) * blob_gradient_projected(s, radius, alpha, order)


def blob_gradient_projected(s: np.ndarray, radius: float = 2.0, alpha: float = 10.83, order: int = 2) -> np.ndarray:
    """The projected derivative divided by s (finite at 0), the factor of the direction vector in 3-D."""
    w = 1 - (np.asarray(s, float) / radius) ** 2
    inside = w > 1e-10
    z = alpha * np.sqrt(np.where(inside, w, 1.0))
    if order == 1:
        shape = np.sinh(z) / radius
    elif order == 2:
        shape = (np.cosh(z) * z - np.sinh(z)) / (alpha * radius)
    else:
        raise InvalidArgumentError("blob derivatives exist for orders 1 and 2")
    return np.where(inside, -2 * shape / bessel_i(order, alpha), 0.0)


def bspline(x: np.ndarray, order: int) -> np.ndarray:
    """Centred cardinal B-spline of a degree, as a sum of truncated powers."""
    t = np.asarray(x, float)[..., None] + (order + 1) / 2 - np.arange(order + 2)
    weight = np.array([(-1) ** n * math.comb(order + 1, n) for n in range(order + 2)]) / math.factorial(order)
    return (np.where(t > 0, t, 0.0) ** order * (t > 0) * weight).sum(-1)


def bspline_derivative(x: np.ndarray, order: int) -> np.ndarray:
    x = np.asarray(x, float)
    return bspline(x + 0.5, order - 1) - bspline(x - 0.5, order - 1)


def bspline_nd(x: np.ndarray, order: int) -> np.ndarray:
    """Product over the last axis."""
    return bspline(x, order).prod(-1)


def bspline_projected(s: np.ndarray, order: int, dim: int) -> np.ndarray:
    """Approximate line integral: the spline at s, at the centre in the other dim - 2 directions."""
    return bspline(s, order) * bspline(np.zeros(1), order)[0] ** max(dim - 2, 0)


def bspline_derivative_projected(s: np.ndarray, order: int, dim: int) -> np.ndarray:
    return bspline_derivative(s, order) * bspline(np.zeros(1), order)[0] ** max(dim - 2, 0)


class Lut:
    """A radial function sampled at n points of [0, support], linear in between, 0 outside."""

    def __init__(self, f: Callable[[np.ndarray], np.ndarray], support: float, n: int = 100):
        self.support = float(support)
        self.values = np.asarray(f(np.linspace(0, support, n)), float)

    def __call__(self, distance: np.ndarray) -> np.ndarray:
        d = np.abs(np.asarray(distance, float))
        at = np.minimum(d / self.support * (len(self.values) - 1), len(self.values) - 1)
        low = np.minimum(at.astype(np.int64), len(self.values) - 2)
        value = self.values[low] + (self.values[low + 1] - self.values[low]) * (at - low)
        return np.where(d <= self.support, value, 0.0)


# Two-sided 95 % points of the t distribution for 0 to 29 degrees of freedom (0 for none).
T_95 = (
    0.0, 12.70620, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157,
    2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024,
    2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230,
)


def mean_stddev(values: Sequence[float]) -> tuple[float, float]:
    v = np.asarray(values, float)
    return float(v.mean()), float(v.std())


def confidence_interval_95(n: int, mean: float, stddev: float) -> tuple[float, float]:
    c = 1.96 if n > len(T_95) else T_95[n - 1]
    return mean - c * stddev, mean + c * stddev
