"""Objective functionals: a value (one aggregate), a gradient (a vector) and a Hessian (an operator)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions import columns as C
from tomolith.operators.linear import Identity, LinearOperator, Product, Scaled, Scaling, Sum
from tomolith.plans.descriptor import Blocks, Grid, best_block
from tomolith.plans.vector import Vector, concatenate, lincomb

INF = float("inf")


class NotDifferentiable(TypeError):
    """Raised where a gradient or Hessian does not exist."""


class Functional:
    domain: Grid

    def evaluate(self, x: Vector) -> float:
        raise NotImplementedError

    def gradient(self, x: Vector) -> Vector:
        raise NotDifferentiable(type(self).__name__)

    def hessian(self, x: Vector) -> LinearOperator:
        raise NotDifferentiable(type(self).__name__)

    def __call__(self, x: Vector) -> float:
        if x.size != self.domain.size:
            raise InvalidArgumentError("sizes differ")
        return self.evaluate(x)

    def __add__(self, other: Functional) -> Functional:
        return FunctionalSum(self, other)

    def __rmul__(self, s: float) -> Functional:
        return FunctionalScalarMul(float(s), self)

    __mul__ = __rmul__


class FunctionalSum(Functional):
    def __init__(self, f: Functional, g: Functional):
        if f.domain.size != g.domain.size:
            raise InvalidArgumentError("sizes differ")
        self.f, self.g, self.domain = f, g, f.domain

    def evaluate(self, x: Vector) -> float:
        return self.f.evaluate(x) + self.g.evaluate(x)

    def gradient(self, x: Vector) -> Vector:
        return self.f.gradient(x) + self.g.gradient(x)

    def hessian(self, x: Vector) -> LinearOperator:
        return Sum(self.f.hessian(x), self.g.hessian(x))


class FunctionalScalarMul(Functional):
    def __init__(self, s: float, f: Functional):
        self.s, self.f, self.domain = s, f, f.domain

    def evaluate(self, x: Vector) -> float:
        return self.s * self.f.evaluate(x)

    def gradient(self, x: Vector) -> Vector:
        return self.f.gradient(x) * self.s

    def hessian(self, x: Vector) -> LinearOperator:
        return Scaled(self.s, self.f.hessian(x))


class _OnGrid(Functional):
    def __init__(self, domain: Grid):
        self.domain = domain


class L1Norm(_OnGrid):
    def evaluate(self, x: Vector) -> float:
        return x.l1()


class WeightedL1Norm(Functional):
    def __init__(self, weights: Vector):
        if weights.min() < 0:
            raise InvalidArgumentError("weights must not be negative")
        self.weights, self.domain = weights, weights.desc

    def evaluate(self, x: Vector) -> float:
        return (x.abs() * self.weights).sum()


class LInfNorm(_OnGrid):
    def evaluate(self, x: Vector) -> float:
        return x.linf()


class L0PseudoNorm(_OnGrid):
    def evaluate(self, x: Vector) -> float:
        return x.l0()


class L2Squared(Functional):
    """Half the squared distance to b (or to 0)."""

    def __init__(self, domain: Grid, b: Vector | None = None):
        self.domain, self.b = domain, b

    def _residual(self, x: Vector) -> Vector:
        return x if self.b is None else x - self.b

    def evaluate(self, x: Vector) -> float:
        return 0.5 * self._residual(x).squared_l2()

    def gradient(self, x: Vector) -> Vector:
        return self._residual(x)

    def hessian(self, x: Vector) -> LinearOperator:
        return Identity(self.domain)


class LinearResidual:
    """x -> Ax - b, either part optional."""

    def __init__(self, a: LinearOperator | None = None, b: Vector | None = None, domain: Grid | None = None):
        if a is not None and b is not None and a.range.size != b.size:
            raise InvalidArgumentError("sizes differ")
        self.a, self.b = a, b
        self.domain = a.domain if a is not None else b.desc if b is not None else domain

    def evaluate(self, x: Vector) -> Vector:
        r = x if self.a is None else self.a.apply(x)
        return r if self.b is None else r - self.b

    __call__ = evaluate

    def jacobian(self, x: Vector | None = None) -> LinearOperator:
        return Identity(self.domain) if self.a is None else self.a


class L2Reg(Functional):
    """Half the squared norm of Ax (of x without an operator)."""

    def __init__(self, domain: Grid | None = None, a: LinearOperator | None = None):
        self.a, self.domain = a, a.domain if a is not None else domain

    def evaluate(self, x: Vector) -> float:
        return 0.5 * (x if self.a is None else self.a.apply(x)).squared_l2()

    def gradient(self, x: Vector) -> Vector:
        return x if self.a is None else self.a.apply_adjoint(self.a.apply(x))

    def hessian(self, x: Vector) -> LinearOperator:
        return Identity(self.domain) if self.a is None else Product(self.a.adjoint(), self.a)


class WeightedL2Squared(Functional):
    def __init__(self, weights: Vector):
        self.weights, self.domain = weights, weights.desc

    def evaluate(self, x: Vector) -> float:
        return 0.5 * x.zip(self.weights, lambda v, w: w * v * v).sum()

    def gradient(self, x: Vector) -> Vector:
        return x * self.weights

    def hessian(self, x: Vector) -> LinearOperator:
        return Scaling(self.domain, self.weights)


class LeastSquares(Functional):
    def __init__(self, a: LinearOperator, b: Vector):
        if a.range.size != b.size:
            raise InvalidArgumentError("sizes differ")
        self.a, self.b, self.domain = a, b, a.domain

    def evaluate(self, x: Vector) -> float:
        return 0.5 * (self.a.apply(x) - self.b).squared_l2()

    def gradient(self, x: Vector) -> Vector:
        return self.a.apply_adjoint(self.a.apply(x) - self.b)

    def hessian(self, x: Vector) -> LinearOperator:
        return Product(self.a.adjoint(), self.a)


class WeightedLeastSquares(Functional):
    """Half of (Ax - b) W (Ax - b) with a diagonal W on the range of A."""

    def __init__(self, a: LinearOperator, b: Vector, weights: Vector):
        if not a.range.size == b.size == weights.size:
            raise InvalidArgumentError("sizes differ")
        self.a, self.b, self.weights, self.domain = a, b, weights, a.domain

    def evaluate(self, x: Vector) -> float:
        return 0.5 * (self.a.apply(x) - self.b).zip(self.weights, lambda r, w: w * r * r).sum()

    def gradient(self, x: Vector) -> Vector:
        return self.a.apply_adjoint((self.a.apply(x) - self.b) * self.weights)

    def hessian(self, x: Vector) -> LinearOperator:
        return Product(self.a.adjoint(), Product(Scaling(self.a.range, self.weights), self.a))


class Huber(Functional):
    def __init__(self, domain: Grid, delta: float = 1e-6):
        if delta <= 0:
            raise InvalidArgumentError("delta must be positive")
        self.domain, self.delta = domain, float(delta)

    def evaluate(self, x: Vector) -> float:
        d = self.delta
        return x.map(lambda v: F.when(F.abs(v) <= d, 0.5 * v * v).otherwise(d * (F.abs(v) - 0.5 * d))).sum()

    def gradient(self, x: Vector) -> Vector:
        return x.clip(-self.delta, self.delta)

    def hessian(self, x: Vector) -> LinearOperator:
        return Scaling(self.domain, x.map(lambda v: F.when(F.abs(v) <= self.delta, 1.0).otherwise(0.0)))


class PseudoHuber(Functional):
    def __init__(self, domain: Grid, delta: float = 1.0):
        if delta <= 0:
            raise InvalidArgumentError("delta must be positive")
        self.domain, self.delta = domain, float(delta)

    def _s(self, v: Column) -> Column:
        return 1 + (v / self.delta) * (v / self.delta)

    def evaluate(self, x: Vector) -> float:
        return x.map(lambda v: self.delta**2 * (F.sqrt(self._s(v)) - 1)).sum()

    def gradient(self, x: Vector) -> Vector:
        return x.map(lambda v: v / F.sqrt(self._s(v)))

    def hessian(self, x: Vector) -> LinearOperator:
        return Scaling(self.domain, x.map(lambda v: 1 / (self._s(v) * F.sqrt(self._s(v)))))


class Quadric(Functional):
    """Half of x A x, minus x b."""

    def __init__(self, a: LinearOperator | None = None, b: Vector | None = None, domain: Grid | None = None):
        self.a, self.b = a, b
        self.domain = a.domain if a is not None else b.desc if b is not None else domain

    def _ax(self, x: Vector) -> Vector:
        return x if self.a is None else self.a.apply(x)

    def evaluate(self, x: Vector) -> float:
        ax = self._ax(x)
        if self.b is None:
            return 0.5 * x.dot(ax)
        return x.dot(lincomb(0.5, ax, -1.0, self.b))

    def gradient(self, x: Vector) -> Vector:
        return self._ax(x) if self.b is None else self._ax(x) - self.b

    def hessian(self, x: Vector) -> LinearOperator:
        return Identity(self.domain) if self.a is None else self.a


class EmissionLogLikelihood(Functional):
    """Sum of t - y ln t with t = Ax + r."""

    def __init__(self, a: LinearOperator, y: Vector, r: Vector | None = None):
        self.a, self.y, self.r, self.domain = a, y, r, a.domain

    def _t(self, x: Vector) -> Vector:
        t = self.a.apply(x)
        return t if self.r is None else t + self.r

    def evaluate(self, x: Vector) -> float:
        return self._t(x).zip(self.y, lambda t, y: t - y * C.ln0(t)).sum()

    def gradient(self, x: Vector) -> Vector:
        return self.a.apply_adjoint(self._t(x).zip(self.y, lambda t, y: 1 - C.div0(y, t)))

    def hessian(self, x: Vector) -> LinearOperator:
        d = self._t(x).zip(self.y, lambda t, y: C.div0(y, t * t))
        return Product(self.a.adjoint(), Product(Scaling(self.a.range, d), self.a))


class TransmissionLogLikelihood(Functional):
    """Sum of t - y ln t with t = b exp(-Ax) + r."""

    def __init__(self, a: LinearOperator, y: Vector, b: Vector, r: Vector | None = None):
        self.a, self.y, self.b, self.r, self.domain = a, y, b, r, a.domain

    def _s(self, x: Vector) -> Vector:
        return self.a.apply(x).zip(self.b, lambda v, b: b * F.exp(-v))

    def evaluate(self, x: Vector) -> float:
        t = self._s(x)
        t = t if self.r is None else t + self.r
        return t.zip(self.y, lambda t, y: t - y * C.ln0(t)).sum()

    def gradient(self, x: Vector) -> Vector:
        s = self._s(x)
        if self.r is None:
            return self.a.apply_adjoint(s.zip(self.y, lambda s, y: y - s))
        ratio = self.y.zip(s + self.r, lambda y, t: C.div0(y, t)).saved()
        return self.a.apply_adjoint(s.zip(ratio, lambda s, q: q * s - s))

    def hessian(self, x: Vector) -> LinearOperator:
        s = self._s(x)
        if self.r is not None:
            factor = self.y.zip(self.r, lambda y, r: y * r).zip(s + self.r, lambda yr, t: 1 + 0 * yr - C.div0(yr, t * t))
            s = s * factor
        return Product(self.a.adjoint(), Product(Scaling(self.a.range, s), self.a))


class ConstantFunctional(Functional):
    def __init__(self, domain: Grid, c: float):
        self.domain, self.c = domain, float(c)

    def evaluate(self, x: Vector) -> float:
        return self.c

    def gradient(self, x: Vector) -> Vector:
        return x.filled(0.0)


class ZeroFunctional(ConstantFunctional):
    def __init__(self, domain: Grid):
        super().__init__(domain, 0.0)


class SeparableSum(Functional):
    """Sum of functionals, each of its block."""

    def __init__(self, *parts: Functional):
        self.parts = [p for x in parts for p in (x if isinstance(x, (list, tuple)) else (x,))]
        self.domain = best_block([p.domain for p in self.parts])

    def _blocks(self, x: Vector) -> list[Vector]:
        if not isinstance(self.domain, Blocks) or x.size != self.domain.size:
            raise InvalidArgumentError("a block vector is needed")
        x = x.view_as(self.domain)
        return [x.block(i) for i in range(len(self.parts))]

    def evaluate(self, x: Vector) -> float:
        return sum(p.evaluate(b) for p, b in zip(self.parts, self._blocks(x), strict=True))

    def gradient(self, x: Vector) -> Vector:
        flat = [p.gradient(b).view_as(Grid((b.size,))) for p, b in zip(self.parts, self._blocks(x), strict=True)]
        return concatenate(*flat).view_as(self.domain)


class IndicatorBox(Functional):
    """0 inside [low, high], infinite outside."""

    def __init__(self, domain: Grid, low: float = -INF, high: float = INF):
        self.domain, self.low, self.high = domain, low, high

    def evaluate(self, x: Vector) -> float:
        v = F.col("val")
        out = x.df.agg(F.bool_or((v < self.low) | (v > self.high))).first()[0]
        return INF if out else 0.0


class IndicatorNonNegativity(IndicatorBox):
    def __init__(self, domain: Grid):
        super().__init__(domain, 0.0)


class Constraint:
    """Ax + Bz = c, as data."""

    def __init__(self, a: LinearOperator, b: LinearOperator, c: Vector):
        if not a.range.size == b.range.size == c.size:
            raise InvalidArgumentError("sizes differ")
        self.a, self.b, self.c = a, b, c


def separable(parts: Sequence[Functional]) -> SeparableSum:
    return SeparableSum(*parts)
