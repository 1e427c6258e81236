"""Iterative solvers: driver loops over plans, with scalars (at most a few a step) on the driver.

Iterates are checkpointed (``Vector.saved``), so plans stay short and a lost executor costs
one step; what no step reads at once (the running solution) is saved every few steps only.
Small iterates (``LOCAL_ROWS``) live on the driver, where their sums and lengths take no job;
of large ones lengths are observed by the job that saves them. All solvers are constructed with their problem and run by ``solve(n, x0=None)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions.functionals import Functional, LeastSquares
from tomolith.functions.proximal import ProximalOperator
from tomolith.operators.basic import Dictionary
from tomolith.operators.linear import BlockOperator, LinearOperator, Product, Scaled

from .descriptor import Grid
from .vector import Vector, concatenate, lincomb

Projection = Callable[[Vector], Vector]


def power_iterations(a: LinearOperator, spark: SparkSession, n: int = 5) -> float:
    """An estimate of the largest eigenvalue of a square operator."""
    if a.domain.size != a.range.size:
        raise InvalidArgumentError("a square operator is needed")
    u = Vector.full(spark, a.domain, 1.0)
    for _ in range(n):
        u, norm = a.apply(u).saved_norm()
        if norm == 0:
            return 0.0
        u = u * (1 / math.sqrt(norm))
    au = a.apply(u)
    if u.local is not None:
        return u.dot(au.saved()) / u.squared_l2()
    r = u.zip(au, lambda p, q: F.struct((p * q).alias("pq"), (p * p).alias("pp"))).df.agg(F.sum("val.pq"), F.sum("val.pp")).first()
    return r[0] / r[1]


#: Steps after which a vector that only grows by sums is saved.
SETTLE = 4


def _settled(v: Vector, step: int) -> Vector:
    """Cheap sums stay open for some steps; small vectors are saved at once, which takes no job."""
    return v.saved() if v.local is not None or step % SETTLE == SETTLE - 1 else v


class Solver:
    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        raise NotImplementedError


def _start(spark: SparkSession, grid: Grid, x0: Vector | None) -> Vector:
    return Vector.full(spark, grid, 0.0) if x0 is None else x0


class GradientDescent(Solver):
    """x - step * gradient; the default step is the inverse of the Hessian's largest eigenvalue."""

    def __init__(self, f: Functional, spark: SparkSession, step: float | None = None):
        self.f, self.spark, self.step = f, spark, step

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.spark, self.f.domain, x0)
        step = self.step
        if step is None:
            step = 1 / power_iterations(self.f.hessian(x), self.spark)
        for _ in range(n):
            x = lincomb(1.0, x, -step, self.f.gradient(x)).saved()
        return x


def identity_projection(x: Vector) -> Vector:
    return x


def box_projection(low: float = 0.0, high: float = 1.0) -> Projection:
    return lambda x: x.clip(low, high)


def non_negative_projection(x: Vector) -> Vector:
    return x.maximum(0.0)


class Landweber(Solver):
    """x - step * T A* M (Ax - b), then a projection; plain Landweber has T = M = 1."""

    def __init__(self, a: LinearOperator, b: Vector, step: float | None = None, projection: Projection = identity_projection):
        self.a, self.b, self.step, self.projection = a, b, step, projection

    def _weights(self) -> tuple[Vector | None, Vector | None]:
        return None, None

    def _default_step(self) -> float:
        return 0.9 * 2 / power_iterations(Product(self.a.adjoint(), self.a), self.b.spark)

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        t, m = self._weights()
        step = self._default_step() if self.step is None else self.step
        x = _start(self.b.spark, self.a.domain, x0)
        for _ in range(n):
            r = self.a.apply(x) - self.b
            g = self.a.apply_adjoint(r if m is None else r * m)
            x = self.projection(lincomb(1.0, x, -step, g if t is None else g * t)).saved()
        return x


class SIRT(Landweber):
    """Weights from row and column sums; a column without entries gets no update."""

    def _weights(self) -> tuple[Vector, Vector]:
        spark = self.b.spark
        rows = self.a.apply(Vector.full(spark, self.a.domain, 1.0)).map(lambda v: 1 / (v + 1e-10))
        cols = self.a.apply_adjoint(Vector.full(spark, self.a.range, 1.0)).map(lambda v: F.when(v != 0, 1 / F.when(v != 0, v)).otherwise(0.0))
        return cols.saved(), rows.saved()

    def _default_step(self) -> float:
        return 1.0


class CGLS(Solver):
    """Conjugate gradients on the (damped) normal equations, without forming them."""

    def __init__(self, a: LinearOperator, b: Vector, eps: float = 0.0, tol: float = 1e-4):
        self.a, self.b, self.damp, self.tol = a, b, eps * eps, tol

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        a = self.a
        if x0 is None:
            x, s = _start(self.b.spark, a.domain, None), self.b
            r = a.apply_adjoint(s)
        else:
            x, s = x0, self.b - a.apply(x0)
            r = a.apply_adjoint(s)
            r = r if not self.damp else lincomb(1.0, r, -self.damp, x)
        r, k = r.saved_norm()
        c = r
        enough = max(self.tol, 1e-26 * k)  # beyond that only rounding errors are left
        for step in range(n):
            if k < enough or k == 0:
                break
            q, bend = a.apply(c).saved_norm()
            bend += self.damp * c.squared_l2() if self.damp else 0.0
            if bend == 0:
                break
            alpha = k / bend
            x = _settled(lincomb(1.0, x, alpha, c), step)
            s = _settled(lincomb(1.0, s, -alpha, q), step)
            r = a.apply_adjoint(s)
            before = k
            r, k = (lincomb(1.0, r, -self.damp, x) if self.damp else r).saved_norm()
            c = lincomb(1.0, r, k / before, c).saved()
        return x


class CGNE(Solver):
    """Conjugate gradients with the operator A*A and the right-hand side A*b."""

    def __init__(self, a: LinearOperator, b: Vector, tol: float = 1e-4):
        self.a, self.b, self.tol = a, b, tol

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        normal = Product(self.a.adjoint(), self.a)
        rhs = self.a.apply_adjoint(self.b)
        x = _start(self.b.spark, self.a.domain, x0)
        r, k = (rhs if x0 is None else rhs - normal.apply(x0)).saved_norm()
        c = r
        for step in range(n):
            if k == 0:
                break
            q = normal.apply(c).saved()
            bend = c.dot(q)
            if bend == 0:
                break
            alpha = k / bend
            x = _settled(lincomb(1.0, x, alpha, c), step)
            before = k
            r, k = lincomb(1.0, r, -alpha, q).saved_norm()
            c = lincomb(1.0, r, k / before, c).saved()
        return x


def newton_raphson_search(f: Functional, x: Vector, d: Vector, steps: int = 10, eps: float = 1e-8) -> float:
    """The step along d that Newton's method finds from second derivatives."""
    total, dd = 0.0, d.squared_l2()
    for _ in range(steps):
        at = x if total == 0 else lincomb(1.0, x, total, d)
        slope, bend = f.gradient(at).dot(d), d.dot(f.hessian(at).apply(d))
        if bend == 0:
            break
        move = -slope / bend
        total += move
        if move * move * dd <= eps * eps:
            break
    return total


def constant_search(step: float) -> Callable:
    return lambda f, x, d: step


def polak_ribiere(g: Vector, before: Vector) -> float:
    r = before.squared_l2()
    return 0.0 if r == 0 else (g.squared_l2() - g.dot(before)) / r


class CGNL(Solver):
    """Nonlinear conjugate gradients with pluggable line search and beta."""

    def __init__(self, f: Functional, spark: SparkSession, eps: float = 1e-4, line_search: Callable | None = None, beta: Callable = polak_ribiere, restart: int | None = None):
        self.f, self.spark, self.eps, self.beta = f, spark, eps, beta
        self.line_search = line_search or newton_raphson_search
        self.restart = restart or f.domain.size

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.spark, self.f.domain, x0)
        g = self.f.gradient(x).saved()
        d, first, since = -g, g.squared_l2(), 0
        for _ in range(n):
            if g.squared_l2() <= self.eps**2 * first or first == 0:
                break
            x = lincomb(1.0, x, self.line_search(self.f, x, d), d).saved()
            now = self.f.gradient(x).saved()
            beta, since = self.beta(now, g), since + 1
            if since >= self.restart or beta <= 0:
                beta, since = 0.0, 0
            d = lincomb(-1.0, now, beta, d).saved()
            g = now
        return x


class _FirstOrder(Solver):
    ITERATIONS = 5

    def __init__(self, f: Functional, spark: SparkSession, eps: float = 1e-10, preconditioner: LinearOperator | None = None):
        self.f, self.spark, self.eps, self.preconditioner = f, spark, eps, preconditioner

    def _lipschitz(self, x: Vector) -> float:
        h = self.f.hessian(x)
        return power_iterations(h if self.preconditioner is None else Product(self.preconditioner, h), self.spark, self.ITERATIONS)

    def _direction(self, g: Vector) -> Vector:
        return g if self.preconditioner is None else self.preconditioner.apply(g)


class FGM(_FirstOrder):
    """Nesterov's fast gradient method."""

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.spark, self.f.domain, x0)
        y, t, step = x, 1.0, 1 / self._lipschitz(x)
        first = None
        for _ in range(n):
            g, norm = self.f.gradient(x).saved_norm()
            first = norm if first is None else first
            if norm <= self.eps**2 * first:
                break
            y_next = lincomb(1.0, x, -step, self._direction(g)).saved()
            t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
            x = lincomb(1 + (t - 1) / t_next, y_next, -(t - 1) / t_next, y).saved()
            y, t = y_next, t_next
        return y if n else x


class OGM(_FirstOrder):
    """The optimised gradient method; its last step has a larger factor."""

    ITERATIONS = 20

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.spark, self.f.domain, x0)
        y, t, step = x, 1.0, 1 / self._lipschitz(x)
        first = None
        for k in range(n):
            g, norm = self.f.gradient(x).saved_norm()
            first = norm if first is None else first
            if norm <= self.eps**2 * first:
                break
            y_next = lincomb(1.0, x, -step, self._direction(g)).saved()
            t_next = (1 + math.sqrt(1 + (8 if k == n - 1 else 4) * t * t)) / 2
            # x' = y' + (t-1)/t' (y' - y) + t/t' (y' - x)
            a, b = (t - 1) / t_next, t / t_next
            x = lincomb(1.0, lincomb(1 + a + b, y_next, -a, y), -b, x).saved()
            y, t = y_next, t_next
        return x


class SQS(Solver):
    """Separable quadratic surrogates: steps scaled by the row sums of the Hessian, with ordered subsets and momentum."""

    def __init__(self, f: LeastSquares, spark: SparkSession, subsets: Sequence[Functional] = (), preconditioner: LinearOperator | None = None, momentum: bool = True, eps: float = 1e-10):
        self.f, self.spark, self.subsets, self.preconditioner, self.momentum, self.eps = f, spark, list(subsets), preconditioner, momentum, eps

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.spark, self.f.domain, x0)
        d = self.f.hessian(x).apply(Vector.full(self.spark, self.f.domain, 1.0))
        inverse = d.map(lambda v: F.when(v != 0, 1 / F.when(v != 0, v)).otherwise(0.0)).saved()
        parts, scale = (self.subsets, len(self.subsets)) if self.subsets else ([self.f], 1)
        z, t, first = x, 1.0, None
        for _ in range(n):
            norm = self.f.gradient(x).squared_l2()
            first = norm if first is None else first
            if norm <= self.eps**2 * first:
                break
            for part in parts:
                g = part.gradient(x)
                g = g if self.preconditioner is None else self.preconditioner.apply(g)
                z_next = (x - (g * inverse) * scale).saved()
                if self.momentum:
                    t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
                    a = (t - 1) / t_next
                    x, z, t = lincomb(1 + a, z_next, -a, z).saved(), z_next, t_next
                else:
                    x = z = z_next
        return z


class PGD(Solver):
    """Proximal gradient descent for half |Ax - b|^2 plus the term of a proximal operator."""

    def __init__(self, a: LinearOperator, b: Vector, prox: ProximalOperator, mu: float | None = None, eps: float = 1e-10):
        self.a, self.b, self.prox, self.mu, self.eps = a, b, prox, mu, eps

    def _prepared(self) -> tuple[LinearOperator, Vector, float]:
        normal = Product(self.a.adjoint(), self.a)
        mu = 0.45 / power_iterations(normal, self.b.spark) if self.mu is None else self.mu
        return normal, self.a.apply_adjoint(self.b).saved(), mu

    def _stop(self, x: Vector, before: Vector) -> bool:
        return (x - before).squared_l2() <= self.eps**2 * max(1.0, before.squared_l2())

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        normal, rhs, mu = self._prepared()
        x = _start(self.b.spark, self.a.domain, x0)
        for _ in range(n):
            before = x
            x = self.prox.apply(lincomb(1.0, x, -mu, normal.apply(x) - rhs), mu).saved()
            if self._stop(x, before):
                break
        return x


class APGD(PGD):
    """Accelerated proximal gradient descent."""

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        normal, rhs, mu = self._prepared()
        x = _start(self.b.spark, self.a.domain, x0)
        y, t = x, 1.0
        for _ in range(n):
            before = x
            x = self.prox.apply(lincomb(1.0, y, -mu, normal.apply(y) - rhs), mu).saved()
            t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
            a = (t - 1) / t_next
            y, t = lincomb(1 + a, x, -a, before).saved(), t_next
            if self._stop(x, before):
                break
        return x


ISTA, FISTA = PGD, APGD


def regularized_inversion(a: LinearOperator, b: Vector, regs: Sequence[tuple[float, LinearOperator, Vector]], n: int = 5, x0: Vector | None = None) -> Vector:
    """Least squares of the stack [A; l1 R1; ..] against [b; d1; ..] by conjugate gradients."""
    flat = lambda v: v.view_as(Grid((v.size,)))
    parts = [a, *[Scaled(l, r) for l, r, _ in regs]]  # noqa: E741
    rhs = concatenate(flat(b), *[flat(d) for _, _, d in regs])
    stack = BlockOperator(parts, BlockOperator.ROW)
    return CGNE(stack, rhs).solve(n, x0)


class ADMML2(Solver):
    """ADMM for half |op x - b|^2 + g(Ax)."""

    def __init__(self, op: LinearOperator, b: Vector, a: LinearOperator, prox_g: ProximalOperator, tau: float = 1.0, inner: int = 5):
        self.op, self.b, self.a, self.prox_g, self.tau, self.inner = op, b, a, prox_g, tau, inner

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        spark, weight = self.b.spark, 1 / math.sqrt(self.tau)
        x = _start(spark, self.a.domain, x0)
        z = Vector.full(spark, self.a.range, 0.0) if x0 is None else self.a.apply(x0)
        u = Vector.full(spark, self.a.range, 0.0)
        for _ in range(n):
            x = regularized_inversion(self.op, self.b, [(weight, self.a, (z - u) * weight)], self.inner, x)
            ax = (self.a.apply(x) + u).saved()
            z = self.prox_g.apply(ax, self.tau).saved()
            u = (ax - z).saved()
        return x


class LinearizedADMM(Solver):
    """ADMM for f(x) + g(Kx) with a linearised quadratic term; needs tau / sigma * |K|^2 below 1."""

    def __init__(self, k: LinearOperator, prox_f: ProximalOperator, prox_g: ProximalOperator, sigma: float, tau: float, spark: SparkSession):
        self.k, self.prox_f, self.prox_g, self.sigma, self.tau, self.spark = k, prox_f, prox_g, sigma, tau, spark

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        k = self.k
        x = _start(self.spark, k.domain, x0)
        z = u = Vector.full(self.spark, k.range, 0.0)
        kx = k.apply(x).saved()
        for _ in range(n):
            x = self.prox_f.apply(lincomb(1.0, x, -self.tau / self.sigma, k.apply_adjoint(kx + u - z)), self.tau).saved()
            kx = k.apply(x).saved()
            w = (kx + u).saved()
            z = self.prox_g.apply(w, self.sigma).saved()
            u = (w - z).saved()
        return x


class OrthogonalMatchingPursuit(Solver):
    """Adds the atom that fits the residual best and refits all chosen ones, until the misfit is small."""

    def __init__(self, d: Dictionary, y: Vector, eps: float):
        self.d, self.y, self.eps = d, y, eps

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        chosen: list[int] = []
        residual, fit = self.y, np.zeros(0)
        for _ in range(n):
            if 0.5 * residual.squared_l2() <= self.eps:
                break
            atom = int(self.d.most_correlated(residual))
            if atom in chosen:
                break
            chosen.append(atom)
            part = self.d.supported(chosen)
            coefficients = CGLS(part, self.y, tol=0.0).solve(10)
            residual = (self.y - part.apply(coefficients)).saved()
            fit = coefficients.to_array().ravel()  # one number for each chosen atom
        spark = self.y.spark
        value = F.lit(0.0)
        for a, c in zip(chosen, fit, strict=True):
            value = F.when(F.col("id") == a, float(c)).otherwise(value)
        return Vector(spark.range(self.d.n_atoms).select(F.col("id").alias("idx"), value.alias("val")), self.d.domain)


class _GMRES(Solver):
    """Krylov basis by modified Gram-Schmidt, a small least-squares problem in NumPy."""

    def __init__(self, a: LinearOperator, b: Vector, eps: float = 1e-10, back: LinearOperator | None = None):
        self.a, self.rhs, self.eps, self.back = a, b, eps, back or a.adjoint()

    def _krylov(self, r: Vector, k: int, step: Callable[[Vector], Vector]) -> tuple[list[Vector], np.ndarray]:
        beta = r.l2()
        if beta == 0:
            return [], np.zeros(0)
        basis, h = [(r * (1 / beta)).saved()], np.zeros((k + 1, k))
        for j in range(k):
            q = step(basis[j]).saved()
            for i in range(j + 1):
                h[i, j] = q.dot(basis[i])
                q = lincomb(1.0, q, -h[i, j], basis[i])
            q = q.saved()
            h[j + 1, j] = q.l2()
            e = np.zeros(j + 2)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], e, rcond=None)
            misfit = float(np.linalg.norm(h[: j + 2, : j + 1] @ y - e))
            if h[j + 1, j] <= 1e-14 * beta or misfit <= self.eps:
                break
            basis.append((q * (1 / h[j + 1, j])).saved())
        return basis[: len(y)], y

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        raise NotImplementedError

    def solve_and_restart(self, n: int, restarts: int, x0: Vector | None = None) -> Vector:
        x = x0
        for _ in range(restarts):
            x = self.solve(n, x)
        return x


def _combined(basis: list[Vector], y: np.ndarray) -> Vector:
    out = basis[0] * float(y[0])
    for v, c in zip(basis[1:], y[1:], strict=True):
        out = lincomb(1.0, out, float(c), v)
    return out


class ABGMRES(_GMRES):
    """Minimises |b - A B u| and returns B u; B need not be the adjoint of A."""

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.rhs.spark, self.a.domain, x0)
        r = (self.rhs if x0 is None else self.rhs - self.a.apply(x)).saved()
        basis, y = self._krylov(r, n, lambda v: self.a.apply(self.back.apply(v)))
        return x if not basis else (x + self.back.apply(_combined(basis, y))).saved()


class BAGMRES(_GMRES):
    """Minimises |B (b - A x)|."""

    def solve(self, n: int, x0: Vector | None = None) -> Vector:
        x = _start(self.rhs.spark, self.a.domain, x0)
        r = self.back.apply(self.rhs if x0 is None else self.rhs - self.a.apply(x)).saved()
        basis, y = self._krylov(r, n, lambda v: self.back.apply(self.a.apply(v)))
        return x if not basis else (x + _combined(basis, y)).saved()


GMRES = ABGMRES
