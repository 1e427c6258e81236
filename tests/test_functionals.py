from __future__ import annotations

import numpy as np
import pytest

from tomolith.functions import basis as B
from tomolith.functions import functionals as FN
from tomolith.functions import proximal as PX
from tomolith.operators import linear as OL
from tomolith.plans.descriptor import Grid, identical_blocks
from tomolith.plans.vector import Vector, concatenate

RNG = np.random.default_rng(5)
N = 6


def vec(spark, values):
    return Vector.from_array(spark, np.asarray(values, float))


def functionals(spark):
    m = RNG.random((4, N)) + 0.1
    rows = [(i, j, float(m[i, j])) for i in range(4) for j in range(N)]
    a = OL.Relation(spark.createDataFrame(rows, "row long, col long, w double"), Grid((N,)), Grid((4,)))
    pos = lambda n: vec(spark, RNG.random(n) + 0.5)
    g = Grid((N,))
    return {
        "l2": FN.L2Squared(g, pos(N)), "l2reg": FN.L2Reg(a=a), "wl2": FN.WeightedL2Squared(pos(N)), "ls": FN.LeastSquares(a, pos(4)), "wls": FN.WeightedLeastSquares(a, pos(4), pos(4)),
        "huber": FN.Huber(g, 0.7), "pseudo": FN.PseudoHuber(g, 0.7), "quadric": FN.Quadric(OL.Scaling(g, 3.0), pos(N)), "emission": FN.EmissionLogLikelihood(a, pos(4), pos(4)),
        "transmission": FN.TransmissionLogLikelihood(a, pos(4), pos(4)), "transmission_r": FN.TransmissionLogLikelihood(a, pos(4), pos(4), pos(4)), "constant": FN.ConstantFunctional(g, 3.0),
        "sum": FN.L2Squared(g) + 2.0 * FN.PseudoHuber(g, 1.0),
    }


def test_gradients_and_hessians(spark):
    x, d, h = RNG.random(N) + 0.2, RNG.normal(size=N), 1e-5
    vx, vd = vec(spark, x), vec(spark, d)
    for name, f in functionals(spark).items():
        slope = (f(vec(spark, x + h * d)) - f(vec(spark, x - h * d))) / (2 * h)
        assert np.isclose(slope, f.gradient(vx).dot(vd), rtol=1e-5, atol=1e-6), name
        if name == "constant":
            continue
        bend = (f.gradient(vec(spark, x + h * d)).dot(vd) - f.gradient(vec(spark, x - h * d)).dot(vd)) / (2 * h)
        assert np.isclose(bend, vd.dot(f.hessian(vx).apply(vd)), rtol=1e-4, atol=1e-5), name


def test_values(spark):
    x = vec(spark, [-9, -4, 0, 1])
    f = FN.L1Norm(x.desc)
    assert f(x) == 14
    with pytest.raises(FN.NotDifferentiable):
        f.gradient(x)
    with pytest.raises(FN.NotDifferentiable):
        f.hessian(x)
    assert FN.LInfNorm(x.desc)(x) == 9 and FN.L0PseudoNorm(x.desc)(x) == 3 and FN.ZeroFunctional(x.desc)(x) == 0
    assert FN.WeightedL1Norm(vec(spark, [1, 0, 5, 2]))(x) == 11
    assert FN.IndicatorBox(x.desc, -10, 5)(x) == 0 and FN.IndicatorNonNegativity(x.desc)(x) == np.inf
    with pytest.raises(ValueError):
        FN.WeightedL1Norm(x)
    with pytest.raises(ValueError):
        FN.Huber(x.desc, -1.0)
    s = FN.SeparableSum(FN.L2Squared(x.desc), FN.Huber(x.desc, 1.0))
    both = concatenate(x, x)
    assert s(both) == FN.L2Squared(x.desc)(x) + FN.Huber(x.desc, 1.0)(x)
    assert np.allclose(s.gradient(both).to_array().ravel(order="F"), [-9, -4, 0, 1, -1, -1, 0, 1])
    r = FN.LinearResidual(OL.Scaling(x.desc, 2.0), x)
    assert np.allclose(r(x).to_array(), [-9, -4, 0, 1]) and r.jacobian().apply(x).allclose(x * 2.0)
    FN.Constraint(OL.Identity(x.desc), OL.Identity(x.desc), x)


def test_proximal_goldens(spark):
    v = vec(spark, [-2, 3, 4, -7, 7, 8, 8, 3])
    assert np.allclose(PX.prox_apply(PX.ProximalL1(), v, 4).to_array(), [0, 0, 0, -3, 3, 4, 4, 0])
    assert np.allclose(PX.ProximalL0().apply(v, 4).to_array(), [0, 0, 0, -7, 7, 8, 8, 0])
    assert np.allclose(PX.ProximalBoxConstraint(0, 5).apply(v, 1).to_array(), np.clip(v.to_array(), 0, 5))
    assert np.allclose(PX.ProximalL2Squared(vec(spark, np.ones(8)), 2.0).apply(v, 0.5).to_array(), (v.to_array() + 1) / 2)
    with pytest.raises(ValueError):
        PX.prox_apply(PX.ProximalL1(), v, 0)
    w = vec(spark, [3, 0, 4, 1]).view_as(identical_blocks(Grid((2,)), 2))
    assert np.allclose(PX.ProximalMixedL21Norm().apply(w, 2.5).to_array().ravel(order="F"), [1.5, 0, 2, 0])
    both = PX.CombinedProximal(PX.ProximalL1(), PX.ProximalIdentity()).apply(w, 2.0)
    assert np.allclose(both.to_array().ravel(order="F"), [1, 0, 4, 1])
    with pytest.raises(ValueError):
        PX.CombinedProximal(PX.ProximalL1()).apply(w, 2.0)


def test_basis_functions():
    x = np.linspace(-2, 2, 9)
    assert np.isclose(B.bessel_i(0, 1.0), 1.2660658777520082) and np.isclose(B.bessel_i(5, 10.0), 777.188286403)
    assert np.isclose(B.bspline(np.linspace(-1.5, 1.5, 3001), 2).sum() * 0.001, 1, atol=1e-3)
    assert np.allclose((B.bspline(x + 1e-6, 2) - B.bspline(x - 1e-6, 2)) / 2e-6, B.bspline_derivative(x, 2), atol=1e-5)
    s = np.linspace(0, 1.9, 7)
    for order in (1, 2):
        numeric = (B.blob_projected(s + 1e-6, 2, 10.83, order) - B.blob_projected(s - 1e-6, 2, 10.83, order)) / 2e-6
        assert np.allclose(numeric, B.blob_derivative_projected(s, 2, 10.83, order), atol=1e-4)
    z = np.linspace(-2, 2, 40001)
    for d in (0.0, 0.7):
        assert np.isclose(B.blob(np.hypot(z, d), 2, 10.83, 2).sum() * 1e-4, B.blob_projected(np.array(d)), rtol=1e-3)
    lut = B.Lut(lambda r: 1 - r / 2, 2.0)
    assert np.allclose(lut(np.array([0, 1, 2, 3])), [1, 0.5, 0, 0])
    assert B.mean_stddev([1, 3]) == (2, 1) and np.allclose(B.confidence_interval_95(2, 1.0, 1.0), (1 - 12.7062, 1 + 12.7062))
    with pytest.raises(ValueError):
        B.blob_projected(s, order=3)
