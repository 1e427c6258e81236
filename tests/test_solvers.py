from __future__ import annotations

import numpy as np
import pytest

from tomolith.functions import functionals as FN
from tomolith.functions import proximal as PX
from tomolith.operators import basic as OB
from tomolith.operators import linear as OL
from tomolith.operators import projectors as OP
from tomolith.plans import geometry as G
from tomolith.plans import recipes as R
from tomolith.plans import solvers as S
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector
from tomolith.sources import phantoms as PH
from tomolith.streaming.frames import reconstruct_frames

RNG = np.random.default_rng(666)


@pytest.fixture(scope="module")
def problem(spark):
    m = RNG.normal(size=(8, 4))
    rows = [(i, j, float(m[i, j])) for i in range(8) for j in range(4)]
    a = OL.Relation(spark.createDataFrame(rows, "row long, col long, w double").persist(), Grid((4,)), Grid((8,)))
    x = np.array([1.0, -2.0, 0.5, 3.0])
    return m, a, x, Vector.from_array(spark, m @ x)


def close(v, x, tolerance):
    return np.abs(v.to_array().ravel(order="F") - x).max() < tolerance


@pytest.mark.parametrize("factor", [1.0, 5.0, 0.5])
def test_cgls_of_a_scaling(spark, factor):
    b = Vector.from_array(spark, RNG.normal(size=(10, 15)))
    assert S.CGLS(OL.Scaling(b.desc, factor), b).solve(1).allclose(b * (1 / factor))


def test_power_iterations(spark, problem):
    m, a, _, _ = problem
    got = S.power_iterations(OL.Product(a.adjoint(), a), spark, 8)
    u = np.ones(4)
    for _ in range(8):
        u = m.T @ m @ u
        u /= np.linalg.norm(u)
    assert np.isclose(got, u @ m.T @ m @ u)


def test_krylov_solvers_are_exact(spark, problem):
    _, a, x, b = problem
    assert close(S.CGLS(a, b, tol=1e-20).solve(4), x, 1e-7)
    assert close(S.CGNE(a, b).solve(4), x, 1e-7)
    assert close(S.CGNL(FN.LeastSquares(a, b), spark, 1e-12, line_search=lambda f, p, d: S.newton_raphson_search(f, p, d, 1)).solve(5), x, 1e-6)
    assert close(S.ABGMRES(a, b).solve(4), x, 1e-7)
    assert close(S.BAGMRES(a, b).solve(4), x, 1e-7)


def test_damped_cgls(spark, problem):
    m, a, _, b = problem
    want = np.linalg.solve(m.T @ m + 0.25 * np.eye(4), m.T @ b.to_array())
    assert close(S.CGLS(a, b, eps=0.5, tol=0.0).solve(5), want, 1e-7)


def test_first_order_solvers_decrease(spark, problem):
    _, a, x, b = problem
    f = FN.LeastSquares(a, b)
    start = f(Vector.full(spark, a.domain, 0.0))
    for solver in (S.GradientDescent(f, spark), S.Landweber(a, b), S.FGM(f, spark), S.OGM(f, spark)):
        assert f(solver.solve(4)) < 0.8 * start, type(solver).__name__
    assert f(S.PGD(a, b, PX.ProximalIdentity()).solve(3)) < start and f(S.APGD(a, b, PX.ProximalIdentity()).solve(3)) < start


def test_sirt_of_a_scaling(spark):
    b = Vector.from_array(spark, RNG.random((4, 4)))
    assert S.SIRT(OL.Scaling(b.desc, 5.0), b, 1.0).solve(1).allclose(b * 0.2, 1e-6)


def test_sqs_with_subsets(spark):
    volume = Grid((8, 8))
    det = G.circle_trajectory(8, volume, 315, 800.0, 8.0)
    a = OP.SiddonsMethod(volume, det, spark).persisted()
    x = PH.circular(spark, (8, 8), 2.5)
    b = a.apply(x).saved()
    sampler = OP.SubsetSampler(volume, det, 2)
    parts = [FN.LeastSquares(p, d.saved()) for p, d in zip(sampler.projectors(OP.SiddonsMethod, spark), sampler.data(b), strict=True)]
    f = FN.LeastSquares(a, b)
    start = f(Vector.full(spark, volume, 0.0))
    plain, ordered = f(S.SQS(f, spark, momentum=False).solve(2)), f(S.SQS(f, spark, parts, momentum=False).solve(2))
    assert ordered < plain < start


def test_proximal_problems(spark):
    b = Vector.from_array(spark, np.array([3.0, -0.2, 0.5, -4.0]))
    eye = OL.Identity(b.desc)
    soft = np.sign(b.to_array()) * np.maximum(abs(b.to_array()) - 1, 0)
    assert close(S.APGD(eye, b, PX.ProximalL1(1.0), mu=0.9).solve(5), soft, 1e-2)
    assert close(S.ADMML2(eye, b, eye, PX.ProximalL1(1.0), inner=1).solve(6), soft, 0.1)
    assert close(S.LinearizedADMM(eye, PX.ProximalL1(1.0), PX.ProximalL2Squared(b), 1.0, 0.9, spark).solve(8), soft, 0.2)
    assert close(R.non_negative_least_squares(eye, b, 8), np.maximum(b.to_array(), 0), 0.1)
    assert close(R.tikhonov(eye, b, 1.0, 2), b.to_array() / 2, 1e-2)


def test_matching_pursuit(spark):
    atoms = [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, -1.0)]
    d = OB.Dictionary(spark.createDataFrame(atoms, "atom long, idx long, val double"), Grid((2,)), 3)
    y = Vector.from_array(spark, np.array([5.0, 3.0]))
    assert close(S.OrthogonalMatchingPursuit(d, y, 1e-4).solve(2), [3, 5, 0], 1e-6)


def test_recipes(spark):
    v = Vector.from_array(spark, np.arange(1.0, 17).reshape(4, 4, order="F"))
    assert np.allclose(R.rebin(v, 2).to_array(), [[3.5, 11.5], [5.5, 13.5]])
    assert R.background_mean(v, (0, 0), (2, 1)) == 1.5
    assert np.allclose(R.absorption(v, 2.0).to_array(), -np.log(v.to_array() / 2))
    assert np.allclose(R.beam_hardening(v, (1.0, 2.0)).to_array(), v.to_array() + 2 * v.to_array() ** 2)


def test_reconstruction_in_two_dimensions(spark):
    volume = Grid((16, 16))
    a = OP.SiddonsMethod(volume, G.circle_trajectory(50, volume, 360, 1600.0, 16.0), spark).persisted()
    x = PH.shepp_logan(spark, (16, 16)).saved()
    b = a.apply(x).saved()
    got = S.CGLS(a, b).solve(14)
    assert ((got.to_array() - x.to_array()) ** 2).mean() < 0.004
    fbp = R.filtered_back_projection(a, b).to_array()
    assert np.corrcoef(fbp.ravel(), x.to_array().ravel())[0, 1] > 0.8
    frames = list(reconstruct_frames(a, [b, b], 2))
    assert len(frames) == 2 and FN.LeastSquares(a, b)(frames[1]) < FN.LeastSquares(a, b)(frames[0])


@pytest.mark.parametrize(("kind", "shape", "steps", "error"), [("curved", (16, 16), 40, 0.004), ("flat", (16, 16, 16), 20, 0.2)])
def test_reconstruction_accuracy(spark, kind, shape, steps, error):
    """Least squares from 50 poses: a curved detector of fan angle 2, and three dimensions."""
    volume = Grid(shape)
    turn = (lambda: G.curved_circle_trajectory(50, volume, 360, 1600.0, 16.0, 2.0)) if kind == "curved" else (lambda: G.circle_trajectory(50, volume, 360, 1600.0, 16.0))
    a = OP.SiddonsMethod(volume, turn(), spark).persisted()
    x = PH.shepp_logan(spark, shape).saved()
    got = S.CGLS(a, a.apply(x).saved()).solve(steps)
    a.unpersist()
    assert ((got.to_array() - x.to_array()) ** 2).mean() < error


def test_large_iterates_are_saved_and_measured_in_one_job(spark, problem, monkeypatch):
    from tomolith.plans import vector as V

    _, a, x, b = problem
    monkeypatch.setattr(V, "LOCAL_ROWS", 0)
    far = Vector(b.df, b.desc)
    assert close(S.CGLS(a, far, tol=1e-20).solve(4), x, 1e-7) and close(S.CGNE(a, far).solve(4), x, 1e-7)
