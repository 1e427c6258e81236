from __future__ import annotations

import re

import numpy as np
import pytest

from tomolith.operators import basic as OB
from tomolith.operators import fourier as OF
from tomolith.operators import linear as OL
from tomolith.operators import projectors as OP
from tomolith.plans import geometry as G
from tomolith.plans.descriptor import Grid, identical_blocks
from tomolith.plans.vector import Vector, concatenate, lincomb

RNG = np.random.default_rng(1)


def vec(spark, values, desc=None):
    return Vector.from_array(spark, np.asarray(values, float), desc)


def relation(spark, m):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return OL.Relation(spark.createDataFrame(rows, "row long, col long, w double"), Grid((m.shape[1],)), Grid((m.shape[0],)))


def matches_adjoint(spark, a, tolerance=1e-9):
    x = Vector.from_array(spark, RNG.normal(size=a.domain.size), Grid((a.domain.size,))).view_as(a.domain)
    y = Vector.from_array(spark, RNG.normal(size=a.range.size), Grid((a.range.size,))).view_as(a.range)
    left, right = a.apply(x).dot(y), x.dot(a.apply_adjoint(y))
    assert abs(left - right) <= tolerance * max(1, abs(left)), (left, right)


@pytest.mark.parametrize(
    ("kind", "forward", "adjoint"),
    [("forward", (-27, -1, -3, 8, -7), (27, -26, 2, -11, 15)), ("backward", (30, -27, -1, -3, 8), (57, -26, 2, -11, 8)), ("central", (1.5, -14, -2, 2.5, 0.5), None)],
)
def test_finite_differences_of_five(spark, kind, forward, adjoint):
    a = OB.FiniteDifferences(Grid((5,)), kind)
    y = a.apply(vec(spark, [30, 3, 2, -1, 7]))
    assert np.allclose(y.to_array().ravel(order="F"), forward)
    if adjoint:
        assert np.allclose(a.apply_adjoint(vec(spark, forward)).to_array().ravel(), adjoint)


def test_finite_differences_of_a_cube(spark):
    a = OB.FiniteDifferences(Grid((2, 2, 2)))
    got = a.apply(vec(spark, np.arange(1, 9), Grid((2, 2, 2)))).to_array().ravel(order="F")
    assert np.allclose(got[:12], [1, -2, 1, -4, 1, -6, 1, -8, 2, 2, -3, -4])
    for kind in ("forward", "backward", "central"):
        matches_adjoint(spark, OB.FiniteDifferences(Grid((3, 4, 2)), kind))
        matches_adjoint(spark, OB.FiniteDifferences(Grid((3, 4, 2)), kind, (False, True, False)))
    with pytest.raises(ValueError):
        OB.FiniteDifferences(Grid((3,)), active=(False,))


def test_tree(spark):
    m, k = RNG.normal(size=(5, 4)) * (RNG.random((5, 4)) > 0.3), RNG.normal(size=(5, 4))
    a, b = relation(spark, m), relation(spark, k)
    x, y = RNG.normal(size=4), RNG.normal(size=5)
    vx, vy = vec(spark, x), vec(spark, y)
    for op, want in (
        (a, m @ x), (a + b, (m + k) @ x), (2.0 * a, 2 * m @ x), (a.adjoint() * b, m.T @ k @ x), (OL.BlockOperator([a, b], "row"), np.r_[m @ x, k @ x]),
        (3.0 * (2.0 * a), 6 * m @ x), (a - b, (m - k) @ x), (a * OL.Identity(Grid((4,))), m @ x),
    ):
        assert np.allclose(op.apply(vx).to_array().ravel(order="F"), want)
        matches_adjoint(spark, op)
    col = OL.BlockOperator([a, b], "col")
    assert np.allclose(col.apply(concatenate(vx, vx)).to_array(), (m + k) @ x)
    assert np.allclose(OL.adjoint(a).apply(vy).to_array(), m.T @ y) and OL.leaf(a) is a
    matches_adjoint(spark, OL.BlockOperator([a.adjoint() * b, OL.Scaling(Grid((4,)), 2.0)], "row"))
    with pytest.raises(ValueError):
        a.apply(vy)
    with pytest.raises(ValueError):
        _ = a * b


def test_rows_without_entries_are_zero(spark):
    a = OL.Relation(spark.createDataFrame([(2, 1, 1.0)], "row long, col long, w double"), Grid((3,)), Grid((4,)))
    assert np.allclose(a.apply(vec(spark, [1, 2, 3])).to_array(), [0, 0, 2, 0])


def test_scaling_and_jacobi(spark):
    d = vec(spark, [1, 2, 4])
    assert np.allclose(OL.Scaling(d.desc, d).apply(d).to_array(), [1, 4, 16])
    m = RNG.normal(size=(5, 3))
    a = relation(spark, m)
    assert np.allclose(OB.diagonal(a.adjoint() * a, spark).to_array(), (m * m).sum(0))
    assert np.allclose(OB.JacobiPreconditioner(a.adjoint() * a, spark).apply(d).to_array(), np.array([1, 2, 4]) / (m * m).sum(0))


def test_dictionary(spark):
    atoms = RNG.normal(size=(4, 3))
    rows = [(int(a), int(i), float(atoms[i, a])) for a in range(3) for i in range(4)]
    d = OB.Dictionary(spark.createDataFrame(rows, "atom long, idx long, val double"), Grid((4,)), 3)
    unit = atoms / np.linalg.norm(atoms, axis=0)
    assert np.allclose(d.apply(vec(spark, [1, 2, 3])).to_array(), unit @ [1, 2, 3])
    matches_adjoint(spark, d)
    assert np.allclose(d.atom(1).to_array(), unit[:, 1])
    assert np.allclose(d.supported([2, 0]).apply(vec(spark, [1, 5])).to_array(), unit[:, 2] + 5 * unit[:, 0])
    new = d.with_atom(1, vec(spark, [0, 3, 0, 4]))
    assert np.allclose(new.atom(1).to_array(), [0, 0.6, 0, 0.8])
    r = vec(spark, unit[:, 2] * -3)
    assert d.most_correlated(r) == 2
    with pytest.raises(Exception, match="zeros"):
        OB.Dictionary(spark.createDataFrame([(0, 0, 0.0)], "atom long, idx long, val double"), Grid((1,)), 1).atoms.collect()
    assert np.isclose(OB.Dictionary.random(spark, Grid((6,)), 2, 3).atom(0).l2(), 1)


def test_fourier(spark):
    z = RNG.normal(size=(4, 3)) + 1j * RNG.normal(size=(4, 3))
    v = Vector.from_array(spark, z)
    for norm in ("forward", "ortho", "backward"):
        f = OF.FourierTransform(v.desc, norm)
        assert np.allclose(f.apply(v).to_array(), np.fft.fft2(z, norm=norm))
        assert np.allclose(f.apply_adjoint(f.apply(v)).to_array(), z)
    w = Vector.from_array(spark, np.array([0, 42, 42, 0], complex))
    assert np.allclose(OF.fft(w).to_array(), np.fft.fft([0, 42, 42, 0]))
    with pytest.raises(TypeError):
        OF.FourierTransform(v.desc).apply(v.real())


def test_shearlets(spark):
    op = OF.ShearletTransform(Grid((16, 16)))
    assert op.layers == 13
    total = op.spectra(spark).groupBy((op.spectra(spark)["idx"] % 256).alias("i")).agg({"s": "count"}).count()
    assert total == 256
    x = Vector.from_array(spark, RNG.normal(size=(16, 16)).astype(complex))
    y = op.apply(x)
    assert np.isclose(y.l2(), x.l2()) and np.allclose(op.apply_adjoint(y).to_array(), x.to_array())


def test_single_rays(spark):
    volume = Grid((5, 5))
    det = G.trajectory_from_angles([0.0], volume, 100.0, 5.0, size=(1,))
    ones = Vector.full(spark, volume, 1.0)
    for kind in (OP.SiddonsMethod, OP.BinaryMethod, OP.JosephsMethod):
        a = kind(volume, det, spark)
        assert np.isclose(a.apply(ones).to_array().item(), 5)
        back = a.apply_adjoint(a.apply(ones)).to_array()
        assert np.allclose(back[2], 5) and np.allclose(np.delete(back, 2, 0), 0)
    far = G.trajectory_from_angles([0.0], volume, 100.0, 5.0, size=(1,), offset=(50.0, 0.0))
    assert np.allclose(OP.SiddonsMethod(volume, far, spark).apply(ones).to_array(), 0)
    o, d = np.array([[-1.0, -1.0]]), np.array([[1.0, 1.0]]) / np.sqrt(2)
    _, voxel, length = OP.siddon(o, d, (4, 4))
    assert voxel.tolist() == [0, 5, 10, 15] and np.allclose(length, np.sqrt(2))
    _, voxel, w = OP.joseph(o, d, (4, 4))
    assert np.isclose(w.sum(), 4 * np.sqrt(2)) and set(voxel) == {0, 5, 10, 15}


@pytest.mark.parametrize("dim", [2, 3])
def test_projectors_have_adjoints_and_agree(spark, dim):
    volume = Grid((8,) * dim)
    det = G.circle_trajectory(4, volume, 270, 800.0, 8.0)
    x = Vector.full(spark, volume, 1.0)
    sums = {}
    for kind in (OP.SiddonsMethod, OP.JosephsMethod, OP.BinaryMethod, OP.BlobProjector, OP.BSplineProjector, OP.BlobVoxelProjector, OP.BSplineVoxelProjector, OP.PhaseContrastBlobVoxelProjector, OP.PhaseContrastBSplineVoxelProjector):
        a = kind(volume, det, spark)
        matches_adjoint(spark, a)
        sums[kind.__name__] = a.apply(x).sum()
    assert abs(sums["SiddonsMethod"] / sums["JosephsMethod"] - 1) < 0.3  # rays along the border: Joseph sees half of them
    assert abs(sums["PhaseContrastBlobVoxelProjector"]) < 0.05 * sums["BlobVoxelProjector"]


def test_subsets_and_curved_detector(spark):
    volume = Grid((8, 8))
    det = G.circle_trajectory(7, volume, 180, 800.0, 8.0)
    assert G.subsets(det, 3) == [[0, 3, 6], [1, 4], [2, 5]]
    sampler = OP.SubsetSampler(volume, det, 3)
    x = Vector.full(spark, volume, 1.0)
    b = OP.SiddonsMethod(volume, det, spark).apply(x)
    for part, a in zip(sampler.data(b), sampler.projectors(OP.SiddonsMethod, spark), strict=True):
        assert part.validate().allclose(a.apply(x))
    curved = G.curved_circle_trajectory(3, volume, 180, 800.0, 8.0, 0.01)
    flat = G.circle_trajectory(3, volume, 180, 800.0, 8.0)
    assert np.allclose(curved.points(np.arange(11)), flat.points(np.arange(11)), atol=1e-3)
    assert curved.subset([0, 2]).angle == 0.01
    with pytest.raises(ValueError):
        G.subsets(det, 1)


def test_identical_blocks_of_slabs():
    a = OB.FiniteDifferences(Grid((3, 2)))
    assert a.range == identical_blocks(Grid((3, 2)), 2)


def test_a_laid_out_relation_is_not_shuffled_again(spark, monkeypatch):
    from tomolith.plans import vector as V

    m = RNG.normal(size=(40, 30)) * (RNG.random((40, 30)) < 0.3)
    x, y = RNG.normal(size=30), RNG.normal(size=40)
    plain = relation(spark, m)
    monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(V, "LOCAL_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = plain.persisted()
        for op, v, want in ((a, x, m @ x), (a.adjoint(), y, m.T @ y), (a.adjoint().adjoint(), x, m @ x)):
            out = op.apply(vec(spark, v))
            assert np.allclose(out.to_array().ravel(), want)
            plan = out.df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert "InMemoryTableScan" in plan and not re.search(r"Exchange hashpartitioning\((row|col)#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan), plan
        y1, y2 = (a.apply(vec(spark, x) * s).saved() for s in (1.0, 2.0))
        total = lincomb(1.0, y1, 1.0, y2)
        plan = total.df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Exchange" not in plan, plan  # saved vectors meet where they are
        assert np.allclose(total.saved().to_array().ravel(), 3 * m @ x)
        a.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diagonal_of_a_normal_operator(spark):
    m = RNG.normal(size=(7, 5))
    a = relation(spark, m)
    d = OB.diagonal(OL.Product(a.adjoint(), a), spark).to_array().ravel()
    assert np.allclose(d, (m**2).sum(0))
    assert np.allclose(OB.diagonal(OL.Product(relation(spark, m.T), a), spark).to_array().ravel(), (m**2).sum(0))
