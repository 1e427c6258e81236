from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolith.functions import columns as C
from tomolith.plans import descriptor as D
from tomolith.plans.vector import Vector, concatenate, lincomb

RNG = np.random.default_rng(666)


def vec(spark, values, shape=None):
    a = np.asarray(values)
    return Vector.from_array(spark, a.reshape(shape, order="F") if shape else a)


def test_descriptors():
    g = D.Grid((3, 4, 5))
    assert g.strides == (1, 3, 12) and g.size == 60 and g.origin == (1.5, 2.0, 2.5)
    assert all(g.index(g.coordinate(i)) == i for i in range(60))
    for bad in ((0, 2), (), (-1,)):
        with pytest.raises(ValueError):
            D.Grid(bad)
    with pytest.raises(ValueError):
        D.Grid((2, 2), (1.0,))
    p = D.partition(D.Grid((2, 7)), 3)
    assert [x.shape[-1] for x in p.parts] == [2, 2, 3] and p.offsets == (0, 4, 8)
    assert D.best_common(D.Grid((2, 3)), D.Grid((3, 2))) == D.Grid((6,))
    assert D.best_common(D.Grid((2, 3), (1, 2)), D.Grid((2, 3))).spacing == (1.0, 1.0)
    with pytest.raises(ValueError):
        D.best_common(D.Grid((2,)), D.Grid((3,)))
    assert list(D.cartesian_indices((0, 0), (2, 2))) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert D.neighbours_in_slice((2, 2), 1, 0) == [(2, 1), (2, 2), (2, 3)]
    assert D.neighbours_in_slice((0, 0), 1, 1, (0, 0), (4, 4)) == [(0, 0), (1, 0)]


def test_numpy_orders_and_views(spark):
    a = RNG.normal(size=(3, 4))
    for source in (np.ascontiguousarray(a), np.asfortranarray(a)):
        assert np.allclose(Vector.from_array(spark, source).to_array(), a)
    v = Vector.from_array(spark, a).validate()
    assert v.at((2, 3)) == a[2, 3] and v.at((3, 0)) == 0.0 and v[(1, 2)] == a[1, 2]
    assert np.allclose(v.slice(2).to_array().ravel(), a[:, 2])
    assert np.allclose(v.with_slice(1, v.slice(0)).to_array(), np.c_[a[:, 0], a[:, 0], a[:, 2:]])
    assert np.allclose(v.fft_shift().to_array(), np.fft.fftshift(a))
    assert np.allclose(v.fft_shift(inverse=True).to_array(), np.fft.ifftshift(a))
    with pytest.raises(IndexError):
        v.slice(4)
    with pytest.raises(ValueError):
        v.view_as(D.Grid((5,)))
    assert "..." in Vector.full(spark, D.Grid((100,)), 1.0).format()


def test_arithmetic_and_reductions(spark):
    a, b = RNG.normal(size=20), RNG.normal(size=20)
    x, y = vec(spark, a), vec(spark, b)
    for got, want in (
        (x + y, a + b), (x - y, a - b), (x * y, a * b), (x / y, a / b), (2 - x, 2 - a), (3 / x, 3 / a), (-x, -a),
        (lincomb(2, x, -3, y), 2 * a - 3 * b), (x.cwise_max(y), np.maximum(a, b)), (x.cwise_min(y), np.minimum(a, b)),
        (x.clip(-0.5, 0.5), a.clip(-0.5, 0.5)), (x.minimum(0), np.minimum(a, 0)), (x.maximum(0), np.maximum(a, 0)), (x.square().sqrt(), np.abs(a)), (x.exp(), np.exp(a)),
    ):
        assert np.allclose(got.to_array(), want)
    assert np.isclose(x.dot(y), a @ b) and np.isclose(x.l2(), np.linalg.norm(a)) and np.isclose(x.l1(), abs(a).sum())
    assert np.isclose(x.linf(), abs(a).max()) and x.l0() == 20 and vec(spark, [0.0, 1e-9, 1.0]).l0() == 1
    assert np.isclose(x.min(), a.min()) and np.isclose(x.max(), a.max()) and x.allclose(x)
    blocks = concatenate(x, y).view_as(D.identical_blocks(D.Grid((20,)), 2))
    assert np.allclose(blocks.pl1().to_array(), abs(a) + abs(b)) and np.allclose(blocks.pl2().to_array(), np.hypot(a, b))
    assert np.allclose(blocks.block(1).to_array(), b) and np.allclose(blocks.with_block(0, y).block(0).to_array(), b)


def test_complex(spark):
    a, b = RNG.normal(size=6) + 1j * RNG.normal(size=6), RNG.normal(size=6) + 1j * RNG.normal(size=6)
    x, y = vec(spark, a), vec(spark, b)
    assert np.allclose((x * y).to_array(), a * b) and np.allclose((x / y).to_array(), a / b)
    assert np.isclose(x.dot(y), np.vdot(a, b)) and np.allclose(x.abs().to_array(), abs(a))
    assert np.allclose(x.imag().to_array(), a.imag) and np.isclose(x.max(), a[abs(a).argmax()])
    assert np.allclose(vec(spark, [1j, -2j, 3 + 1j]).sign().to_array(), [1, -1, 1])


def test_hardware_division_and_logarithm(spark):
    row = spark.range(1).select(C.div0(F.lit(1.0), F.lit(0.0)), C.div0(F.lit(-1.0), F.lit(0.0)), C.div0(F.lit(0.0), F.lit(0.0)), C.ln0(F.lit(0.0)), C.ln0(F.lit(-1.0))).first()
    assert row[0] == np.inf and row[1] == -np.inf and np.isnan(row[2]) and row[3] == -np.inf and np.isnan(row[4])


def test_small_vectors_are_held_by_the_driver(spark, monkeypatch):
    from tomolith.plans import vector as V

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=12), rng.normal(size=12) + 1j * rng.normal(size=12)
    x, z = Vector.from_array(spark, a), Vector.from_array(spark, b)
    here = [lincomb(2.0, x, -1.0, x * x), x - 3.0, -x * 0.5, x.map(lambda v: v * 2).saved()]
    far = [lincomb(2.0, Vector(x.df, x.desc), -1.0, Vector(x.df, x.desc) * Vector(x.df, x.desc)), Vector(x.df, x.desc) - 3.0, -Vector(x.df, x.desc) * 0.5, x.map(lambda v: v * 2)]
    for p, q in zip(here, far, strict=True):
        assert np.allclose(p.to_array(), q.to_array()) and np.isclose(p.squared_l2(), q.squared_l2()) and np.isclose(p.sum(), q.sum())
    assert all(p.local is not None for p in (here[0], here[1], here[3])) and far[0].local is None
    w = Vector(z.df, z.desc)
    assert np.isclose(z.dot(z * 2j), w.dot(w * 2j)) and np.isclose(z.squared_l2(), w.squared_l2()) and np.allclose(w.saved().local, b)
    monkeypatch.setattr(V, "LOCAL_ROWS", 4)
    y, n = far[1].saved_norm()
    assert y.local is None and np.isclose(n, ((a - 3) ** 2).sum()) and np.allclose(y.to_array().ravel(), a - 3)
