from __future__ import annotations

import numpy as np
import pytest

from tomolith.plans import geometry as G
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector
from tomolith.sources import files as IO
from tomolith.sources import phantoms as PH


def test_shepp_logan_rows(spark):
    image = PH.shepp_logan(spark, (16, 16)).to_array()
    # Three rows of the 16 x 16 phantom.
    rows = {
        3: (0, 0, 0, 0, 0, 0.2, 0.2, 0.3, 0.3, 0.3, 0.2, 0.2, 0, 0, 0, 0),
        6: (0, 0, 0, 0.2, 0.2, 0, 0.1, 0.3, 0.3, 0.3, 0.1, 0.2, 0.2, 0.2, 0, 0),
        9: (0, 0, 0, 0.2, 0.2, 0.2, 0, 0, 0.2, 0, 0, 0, 0.2, 0.2, 0, 0),
    }
    for y, row in rows.items():
        assert np.allclose(image[:, y], row, atol=1e-6), (y, image[:, y])


@pytest.mark.parametrize("half", [(1, 1), (5, 3), (3, 9), (12, 1), (1, 12), (14, 14), (0, 4), (4, 0), (7, 13)])
def test_ellipse_by_midpoints(spark, half):
    """Row by row, the widest point that the inequality admits."""
    a, b = half
    n = 41
    got = PH.draw_ellipses(Vector.full(spark, Grid((n, n))), [PH.Ellipse(2.0, (20, 20), half)]).to_array() > 0
    e = lambda x, y: b * b * x * x + a * a * y * y - a * a * b * b
    for y in range(b + 2):
        steep = max([x for x in range(a + 1) if e(x, y) + e(x - 1, y) <= 0], default=-1)
        level = [max([x for x in range(a + 1) if e(x, r) + e(x, r - 1) <= 0 and r <= b], default=-1) for r in (y, y + 1)]
        flat = max(level[0], level[1] + 1) if y <= b else -1
        want = flat if y <= b and b * b * flat < a * a * y else steep if b * b * steep >= a * a * y else -1
        if not a or not b:
            want = a if y == 0 else -1
        for row in {n - (20 + y), n - (20 - y)}:
            xs = np.flatnonzero(got[:, row])
            assert (len(xs) == 2 * want + 1 and xs[0] == 20 - want) if want >= 0 else not len(xs), (y, want, xs)


def test_ellipse_outside_and_turned(spark):
    zero = Vector.full(spark, Grid((20, 20)))
    cut = PH.draw_ellipses(zero, [PH.Ellipse(1.0, (0, 19), (4, 4))]).to_array()
    assert 0 < cut.sum() < 49 and cut[0, 1] == 1
    up, turned = (PH.draw_ellipses(zero, [PH.Ellipse(1.0, (10, 10), h, w)]).to_array() for h, w in (((2, 7), 0.0), ((7, 2), 90.0)))
    assert np.array_equal(up, turned)


def test_forbild_from_a_table(spark, tmp_path):
    rows = [("sphere", 1.8, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0, None, None, None, None, None, 0), ("box", 1.0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0, 2, 0.0, 1)]
    spark.createDataFrame(rows, PH.SOLIDS).write.parquet(f"{tmp_path}/solids")
    f = PH.forbild(spark, 16, "head", f"{tmp_path}/solids").to_array()
    assert f.max() == 1.8 and f[8, 8, 8] == 1.0 and f[9, 8, 8] == 1.8


def test_solids(spark):
    g = Grid((12, 12, 12))
    ball = PH.rasterize(spark, g, [PH.Solid("ellipsoid", 1.0, (6, 6, 6), (3, 3, 3))]).to_array()
    at = np.stack(np.indices((12, 12, 12)), -1)
    assert np.allclose(ball, ((at - 6) ** 2).sum(-1) <= 9)
    turned = PH.Solid("box", 2.0, (6, 6, 6), (4, 1, 1), (90.0, 0.0, 0.0))
    assert PH.rasterize(spark, g, [turned]).to_array()[6, 9, 6] == 2 and PH.rasterize(spark, g, [turned]).to_array()[9, 6, 6] == 0
    tube = PH.rasterize(spark, g, [PH.Solid("cylinder", 1.0, (6, 6, 6), (4, 2, 2), axis=0)]).to_array()
    assert tube[2, 6, 6] == 1 and tube[1, 6, 6] == 0 and tube[6, 9, 6] == 0
    over = PH.rasterize(spark, g, [PH.Solid("sphere", 1.0, (6, 6, 6), (3, 3, 3), order=1), PH.Solid("box", 5.0, (6, 6, 6), (5, 5, 5), order=0)], PH.OVERWRITE).to_array()
    assert over[6, 6, 6] == 1 and over[2, 2, 2] == 5
    clipped = PH.rasterize(spark, g, [PH.Solid("sphere", 1.0, (6, 6, 6), (3, 3, 3), clip_x=6)]).to_array()
    assert clipped[6, 6, 6] == 1 and clipped[7, 6, 6] == 0
    f = PH.forbild(spark, 16, 25.6, [PH.Solid("sphere", 1.8, (0, 0, 0), (9, 9, 9), order=0), PH.Solid("sphere", 1.0, (0, 0, 0), (0.1, 0.1, 0.1), order=1)]).to_array()
    assert f.max() == 1.8 and f[8, 8, 8] == 1.8
    assert PH.shepp_logan(spark, (12, 12, 12)).max() > 0.1
    with pytest.raises(ValueError):
        PH.shepp_logan(spark, (12, 13))


def test_simple_phantoms_and_noise(spark):
    c = PH.circular(spark, (9, 9), 2.0).to_array()
    assert c.sum() == 13 and c[4, 4] == 1
    assert PH.rectangle(spark, (5, 5), (1, 1), (3, 4)).sum() == 6
    blob = PH.smooth_blob(spark, (10, 10)).to_array()
    assert blob.max() <= 1 and blob[5, 5] > 0.85 and blob[0, 0] == 0
    zero = Vector.full(spark, Grid((4000,)), 0.0)
    g, p = PH.gaussian_noise(zero, 1.0, 2.0, 3).to_array(), PH.poisson_noise(zero, 4.0, 3).to_array()
    assert abs(g.mean() - 1) < 0.2 and abs(g.std() - 2) < 0.2 and abs(p.mean() - 0.25) < 0.03 and p.min() >= 0
    assert PH.no_noise(zero) is zero


def test_trajectories():
    v = Grid((16, 16))
    det = G.circle_trajectory(5, v, 180, 1600.0, 16.0)
    assert det.shape == (22, 5) and len(det.poses) == 5
    assert np.allclose(det.poses[0].centre, [8, 8 - 1600]) and np.allclose(det.poses[-1].centre, [8, 8 + 1600])
    for p in (*det.poses, *G.sphere_trajectory(6, Grid((4, 4, 4)), 2, 50.0, 10.0).poses):
        n = p.projection.shape[0]
        assert np.allclose(p.projection @ p.inverse, np.eye(n)) and np.allclose(p.projection[:, :n] @ p.centre + p.projection[:, n], 0, atol=1e-8)
    q, scale = det.poses[1].project(np.array([[8.0, 8.0]]))
    assert np.allclose(q, 11) and np.isclose(scale[0], 1616 / 1600)
    lim = G.limited_angle_trajectory(10, (40.0, 60.0), v, 180, 100.0, 10.0, mirrored=False)
    assert len(lim.poses) == lim.shape[-1] > 5
    with pytest.raises(ValueError):
        G.sphere_trajectory(6, v, 2, 1.0, 1.0)


def test_files(spark, tmp_path):
    v = Vector.from_array(spark, np.arange(12.0).reshape(3, 4, order="F") / 4, Grid((3, 4), (0.5, 2.0)))
    IO.write(v, str(tmp_path / "a.edf"))
    raw = (tmp_path / "a.edf").read_bytes()
    assert len(raw) == 1024 + 48 and b"Dim_1 = 3;" in raw and b"Size = 48;" in raw
    for path in ("a.edf", "b.mhd"):
        if path.endswith("mhd"):
            IO.write_mhd(v, str(tmp_path / path), str(tmp_path / "b.raw"), "MET_DOUBLE")
        back = IO.read(spark, str(tmp_path / path))
        assert back.desc == v.desc and np.allclose(back.validate().to_array(), v.to_array())
    IO.write(v, str(tmp_path / "c.pgm"))
    lines = (tmp_path / "c.pgm").read_text().split("\n")
    assert lines[:3] == ["P2", "3 4", "255"] and lines[3].split()[0] == "0" and lines[6].split()[-1] == "255"
    for call in (lambda: IO.read(spark, "x.png"), lambda: IO.write(v, "x.png")):
        with pytest.raises(ValueError):
            call()
    IO.write(v, str(tmp_path / "d.mha"))
    back = IO.read(spark, str(tmp_path / "d.mha"))
    assert back.desc == v.desc and np.allclose(back.to_array(), v.to_array())
    assert IO.edf_header("{\n A = 'x;y';\n B = 3 ;\n}") == {"a": "x;y", "b": "3"}


def test_large_files_are_read_in_records(spark, tmp_path, monkeypatch):
    v = Vector.generate(spark, Grid((64, 40)), lambda i: i * 0.5 - 7)
    IO.write_edf(v, str(tmp_path / "a.edf"), "Double")
    IO.write_mhd(v, str(tmp_path / "b.mhd"), str(tmp_path / "b.raw"), "MET_SHORT")
    whole = [IO.read(spark, str(tmp_path / n)).to_array() for n in ("a.edf", "b.mhd")]
    monkeypatch.setattr(IO, "WHOLE", 1000)
    for name, want in zip(("a.edf", "b.mhd"), whole, strict=True):
        assert np.array_equal(IO.read(spark, str(tmp_path / name)).validate().to_array(), want)
    (tmp_path / "b.raw").write_bytes(b"1234")
    with pytest.raises(ValueError):
        IO.read(spark, str(tmp_path / "b.mhd"))
