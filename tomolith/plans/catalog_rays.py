"""Queries of the projectors, each against SQL written from its geometry.

The SQL traces the rays of a fan beam itself: crossings of grid planes (Siddon, binary), slices across the dominant
axis (Joseph), radial weights around rays (blobs, B-splines) and around projected voxels (voxel-driven).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.functions import functionals as FN
from tomolith.operators import projectors as OP
from tomolith.sources import phantoms as PH

from . import geometry as G
from . import recipes
from . import solvers as S
from . import tables as T
from .catalog import IMAGE, add, scalars, shown
from .descriptor import Grid
from .vector import Vector

N, PIXELS, POSES, S2C, C2D, SHIFT = 32, 45, 12, 3200.0, 32.0, 0.37
#: Oblique angles; with the shifted principal point no ray runs along a grid line.
ANGLES = tuple(float(x) for x in np.linspace(5, 175, POSES))


def fan(volume: Grid | None = None) -> G.Detector:
    return G.trajectory_from_angles(ANGLES, volume or Grid((N, N)), S2C, C2D, principal=(SHIFT,))


RAYS = f"""pose AS MATERIALIZED (SELECT i AS pose, sin(radians(5.0 + 170.0 * i / {POSES - 1})) AS s, cos(radians(5.0 + 170.0 * i / {POSES - 1})) AS c FROM range({POSES}) t(i)),
ray0 AS (SELECT pose * {PIXELS} + i AS ray, 16 - {S2C} * s AS ox, 16 - {S2C} * c AS oy, (i + 0.5 - 22.5 - {SHIFT}) / {S2C + C2D} AS x, s, c FROM pose, range({PIXELS}) t(i)),
ray1 AS (SELECT ray, ox, oy, (c * x + s) / sqrt(1 + x * x) AS dx, (c - s * x) / sqrt(1 + x * x) AS dy FROM ray0)"""


def _box(grown: int = 0) -> str:
    """Rays that hit the image (grown on all sides), with their entry and exit."""
    lo, hi = -grown, N + grown
    return f"""ray AS MATERIALIZED (SELECT *, greatest(least(({lo} - ox) / dx, ({hi} - ox) / dx), least(({lo} - oy) / dy, ({hi} - oy) / dy)) AS t0, least(greatest(({lo} - ox) / dx, ({hi} - ox) / dx), greatest(({lo} - oy) / dy, ({hi} - oy) / dy)) AS t1 FROM ray1),
hit AS MATERIALIZED (SELECT * FROM ray WHERE t1 > t0)"""


SIDDON = f"""{RAYS}, {_box()},
cut AS (SELECT ray, ox, oy, dx, dy, greatest(least(t, t1), t0) AS t FROM (SELECT *, (k - ox) / dx AS t FROM hit, range({N + 1}) p(k) UNION ALL SELECT *, (k - oy) / dy FROM hit, range({N + 1}) p(k))),
seg AS (SELECT ray, ox + dx * (t + e) / 2 AS mx, oy + dy * (t + e) / 2 AS my, e - t AS w FROM (SELECT *, lead(t) OVER (PARTITION BY ray ORDER BY t) AS e FROM cut)),
entry AS MATERIALIZED (SELECT ray, (floor(mx) + {N} * floor(my))::BIGINT AS voxel, w FROM seg WHERE w > 1e-9 AND floor(mx) BETWEEN 0 AND {N - 1} AND floor(my) BETWEEN 0 AND {N - 1})"""

_SLICES = "SELECT ray, CASE WHEN abs(dx) >= abs(dy) THEN 1 ELSE 0 END AS by_x, CASE WHEN abs(dx) >= abs(dy) THEN ox ELSE oy END AS o, CASE WHEN abs(dx) >= abs(dy) THEN dx ELSE dy END AS d, CASE WHEN abs(dx) >= abs(dy) THEN oy ELSE ox END AS q, CASE WHEN abs(dx) >= abs(dy) THEN dy ELSE dx END AS e, ox, oy, dx, dy, t0, t1 FROM hit"
_CROSSED = "k >= floor(least(o + t0 * d, o + t1 * d) + 1e-9) AND k < ceil(greatest(o + t0 * d, o + t1 * d) - 1e-9)"
JOSEPH = f"""{RAYS}, {_box()}, main AS ({_SLICES}),
spot AS (SELECT ray, by_x, k, q + (k + 0.5 - o) / d * e - 0.5 AS p, 1 / abs(d) AS step FROM main, range({N}) t(k) WHERE {_CROSSED}),
two AS (SELECT ray, by_x, k, floor(p) + up AS m, step * CASE WHEN up = 1 THEN p - floor(p) ELSE 1 - p + floor(p) END AS w FROM spot, range(2) u(up)),
entry AS MATERIALIZED (SELECT ray, CASE WHEN by_x = 1 THEN k + {N} * m ELSE m + {N} * k END::BIGINT AS voxel, w FROM two WHERE m BETWEEN 0 AND {N - 1} AND w > 1e-12)"""

# Radial weights: sampled at 100 points of [0, 2], linear in between.
_I2 = "(SELECT sum(pow(5.415, 2 * k + 2) / (factorial(k::INT)::DOUBLE * factorial((k + 2)::INT)::DOUBLE)) FROM range(30) t(k))"
_Z = "(10.83 * sqrt(greatest(1 - x * x / 4, 1e-10)))"
_SINH, _COSH = f"((exp({_Z}) - exp(-{_Z})) / 2)", f"((exp({_Z}) + exp(-{_Z})) / 2)"
BLOB = f"CASE WHEN 1 - x * x / 4 > 1e-10 THEN 4 / 10.83 * (1 - x * x / 4) * ((3 / ({_Z} * {_Z}) + 1) * {_SINH} - 3 / {_Z} * {_COSH}) / {_I2} ELSE 0 END"
BLOB_SLOPE = f"CASE WHEN 1 - x * x / 4 > 1e-10 THEN -2 * x * ({_COSH} * {_Z} - {_SINH}) / (10.83 * 2) / {_I2} ELSE 0 END"
SPLINE = "CASE WHEN x <= 0.5 THEN 0.75 - x * x WHEN x <= 1.5 THEN (1.5 - x) * (1.5 - x) / 2 ELSE 0 END"
SPLINE_SLOPE = "greatest(1 - abs(x + 0.5), 0) - greatest(1 - abs(x - 0.5), 0)"


def _lut(value: str) -> str:
    return f"lut AS MATERIALIZED (SELECT i, {value} AS v FROM (SELECT i, 2.0 * i / 99 AS x FROM range(100) t(i)))"


def _weighted(rows: str, sign: str = "1") -> str:
    """Rows with a distance r, weighted by the table."""
    return f"SELECT m.*, {sign} * (a.v + (b.v - a.v) * (r / 2 * 99 - least(floor(r / 2 * 99), 98))) AS w FROM ({rows}) m JOIN lut a ON a.i = least(floor(r / 2 * 99), 98) JOIN lut b ON b.i = a.i + 1 WHERE r <= 2"


def _around(value: str) -> str:
    near = "SELECT ray, by_x, k, floor(q + (k + 0.5 - o) / d * e) + u AS m, ox, oy, dx, dy FROM main, range(32) t(k), range(-2, 3) v(u) WHERE " + _CROSSED
    place = "SELECT ray, CASE WHEN by_x = 1 THEN k ELSE m END AS vx, CASE WHEN by_x = 1 THEN m ELSE k END AS vy, ox, oy, dx, dy FROM near WHERE m BETWEEN 0 AND 31"
    far = "SELECT ray, (vx + 32 * vy)::BIGINT AS voxel, abs((vx + 0.5 - ox) * dy - (vy + 0.5 - oy) * dx) AS r FROM place"
    return f"{RAYS}, {_box(2)}, main AS ({_SLICES}), near AS ({near}), place AS ({place}), {_lut(value)}, entry AS MATERIALIZED ({_weighted(far)})"


def _voxels(value: str, signed: bool) -> str:
    seen = f"SELECT pose, g AS voxel, c * (g % 32 - 15.5) - s * (g // 32 - 15.5) AS x, s * (g % 32 - 15.5) + c * (g // 32 - 15.5) + {S2C} AS y FROM pose, range(1024) t(g)"
    at = f"SELECT pose, voxel, {S2C + C2D} * x / y + 22.5 + {SHIFT} - 0.5 AS u, {S2C + C2D} / sqrt(x * x + y * y) AS m FROM seen"
    pairs = f"SELECT pose * {PIXELS} + p AS ray, voxel, (u - p) / m AS away, abs(u - p) / m AS r FROM spot, range({PIXELS}) t(p) WHERE abs(u - p) <= 2 * m"
    return f"{RAYS}, seen AS ({seen}), spot AS ({at}), {_lut(value)}, entry AS MATERIALIZED ({_weighted(pairs, 'sign(away)' if signed else '1')})"


def _forward(entries: str, weight: str = "w", digits: int = 4) -> str:
    return f"WITH {entries} SELECT g AS idx, round(coalesce(v, 0), {digits}) + 0.0 AS val FROM range({POSES * PIXELS}) t(g) LEFT JOIN (SELECT ray, sum({weight} * val) AS v FROM entry JOIN {IMAGE} x ON x.idx = voxel GROUP BY ray) ON ray = g"


_SINO = f"(SELECT g AS idx, (g % 7) / 4.0 + (g % {PIXELS}) / 10.0 AS val FROM range({POSES * PIXELS}) t(g))"


def _sinogram(s: SparkSession) -> Vector:
    return Vector.generate(s, fan(), lambda i: (i % 7) / F.lit(4.0) + (i % PIXELS) / F.lit(10.0))


def _backward(entries: str, weight: str = "w", digits: int = 4) -> str:
    return f"WITH {entries} SELECT g AS idx, round(coalesce(v, 0), {digits}) + 0.0 AS val FROM range({N * N}) t(g) LEFT JOIN (SELECT voxel, sum({weight} * val) AS v FROM entry JOIN {_SINO} y ON y.idx = ray GROUP BY voxel) ON voxel = g"


KINDS = {
    "binary": (OP.BinaryMethod, SIDDON, "1.0"), "siddon": (OP.SiddonsMethod, SIDDON, "w"), "joseph": (OP.JosephsMethod, JOSEPH, "w"),
    "blob": (OP.BlobProjector, _around(BLOB), "w"), "bspline": (OP.BSplineProjector, _around(SPLINE), "w"),
    "blob_voxel": (OP.BlobVoxelProjector, _voxels(BLOB, False), "w"), "bspline_voxel": (OP.BSplineVoxelProjector, _voxels(SPLINE, False), "w"),
    "phase_blob_voxel": (OP.PhaseContrastBlobVoxelProjector, _voxels(BLOB_SLOPE, True), "w"), "phase_bspline_voxel": (OP.PhaseContrastBSplineVoxelProjector, _voxels(SPLINE_SLOPE, True), "w"),
}
for _name, (_kind, _entries, _weight) in KINDS.items():
    add(f"sinogram_{_name}", lambda s, d, k=_kind: shown(k(Grid((N, N)), fan(), s).apply(T.image(s, d)), 3), _forward(_entries, _weight, 3))
    add(f"backprojection_{_name}", lambda s, d, k=_kind: shown(k(Grid((N, N)), fan(), s).apply_adjoint(_sinogram(s)), 3), _backward(_entries, _weight, 3))

add("geometry_rays", lambda s, d: _rays(s), f"WITH {RAYS} SELECT ray, round(ox, 6) + 0.0 AS ox, round(oy, 6) + 0.0 AS oy, round(dx, 9) + 0.0 AS dx, round(dy, 9) + 0.0 AS dy FROM ray1")
add(
    "geometry_voxel_positions", lambda s, d: _positions(s),
    f"WITH {RAYS}, seen AS (SELECT pose, g AS voxel, c * (g % 32 - 15.5) - s * (g // 32 - 15.5) AS x, s * (g % 32 - 15.5) + c * (g // 32 - 15.5) + {S2C} AS y FROM pose, range(1024) t(g)) SELECT pose, voxel, round({S2C + C2D} * x / y + 22.5 + {SHIFT}, 6) + 0.0 AS u, round({S2C + C2D} / sqrt(x * x + y * y), 8) AS scale FROM seen",
)


def _rays(s: SparkSession) -> DataFrame:
    det, rows = fan(), []
    for k, pose in enumerate(det.poses):
        o, d = pose.rays(det.points(np.arange(PIXELS)))
        rows += [(k * PIXELS + i, round(float(o[0]), 6), round(float(o[1]), 6), round(float(x), 9) + 0.0, round(float(y), 9) + 0.0) for i, (x, y) in enumerate(d)]
    return s.createDataFrame(rows, "ray long, ox double, oy double, dx double, dy double")


def _positions(s: SparkSession) -> DataFrame:
    points, rows = np.stack(np.unravel_index(np.arange(N * N), (N, N), order="F"), 1) + 0.5, []
    for k, pose in enumerate(fan().poses):
        q, m = pose.project(points)
        rows += [(k, i, round(float(u), 6), round(float(v), 8)) for i, (u, v) in enumerate(zip(q[:, 0], m, strict=True))]
    return s.createDataFrame(rows, "pose long, voxel long, u double, scale double")


def _subsets(s: SparkSession) -> DataFrame:
    """The measurements of each subset, with the subset in front."""
    sampler = OP.SubsetSampler(Grid((N, N)), fan(), 3)
    parts = [v.df.select(F.lit(k).cast("long").alias("subset"), "idx", (F.round("val", 6) + 0.0).alias("val")) for k, v in enumerate(sampler.data(_sinogram(s)))]
    return reduce(DataFrame.unionByName, parts)


add("subset_data", lambda s, d: _subsets(s), f"SELECT (idx // {PIXELS}) % 3 AS subset, (idx // {PIXELS}) // 3 * {PIXELS} + idx % {PIXELS} AS idx, round(val, 6) + 0.0 AS val FROM {_SINO}")
add(
    "subset_projectors", lambda s, d: shown(OP.SubsetSampler(Grid((N, N)), fan(), 3).projectors(OP.SiddonsMethod, s)[1].apply(T.image(s, d)), 4),
    f"SELECT (idx // {PIXELS}) // 3 * {PIXELS} + idx % {PIXELS} AS idx, val FROM ({_forward(SIDDON)}) WHERE (idx // {PIXELS}) % 3 = 1",
)

# Filtered back-projection: the ramp filter as a circular convolution of width 128.
_FILTERED = f"SELECT a.idx, sum(b.val * h.v) AS val FROM {_SINO} a JOIN {_SINO} b ON a.idx // {PIXELS} = b.idx // {PIXELS} JOIN (SELECT m, sum(2.0 * least(k, 128 - k) / 128 * cos(2 * pi() * k * m / 128)) / 128 AS v FROM range(128) t(k), range(128) u(m) GROUP BY m) h ON h.m = (a.idx - b.idx + 128) % 128 GROUP BY 1"
add("ramp_filter", lambda s, d: shown(recipes.ramp_filtered(_sinogram(s)), 5), f"SELECT idx, round(val, 5) + 0.0 AS val FROM ({_FILTERED})")
add(
    "filtered_back_projection", lambda s, d: shown(recipes.filtered_back_projection(OP.SiddonsMethod(Grid((N, N)), fan(), s), _sinogram(s)), 5),
    f"WITH {SIDDON}, f AS ({_FILTERED}) SELECT g AS idx, round(coalesce(v, 0) * pi() / 2 / {POSES}, 5) + 0.0 AS val FROM range({N * N}) t(g) LEFT JOIN (SELECT voxel, sum(w * val) AS v FROM entry JOIN f ON f.idx = ray GROUP BY voxel) ON voxel = g",
)


def _curved(s: SparkSession) -> DataFrame:
    det = G.curved_circle_trajectory(3, Grid((N, N)), 90, 100.0, 20.0, 0.8)
    return s.createDataFrame([(i, round(float(u), 8)) for i, (u,) in enumerate(det.points(np.arange(PIXELS)))], "pixel long, u double")


add(
    "geometry_curved_pixels", lambda s, d: _curved(s),
    f"SELECT i AS pixel, round(22.5 + sin(w) * {PIXELS} / 0.8 * 120 / (120 - {PIXELS} / 0.8 + cos(w) * {PIXELS} / 0.8), 8) AS u FROM (SELECT i, (i + 0.5 - 22.5) * 0.8 / {PIXELS} AS w FROM range({PIXELS}) t(i))",
)


def _reconstruction(s: SparkSession, d: str) -> DataFrame:
    """Forward projection of a phantom and CGLS steps back: the mean squared error is below a bound."""
    volume = Grid((16, 16))
    a = OP.SiddonsMethod(volume, G.circle_trajectory(50, volume, 360, 1600.0, 16.0), s).persisted()
    x = PH.shepp_logan(s, (16, 16))
    try:
        back = S.CGLS(a, a.apply(x).saved(), tol=1e-8).solve(10)
        error = FN.L2Squared(volume, x).evaluate(back) * 2 / volume.size
    finally:
        a.unpersist()
    return scalars(s, good=float(error < 0.004))


add("reconstruction", _reconstruction, "SELECT 1.0::DOUBLE AS good")

# --- three dimensions ---------------------------------------------------------------------------------
#: A volume of 8 x 8 x 8 seen from five poses on a circle, by an 11 x 11 detector.
_CUBE, _POSES3 = 8, (11.0, 47.0, 83.0, 128.0, 161.0)


def _cone() -> G.Detector:
    return G.trajectory_from_angles(_POSES3, Grid((_CUBE,) * 3), 400.0, 8.0, principal=(0.23, 0.31))


def _cube(s: SparkSession) -> Vector:
    return Vector.generate(s, Grid((_CUBE,) * 3), lambda i: (i * 7 % 11) / F.lit(4.0))


_BOX3 = "greatest(least(-ox / dx, (8 - ox) / dx), least(-oy / dy, (8 - oy) / dy), least(-oz / dz, (8 - oz) / dz)) AS t0, least(greatest(-ox / dx, (8 - ox) / dx), greatest(-oy / dy, (8 - oy) / dy), greatest(-oz / dz, (8 - oz) / dz)) AS t1"
_RAYS3 = f"""pose AS (SELECT row_number() OVER () - 1 AS pose, sin(radians(a)) AS s, cos(radians(a)) AS c FROM (VALUES {", ".join(f"({a})" for a in _POSES3)}) t(a)),
ray0 AS (SELECT pose * 121 + j * 11 + i AS ray, 4 + 400 * s AS ox, 4.0 AS oy, 4 - 400 * c AS oz, (i + 0.5 - 5.5 - 0.23) / 408 AS x, (j + 0.5 - 5.5 - 0.31) / 408 AS y, s, c FROM pose, range(11) t(i), range(11) u(j)),
ray AS (SELECT ray, ox, oy, oz, (c * x - s) / sqrt(1 + x * x + y * y) AS dx, y / sqrt(1 + x * x + y * y) AS dy, (s * x + c) / sqrt(1 + x * x + y * y) AS dz FROM ray0),
hit AS MATERIALIZED (SELECT * FROM (SELECT *, {_BOX3} FROM ray) WHERE t1 > t0)"""
_CUTS = " UNION ALL ".join(f"SELECT *, (k - o{v}) / d{v} AS t FROM hit, range(9) p(k)" for v in "xyz")
_SIDDON3 = f"""{_RAYS3}, cut AS (SELECT ray, ox, oy, oz, dx, dy, dz, greatest(least(t, t1), t0) AS t FROM ({_CUTS})),
seg AS (SELECT ray, floor(ox + dx * (t + e) / 2) AS a, floor(oy + dy * (t + e) / 2) AS b, floor(oz + dz * (t + e) / 2) AS c, e - t AS w FROM (SELECT *, lead(t) OVER (PARTITION BY ray ORDER BY t) AS e FROM cut)),
entry AS MATERIALIZED (SELECT ray, (a + 8 * b + 64 * c)::BIGINT AS voxel, w FROM seg WHERE w > 1e-9 AND a BETWEEN 0 AND 7 AND b BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7)"""
add("sinogram_siddon_3d", lambda s, d: shown(OP.SiddonsMethod(Grid((_CUBE,) * 3), _cone(), s).apply(_cube(s)), 4), f"WITH {_SIDDON3} SELECT g AS idx, round(coalesce(v, 0), 4) + 0.0 AS val FROM range(605) t(g) LEFT JOIN (SELECT ray, sum(w * (voxel * 7 % 11) / 4.0) AS v FROM entry GROUP BY ray) ON ray = g")
add("backprojection_siddon_3d", lambda s, d: shown(OP.SiddonsMethod(Grid((_CUBE,) * 3), _cone(), s).apply_adjoint(Vector.full(s, _cone(), 1.0)), 4), f"WITH {_SIDDON3} SELECT g AS idx, round(coalesce(v, 0), 4) + 0.0 AS val FROM range(512) t(g) LEFT JOIN (SELECT voxel, sum(w) AS v FROM entry GROUP BY voxel) ON voxel = g")
