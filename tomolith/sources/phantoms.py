"""Synthetic volumes and noise, generated on the executors from an index range.

Solids and the ellipses of images are rasterised by a containment predicate per shape: the
(few) shapes become column expressions over ``range(size)``, so a voxel needs no join and no
shuffle, and nothing is drawn on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions import basis as B
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector

ADDITION, OVERWRITE = "addition", "overwrite"

# The modified Shepp-Logan ellipsoids (Toft):
# amplitude, half axes x y z, centre x y z, Euler angles phi theta psi in degrees.
SHEPP_LOGAN_3D = (
    (1.0, 0.6900, 0.920, 0.810, 0.00, 0.0, 0.0, 0.0, 0.0, 0.0),
    (-0.8, 0.6624, 0.874, 0.780, 0.00, -0.0184, 0.0, 0.0, 0.0, 0.0),
    (-0.2, 0.1100, 0.310, 0.220, 0.22, 0.0, 0.0, -18.0, 0.0, 10.0),
    (-0.2, 0.1600, 0.410, 0.280, -0.22, 0.0, 0.0, 18.0, 0.0, 10.0),
    (0.1, 0.2100, 0.250, 0.410, 0.00, 0.35, -0.15, 0.0, 0.0, 0.0),
    (0.1, 0.0460, 0.046, 0.050, 0.00, 0.1, 0.25, 0.0, 0.0, 0.0),
    (0.1, 0.0460, 0.046, 0.050, 0.00, -0.1, 0.25, 0.0, 0.0, 0.0),
    (0.1, 0.0460, 0.023, 0.050, -0.08, -0.605, 0.0, 0.0, 0.0, 0.0),
    (0.1, 0.0230, 0.023, 0.020, 0.00, -0.606, 0.0, 0.0, 0.0, 0.0),
    (0.1, 0.0230, 0.046, 0.020, 0.06, -0.605, 0.0, 0.0, 0.0, 0.0),
)


def _half_up(x: float) -> int:
    """Nearest integer, halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def scale(grid: Grid, value: float) -> int:
    return _half_up(value * (grid.shape[0] - 1) / 2)


def scale_shift(grid: Grid, value: float) -> int:
    return scale(grid, value) + grid.shape[0] // 2


def _square(shape: Sequence[int]) -> Grid:
    grid = Grid(tuple(shape))
    if grid.ndim not in (2, 3) or len(set(grid.shape)) > 1:
        raise InvalidArgumentError("a square or a cube is needed")
    return grid


def circular(spark: SparkSession, shape: Sequence[int], radius: float) -> Vector:
    grid = Grid(tuple(shape))
    far = lambda i: sum((grid.column(i, d) - n // 2) * (grid.column(i, d) - n // 2) for d, n in enumerate(grid.shape))
    return Vector.generate(spark, grid, lambda i: F.when(F.sqrt(far(i).cast("double")) <= radius, 1.0).otherwise(0.0))


def rectangle(spark: SparkSession, shape: Sequence[int], lower: Sequence[int], upper: Sequence[int]) -> Vector:
    grid = Grid(tuple(shape))

    def value(i: Column) -> Column:
        inside = F.lit(True)
        for d, (a, b) in enumerate(zip(lower, upper, strict=True)):
            inside = inside & (grid.column(i, d) >= a) & (grid.column(i, d) < b)
        return F.when(inside, 1.0).otherwise(0.0)

    return Vector.generate(spark, grid, value)


def smooth_blob(spark: SparkSession, shape: Sequence[int], radius_factor: float = 1.0) -> Vector:
    grid = _square(shape)
    radius = grid.shape[0] // 2 * radius_factor

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            at = np.stack(np.unravel_index(batch["id"].to_numpy(), grid.shape, order="F"), 1) + 0.5
            r = np.linalg.norm(at - np.array(grid.origin), axis=1)
            yield batch.assign(idx=batch["id"], val=B.blob(r, radius, 10.83, 2))[["idx", "val"]]

    return Vector(spark.range(grid.size).mapInPandas(work, "idx long, val double"), grid)


def euler_matrix(phi: float, theta: float, psi: float) -> np.ndarray:
    """Rotation z-x-z by angles in degrees."""
    a, b, c = np.deg2rad([phi, theta, psi])

    def about_z(w: float) -> np.ndarray:
        return np.array([[math.cos(w), -math.sin(w), 0], [math.sin(w), math.cos(w), 0], [0, 0, 1]])

    about_x = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    return about_z(a) @ about_x @ about_z(c)


@dataclass(frozen=True)
class Solid:
    """A solid in voxel coordinates: kinds ellipsoid, sphere, box, cylinder (along an axis), free cylinder.

    ``half`` are half axes (for a cylinder: half length and the two radii); ``clip_x`` keeps
    only voxels up to that x.
    """

    kind: str
    amplitude: float
    centre: tuple[float, float, float]
    half: tuple[float, float, float]
    euler: tuple[float, float, float] = (0.0, 0.0, 0.0)
    axis: int = 2
    clip_x: float | None = None
    order: int = 0

    def contains(self, xyz: Sequence[Column]) -> Column:
        p = [c.cast("double") - float(m) for c, m in zip(xyz, self.centre, strict=True)]
        if any(self.euler):
            inverse = euler_matrix(*self.euler).T
            p = [sum((float(w) * q for w, q in zip(row, p, strict=True)), F.lit(0.0)) for row in inverse]
        if self.kind in ("ellipsoid", "sphere"):
            inside = sum((q * q / float(h * h) for q, h in zip(p, self.half, strict=True)), F.lit(0.0)) <= 1
        elif self.kind == "box":
            inside = F.lit(True)
            for q, h in zip(p, self.half, strict=True):
                inside = inside & (F.abs(q) <= float(h))
        elif self.kind == "cylinder":
            u, v = (p[d] for d in range(3) if d != self.axis)
            length, a, b = self.half
            inside = (F.abs(p[self.axis]) <= float(length)) & (u * u / float(a * a) + v * v / float(b * b) <= 1)
        else:
            raise InvalidArgumentError(f"no such solid: {self.kind}")
        return inside if self.clip_x is None else inside & (xyz[0] <= float(self.clip_x))


def rasterize(spark: SparkSession, grid: Grid, solids: Sequence[Solid], blending: str = ADDITION) -> Vector:
    """Sum of amplitudes, or the amplitude of the last solid (by order) that holds the voxel."""

    def value(i: Column) -> Column:
        xyz = [grid.column(i, d) for d in range(3)]
        out = F.lit(0.0)
        for s in sorted(solids, key=lambda s: s.order):
            inside = s.contains(xyz)
            out = out + F.when(inside, float(s.amplitude)).otherwise(0.0) if blending == ADDITION else F.when(inside, float(s.amplitude)).otherwise(out)
        return out

    return Vector.generate(spark, grid, value)


def _whole(a: Column, b: int) -> Column:
    """Whole part of a / b for a >= 0, exact below 2**53."""
    return ((a - a % F.lit(b)) / F.lit(b)).cast("long")


def _whole_root(a: Column) -> Column:
    return F.floor(F.sqrt(F.greatest(a, F.lit(0)).cast("double"))).cast("long")


def in_ellipse(x: Column, y: Column, a: int, b: int) -> Column:
    """Whether a lattice point x, y >= 0 from the centre is in the filled lattice ellipse of half axes a and b.

    With e(x, y) = b^2 x^2 + a^2 y^2 - a^2 b^2, a point next to the border is inside if the midpoint to its neighbour
    is. Where the border is steep the neighbour lies beside it, e(x, y) + e(x - 1, y) <= 0; where it is flat, below
    it, e(x, y) + e(x, y - 1) <= 0, and each row is at least one point wider than the row above. Both are solved for
    the half width of row y; the slope b^2 x : a^2 y there says which holds. A half axis of 0 leaves the middle row.
    """
    if not a or not b:
        return (y == 0) & (x <= a)
    aa, bb = a * a, b * b

    def level(r: Column) -> Column:
        v = 2 * aa * bb - aa * (2 * r * r - 2 * r + 1)
        return F.when(v >= 0, _whole_root(_whole(v, 2 * bb))).otherwise(-1)

    flat = F.greatest(level(y), level(y + 1) + 1)
    steep = _whole(_whole_root(_whole(4 * aa * (bb - y * y), bb) - 1) + 1, 2)
    return (y <= b) & (x <= F.when(bb * flat < aa * y, flat).when(bb * steep >= aa * y, steep).otherwise(-1))


@dataclass(frozen=True)
class Ellipse:
    """A filled ellipse of an image; y points up, a rotation (degrees) shears an upright ellipse of equal area and width."""

    amplitude: float
    centre: tuple[int, int]
    half: tuple[int, int]
    angle: float = 0.0

    def contains(self, x: Column, y: Column, height: int) -> Column:
        """For pixel columns x and y of an image with so many rows (y counts downwards)."""
        a, b = (int(h) for h in self.half)
        if a == 0 and b == 0:
            return F.lit(False)
        right, rise = 1, 0
        if a != b and math.fmod(self.angle, 180) != 0:
            # The rightmost point of the rotated ellipse: x = sqrt(a^2 cos^2 + b^2 sin^2), x y = (a^2 - b^2) sin cos.
            c, s = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
            far = math.copysign(math.hypot(a * c, b * s), c)
            right, rise = math.floor(far), math.floor((a * a - b * b) * s * c / far)
            if not right:  # thinner than a pixel
                return F.lit(False)
            a, b = abs(right), a * b // abs(right)
        dx = x - int(self.centre[0])
        up = height - y - int(self.centre[1]) - (dx * F.lit(rise) / F.lit(right)).cast("long")
        return F.transform(F.array(F.abs(up)), lambda row: in_ellipse(F.abs(dx), row, a, b))[0]  # the row is computed once


def draw_ellipses(image: Vector, ellipses: Sequence[Ellipse]) -> Vector:
    """Adds filled ellipses to a 2-D image, pixel by pixel on the executors; what leaves the image is cut off."""
    grid = image.desc
    if grid.ndim != 2:
        raise InvalidArgumentError("ellipses are drawn into images of two dimensions")

    def value(i: Column) -> Column:
        x, y = grid.column(i, 0), grid.column(i, 1)
        return sum((F.when(e.contains(x, y, grid.shape[1]), float(e.amplitude)).otherwise(0.0) for e in ellipses), F.col("val"))

    return Vector(image.df.select("idx", value(F.col("idx")).alias("val")), grid)


def shepp_logan(spark: SparkSession, shape: Sequence[int]) -> Vector:
    grid = _square(shape)
    if grid.ndim == 2:  # the ellipses of the table in the plane of the second to last axis
        flat = [Ellipse(a, (scale_shift(grid, x), scale_shift(grid, y)), (scale(grid, hx), scale(grid, hy)), phi) for a, hx, hy, _, x, y, _, phi, _, _ in SHEPP_LOGAN_3D]
        return draw_ellipses(Vector.full(spark, grid), flat)
    solids = []
    for a, hx, hy, hz, x, y, z, *euler in SHEPP_LOGAN_3D:
        half = tuple(float(scale(grid, h)) for h in (hx, hy, hz))
        if min(half) >= 1 and a != 0:
            solids.append(Solid("ellipsoid", a, tuple(scale_shift(grid, c) for c in (x, y, z)), half, tuple(euler)))
    return rasterize(spark, grid, solids)


#: Physical width in cm that each FORBILD phantom fills.
FORBILD_WIDTHS = {"head": 25.6, "thorax": 50.0, "abdomen": 40.0}
SOLIDS = "kind string, amplitude double, cx double, cy double, cz double, hx double, hy double, hz double, phi double, theta double, psi double, axis int, clip_x double, ord int"


def read_solids(spark: SparkSession, path: str) -> list[Solid]:
    """Solids in centimetres from a Parquet table (or a CSV file with a header) of columns ``SOLIDS``; a phantom has at most some hundred."""
    names = [c.split()[0] for c in SOLIDS.split(", ")]
    table = spark.read.csv(path, header=True, schema=SOLIDS) if path.endswith(".csv") else spark.read.parquet(path)
    out = []
    for r in table.select(*names).orderBy("ord").toLocalIterator():
        out.append(Solid(r.kind, r.amplitude, (r.cx, r.cy, r.cz), (r.hx, r.hy, r.hz), (r.phi or 0.0, r.theta or 0.0, r.psi or 0.0), 2 if r.axis is None else r.axis, r.clip_x, r.ord))
    return out


def forbild(spark: SparkSession, n: int, width: float | str, solids: Sequence[Solid] | str) -> Vector:
    """A FORBILD phantom of n^3 voxels from its published list of solids in centimetres, later ones overwriting.

    ``width`` is a length or the name of a phantom (``FORBILD_WIDTHS``). The lists (several hundred solids) are
    data for the caller to supply, as solids or as the path of a table of them; this function scales them and leaves
    out solids that are thinner than half a voxel or have a negative amplitude.
    """
    grid, top = Grid((n, n, n)), n - 1
    width = FORBILD_WIDTHS[width] if isinstance(width, str) else width
    solids = read_solids(spark, solids) if isinstance(solids, str) else solids
    length = lambda v: v * top / width
    place = lambda v: _half_up((v + width / 2) * top / width)
    out = []
    for s in solids:
        half = tuple(length(h) for h in s.half)
        if min(half) >= 0.5 and s.amplitude >= 0:
            clip = None if s.clip_x is None else place(s.clip_x)
            out.append(Solid(s.kind, s.amplitude, tuple(place(c) for c in s.centre), half, s.euler, s.axis, clip, s.order))
    return rasterize(spark, grid, out, OVERWRITE)


def no_noise(v: Vector) -> Vector:
    return v


def gaussian_noise(v: Vector, mean: float, stddev: float, seed: int = 0) -> Vector:
    """Adds normal noise; the same seed and partitioning give the same noise."""
    return v.map(lambda x: x + F.randn(seed) * float(stddev) + float(mean))


def poisson_noise(v: Vector, mean: float, seed: int = 0) -> Vector:
    """Adds waiting times of a Poisson process with the given rate (exponential noise)."""
    return v.map(lambda x: x - F.ln(1 - F.rand(seed)) / float(mean))
