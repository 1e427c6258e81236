"""X-ray projectors: rays or voxels traced in NumPy batches on the executors into a relation (row, col, w).

Tracing is a table function over an index range (``mapInPandas``), run once per operator (its
entries are persisted until ``unpersist``); the
forward and the back projection are then the two directions of one relation, so they match.
Rays are in voxel units; voxel k covers [k, k+1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions import basis as B
from tomolith.plans import geometry as G
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector

from .linear import Relation

#: Rays or voxels handled at once by a worker.
BATCH = 2048
_EPS = 1e-12


def box_hits(origin: np.ndarray, direction: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry and exit parameters of rays (n x d) through [0, shape], and whether they hit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = -origin / direction, (shape - origin) / direction
    flat = np.abs(direction) < _EPS
    inside = (origin >= 0) & (origin < shape)
    low = np.where(flat, np.where(inside, -np.inf, np.inf), np.minimum(a, b))
    high = np.where(flat, np.where(inside, np.inf, -np.inf), np.maximum(a, b))
    first, last = low.max(1), high.min(1)
    return first, last, (last >= np.maximum(first, 0)) & ~((first == 0) & (last == 0)) & np.isfinite(first)


def siddon(origin: np.ndarray, direction: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, voxel index, length) of all voxels that rays cross, from the sorted crossings of grid planes."""
    size = np.array(shape, float)
    strides = np.cumprod([1, *shape[:-1]])
    first, last, hit = box_hits(origin, direction, size)
    rays = np.flatnonzero(hit & (last > first))
    if not len(rays):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    o, d, first, last = origin[rays], direction[rays], np.maximum(first[rays], 0), last[rays]
    cuts = [first[:, None], last[:, None]]
    for k, n in enumerate(shape):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (np.arange(n + 1)[None, :] - o[:, k : k + 1]) / d[:, k : k + 1]
        cuts.append(np.where(np.isfinite(t), t, first[:, None]))
    t = np.sort(np.clip(np.concatenate(cuts, 1), first[:, None], last[:, None]), axis=1)
    length = np.diff(t, axis=1)
    ray, seg = np.nonzero(length > 1e-9)
    middle = (t[ray, seg] + t[ray, seg + 1]) / 2
    voxel = np.floor(o[ray] + middle[:, None] * d[ray]).astype(np.int64)
    ok = ((voxel >= 0) & (voxel < size)).all(1)
    return rays[ray[ok]], (voxel[ok] * strides).sum(1), length[ray[ok], seg[ok]]


def _slices(origin: np.ndarray, direction: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every slice along each ray's dominant axis: (ray, axis, slice number, position at the slice's centre)."""
    size = np.array(shape, float)
    first, last, hit = box_hits(origin, direction, size)
    rays = np.flatnonzero(hit & (last > first))
    axis = np.abs(direction[rays]).argmax(1)
    pick = np.arange(len(rays))
    o, d = origin[rays], direction[rays]
    enter = o[pick, axis] + np.maximum(first[rays], 0) * d[pick, axis]
    leave = o[pick, axis] + last[rays] * d[pick, axis]
    low = np.floor(np.minimum(enter, leave) + 1e-9).astype(np.int64)
    high = np.ceil(np.maximum(enter, leave) - 1e-9).astype(np.int64)
    count = np.maximum(high - low, 0)
    at = np.repeat(pick, count)
    number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + low[at]
    t = (number + 0.5 - o[at, axis[at]]) / d[at, axis[at]]
    position = o[at] + t[:, None] * d[at]
    position[np.arange(len(at)), axis[at]] = number + 0.5
    return rays[at], axis[at], number, position


def joseph(origin: np.ndarray, direction: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, voxel, weight): linear interpolation in each slice, times the step length; outside counts 0."""
    size, strides = np.array(shape), np.cumprod([1, *shape[:-1]])
    ray, axis, number, position = _slices(origin, direction, shape)
    step = 1 / np.abs(direction[ray, axis])
    low = np.floor(position - 0.5).astype(np.int64)
    part = position - 0.5 - low
    low[np.arange(len(ray)), axis] = number
    out = []
    for corner in range(1 << len(shape)):
        up = np.array([corner >> k & 1 for k in range(len(shape))])
        driven = up[axis] == 1
        w = np.where(up, part, 1 - part)
        w[np.arange(len(ray)), axis] = 1.0
        voxel, w = low + up, w.prod(1) * step
        ok = ~driven & ((voxel >= 0) & (voxel < size)).all(1) & (w > 1e-12)
        out.append((ray[ok], (voxel[ok] * strides).sum(1), w[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def around_rays(origin: np.ndarray, direction: np.ndarray, shape: tuple[int, ...], lut: B.Lut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, voxel, weight): a radial weight of the distance between voxel centres and ray, slice by slice."""
    size, strides = np.array(shape), np.cumprod([1, *shape[:-1]])
    reach = math.ceil(lut.support)
    grown = tuple(n + 2 * reach for n in shape)
    ray, axis, number, position = _slices(origin + reach, direction, grown)
    low = np.floor(position).astype(np.int64) - reach
    number = number - reach
    low[np.arange(len(ray)), axis] = number
    out = []
    for offset in np.ndindex(*([2 * reach + 1] * len(shape))):
        move = np.array(offset) - reach
        flat = move[axis] == 0
        voxel = low + move
        ok = flat & ((voxel >= 0) & (voxel < size)).all(1)
        r, v = ray[ok], voxel[ok]
        away = v + 0.5 - origin[r]
        distance = np.sqrt(np.maximum((away**2).sum(1) - ((away * direction[r]).sum(1)) ** 2, 0))
        w = lut(distance)
        some = w != 0
        out.append((r[some], (v[some] * strides).sum(1), w[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(n: int, spark: SparkSession, trace) -> DataFrame:  # noqa: ANN001
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for i in range(0, len(ids), BATCH):
                row, col, w = trace(ids[i : i + BATCH])
                yield pd.DataFrame({"row": row.astype(np.int64), "col": col.astype(np.int64), "w": w.astype(float)})

    parts = max(1, min(n // BATCH + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, n, 1, parts).mapInPandas(work, "row long, col long, w double")


def visited(origin: np.ndarray, direction: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ray, col, _ = siddon(origin, direction, shape)
    return ray, col, np.ones(len(ray))


class RayProjector(Relation):
    """Base of the ray-driven projectors: ``tracer`` gives the function that traces a batch of rays."""

    def tracer(self) -> Callable:
        raise NotImplementedError

    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession):
        if volume.ndim not in (2, 3) or detector.ndim != volume.ndim:
            raise InvalidArgumentError("volume and detector must both have two or three dimensions")
        if not detector.poses:
            raise InvalidArgumentError("a detector with poses is needed")
        per_pose, shape, weights = detector.pixels.size, volume.shape, self.tracer()
        self.volume, self.detector, self.spark = volume, detector, spark

        def trace(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            out = []
            for pose in np.unique(ids // per_pose):
                mine = ids[ids // per_pose == pose]
                source, direction = detector.poses[pose].rays(detector.points(mine % per_pose))
                ray, col, w = weights(np.repeat(source[None, :], len(mine), 0), direction, shape)
                out.append((mine[ray], col, w))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        super().__init__(_rows(detector.size, spark, trace).persist(), volume, detector)


class BinaryMethod(RayProjector):
    """1 for every voxel a ray visits."""

    def tracer(self) -> Callable:
        return visited


class SiddonsMethod(RayProjector):
    """The length of the ray inside each voxel."""

    def tracer(self) -> Callable:
        return siddon


class JosephsMethod(RayProjector):
    """Linear interpolation in the slices across the dominant axis."""

    def tracer(self) -> Callable:
        return joseph


class BlobProjector(RayProjector):
    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession, radius: float = 2.0, alpha: float = 10.83, order: int = 2):
        self.lut = B.Lut(lambda s: B.blob_projected(s, radius, alpha, order), radius)
        super().__init__(volume, detector, spark)

    def tracer(self) -> Callable:
        return partial(around_rays, lut=self.lut)


class BSplineProjector(RayProjector):
    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession, order: int = 2):
        self.lut = B.Lut(lambda s: B.bspline_projected(s, order, volume.ndim), 2.0)
        super().__init__(volume, detector, spark)

    def tracer(self) -> Callable:
        return partial(around_rays, lut=self.lut)


class VoxelProjector(Relation):
    """Voxel-driven: each voxel reaches the detector pixels within its projected radius."""

    def _lut(self, dim: int) -> B.Lut:
        raise NotImplementedError

    @staticmethod
    def _weight(lut: B.Lut, away: np.ndarray) -> np.ndarray:
        return lut(np.linalg.norm(away, axis=1))

    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession):
        if volume.ndim not in (2, 3) or detector.ndim != volume.ndim:
            raise InvalidArgumentError("volume and detector must both have two or three dimensions")
        lut, weight, per_pose, shape = self._lut(volume.ndim), self._weight, detector.pixels.size, detector.shape[:-1]
        strides = np.cumprod([1, *shape[:-1]])
        self.volume, self.detector, self.spark = volume, detector, spark

        def trace(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            points = np.stack(np.unravel_index(ids, volume.shape, order="F"), 1) + 0.5
            rows, cols, ws = [], [], []
            for k, pose in enumerate(detector.poses):
                centre, scale = pose.project(points)
                centre = centre - 0.5
                radius = lut.support * scale
                low = np.ceil(centre - radius[:, None]).astype(np.int64)
                high = np.floor(centre + radius[:, None]).astype(np.int64)
                low, high = np.maximum(low, 0), np.minimum(high, np.array(shape) - 1)
                span = np.maximum(high - low + 1, 0)
                for offset in np.ndindex(*span.max(0)):
                    pixel = low + np.array(offset)
                    ok = (pixel <= high).all(1)
                    w = weight(lut, (centre[ok] - pixel[ok]) / scale[ok, None])
                    some = w != 0
                    rows.append(k * per_pose + (pixel[ok][some] * strides).sum(1))
                    cols.append(ids[ok][some])
                    ws.append(w[some])
            empty = np.zeros(0)
            return np.concatenate([empty, *rows]), np.concatenate([empty, *cols]), np.concatenate([empty, *ws])

        super().__init__(_rows(volume.size, spark, trace).persist(), volume, detector)


class BlobVoxelProjector(VoxelProjector):
    RADIUS, ALPHA, ORDER = 2.0, 10.83, 2

    def _lut(self, dim: int) -> B.Lut:
        return B.Lut(lambda s: B.blob_projected(s, self.RADIUS, self.ALPHA, self.ORDER), self.RADIUS)


class BSplineVoxelProjector(VoxelProjector):
    ORDER = 2

    def _lut(self, dim: int) -> B.Lut:
        return B.Lut(lambda s: B.bspline_projected(s, self.ORDER, dim), 2.0)


def _signed(lut: B.Lut, away: np.ndarray) -> np.ndarray:
    return lut(np.abs(away[:, 0])) * np.sign(away[:, 0])


def _first_component(lut: B.Lut, away: np.ndarray) -> np.ndarray:
    return lut(np.linalg.norm(away, axis=1)) * away[:, 0]


class PhaseContrastBlobVoxelProjector(BlobVoxelProjector):
    """Derivative weights along the first detector axis."""

    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession):
        self._weight = _signed if volume.ndim == 2 else _first_component
        super().__init__(volume, detector, spark)

    def _lut(self, dim: int) -> B.Lut:
        f = B.blob_derivative_projected if dim == 2 else B.blob_gradient_projected
        return B.Lut(lambda s: f(s, self.RADIUS, self.ALPHA, self.ORDER), self.RADIUS)


class PhaseContrastBSplineVoxelProjector(BSplineVoxelProjector):
    def __init__(self, volume: Grid, detector: G.Detector, spark: SparkSession):
        self._weight = _signed if volume.ndim == 2 else _first_component
        super().__init__(volume, detector, spark)

    def _lut(self, dim: int) -> B.Lut:
        def f(s: np.ndarray) -> np.ndarray:
            d = B.bspline_derivative_projected(s, self.ORDER, dim)
            if dim == 2:
                return d
            small = np.abs(s) < 1e-6
            slope = B.bspline_derivative_projected(np.array([1e-6]), self.ORDER, dim)[0] / 1e-6
            return np.where(small, slope, d / np.where(small, 1.0, s))

        return B.Lut(f, 2.0)


class SubsetSampler:
    """Ordered subsets of poses: data, projectors and least-squares parts for each."""

    def __init__(self, volume: Grid, detector: G.Detector, n: int, strategy: str = G.ROUND_ROBIN):
        self.volume, self.detector = volume, detector
        self.indices = G.subsets(detector, n, strategy)

    def data(self, sinogram: Vector) -> list[Vector]:
        """The measurements of each subset, poses in subset order."""
        per_pose, out = self.detector.pixels.size, []
        for poses in self.indices:
            place = F.create_map(*[F.lit(x) for pair in ((p, i) for i, p in enumerate(poses)) for x in pair])
            pose = F.floor(F.col("idx") / per_pose).cast("int")
            rows = sinogram.df.where(pose.isin(poses)).select((place[pose] * F.lit(per_pose).cast("long") + F.col("idx") % per_pose).alias("idx"), "val")
            out.append(Vector(rows, self.detector.subset(poses)))
        return out

    def projectors(self, kind: type, spark: SparkSession, **more) -> list[Relation]:
        return [kind(self.volume, self.detector.subset(poses), spark, **more) for poses in self.indices]
