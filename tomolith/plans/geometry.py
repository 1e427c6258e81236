"""Acquisition geometry: poses, detectors, trajectories. Poses are small driver-side values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tomolith.errors import InvalidArgumentError

from .descriptor import Grid


@dataclass(frozen=True, eq=False)
class Pose:
    """One source and detector position: rotation R, translation t, intrinsics K, scaling S."""

    rotation: np.ndarray
    translation: np.ndarray
    intrinsic: np.ndarray
    scaling: np.ndarray
    sdd: float
    projection: np.ndarray = field(init=False)
    inverse: np.ndarray = field(init=False)
    extrinsic: np.ndarray = field(init=False)
    centre: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        d = len(self.rotation)
        rigid = np.eye(d + 1)
        rigid[:d, :d], rigid[:d, d] = self.rotation, self.translation
        full = rigid @ self.scaling
        p = self.intrinsic @ full[:d]
        back = np.linalg.inv(rigid)[:, :d] @ np.linalg.inv(self.intrinsic)
        for name, value in (("projection", p), ("extrinsic", full[:d]), ("centre", -np.linalg.solve(p[:, :d], p[:, d])), ("inverse", back / np.diag(self.scaling)[:, None])):
            object.__setattr__(self, name, value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Pose) and np.array_equal(self.projection, other.projection) and self.sdd == other.sdd

    __hash__ = None

    def rays(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Origin and unit directions of the rays through detector points (n x dim-1), in voxel units."""
        d = len(self.rotation)
        direction = np.c_[pixels, np.ones(len(pixels))] @ self.inverse[:d].T
        return self.centre, direction / np.linalg.norm(direction, axis=1, keepdims=True)

    def project(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Detector coordinates and magnification of volume points (n x dim)."""
        h = np.c_[points, np.ones(len(points))]
        q = h @ self.projection.T
        return q[:, :-1] / q[:, -1:], self.sdd / np.linalg.norm(h @ self.extrinsic.T, axis=1)


def pose_2d(angle: float, s2c: float, c2d: float, volume: Grid, detector: Grid, principal: float = 0.0, offset: Sequence[float] = (0.0, 0.0)) -> Pose:
    c, s = math.cos(angle), math.sin(angle)
    r = np.array([[c, -s], [s, c]])
    t = r @ (-np.asarray(offset, float) - volume.origin)
    t[-1] += s2c
    a = detector.spacing[0]
    k = np.array([[(s2c + c2d) / a, detector.origin[0] / a + principal], [0.0, 1.0]])
    return Pose(r, t, k, np.diag([*volume.spacing, 1.0]), s2c + c2d)


def pose_3d(gamma: float, beta: float, alpha: float, s2c: float, c2d: float, volume: Grid, detector: Grid, principal: Sequence[float] = (0.0, 0.0), offset: Sequence[float] = (0.0, 0.0, 0.0), rotation: np.ndarray | None = None) -> Pose:
    """Rotation about y by alpha, then z by beta, then y by gamma; or a given matrix."""

    def about_y(w: float) -> np.ndarray:
        return np.array([[math.cos(w), 0, math.sin(w)], [0, 1, 0], [-math.sin(w), 0, math.cos(w)]])

    def about_z(w: float) -> np.ndarray:
        return np.array([[math.cos(w), -math.sin(w), 0], [math.sin(w), math.cos(w), 0], [0, 0, 1]])

    r = about_y(gamma) @ about_z(beta) @ about_y(alpha) if rotation is None else np.asarray(rotation, float)
    t = r @ (-np.asarray(offset, float) - volume.origin)
    t[-1] += s2c
    k = np.eye(3)
    for i in (0, 1):
        k[i, i] = (s2c + c2d) / detector.spacing[i]
        k[i, 2] = detector.origin[i] / detector.spacing[i] + principal[i]
    return Pose(r, t, k, np.diag([*volume.spacing, 1.0]), s2c + c2d)


@dataclass(frozen=True)
class Detector(Grid):
    """A flat detector; the last dimension counts the poses."""

    poses: tuple[Pose, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.poses and len(self.poses) != self.shape[-1]:
            raise InvalidArgumentError("one pose for each detector position is needed")

    @property
    def pixels(self) -> Grid:
        return Grid(self.shape[:-1], self.spacing[:-1])

    def points(self, pixel: np.ndarray) -> np.ndarray:
        """Centres of pixels given by their index within a pose."""
        shape = self.shape[:-1]
        return np.stack(np.unravel_index(pixel, shape, order="F"), 1) + 0.5

    def subset(self, poses: Sequence[int]) -> Detector:
        return type(self)((*self.shape[:-1], len(poses)), self.spacing, tuple(self.poses[i] for i in poses), *self._more())

    def _more(self) -> tuple:
        return ()

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each pose, matrices as flat arrays."""
        rows = [(i, p.projection.ravel().tolist(), p.inverse.ravel().tolist(), p.centre.tolist(), p.extrinsic.ravel().tolist(), float(p.sdd)) for i, p in enumerate(self.poses)]
        return spark.createDataFrame(rows, "pose int, P array<double>, Pinv array<double>, C array<double>, ext array<double>, sdd double")


@dataclass(frozen=True)
class CurvedDetector(Detector):
    """A cylinder section: its pixels are carried to the flat detector through the source."""

    angle: float = 0.0
    s2d: float = 0.0

    def _more(self) -> tuple:
        return self.angle, self.s2d

    def points(self, pixel: np.ndarray) -> np.ndarray:
        flat = super().points(pixel)
        n = self.shape[0]
        radius, centre = n / self.angle, n / 2
        w = (flat[:, 0] - centre) * self.angle / n
        dx, depth = np.sin(w) * radius, self.s2d - radius + np.cos(w) * radius
        factor = np.where(depth == 0, 1.0, self.s2d / np.where(depth == 0, 1.0, depth))
        out = flat.copy()
        out[:, 0] = dx * factor + centre
        if flat.shape[1] == 2:
            middle = self.shape[1] / 2
            out[:, 1] = (flat[:, 1] - middle) * factor + middle
        return out


def _detector_grid(volume: Grid, n: int, size: Sequence[int] | None, spacing: Sequence[float] | None) -> Grid:
    """By default the detector is sqrt(2) times as wide as the volume."""
    size = tuple(size) if size is not None else tuple(int(np.float32(s) * np.float32(math.sqrt(2))) for s in volume.shape[:-1])
    spacing = tuple(spacing) if spacing is not None else volume.spacing[:-1]
    return Grid((*size, n), (*spacing, 1.0))


def trajectory_from_angles(degrees: Sequence[float], volume: Grid, s2c: float, c2d: float, principal=None, offset=None, size=None, spacing=None) -> Detector:
    if volume.ndim not in (2, 3):
        raise InvalidArgumentError("trajectories are for two or three dimensions")
    grid = _detector_grid(volume, len(degrees), size, spacing)
    angles = np.deg2rad(np.asarray(degrees, float))
    if volume.ndim == 2:
        poses = tuple(pose_2d(a, s2c, c2d, volume, grid, 0.0 if principal is None else principal[0], (0.0, 0.0) if offset is None else offset) for a in angles)
    else:
        poses = tuple(pose_3d(a, 0.0, 0.0, s2c, c2d, volume, grid, principal or (0.0, 0.0), offset or (0.0, 0.0, 0.0)) for a in angles)
    return Detector(grid.shape, grid.spacing, poses)


def circle_trajectory(n: int, volume: Grid, arc: float, s2c: float, c2d: float, **more) -> Detector:
    """n poses on an arc in degrees, both ends included."""
    return trajectory_from_angles(np.linspace(0, arc, n), volume, s2c, c2d, **more)


def curved_circle_trajectory(n: int, volume: Grid, arc: float, s2c: float, c2d: float, fan: float, **more) -> CurvedDetector:
    flat = circle_trajectory(n, volume, arc, s2c, c2d, **more)
    return CurvedDetector(flat.shape, flat.spacing, flat.poses, fan, s2c + c2d)


def sphere_trajectory(n: int, volume: Grid, circles: int, s2c: float, c2d: float) -> Detector:
    """Poses spread over parallel circles in proportion to their circumference; the last takes the rest."""
    if volume.ndim != 3:
        raise InvalidArgumentError("sphere trajectories are three-dimensional")
    grid = _detector_grid(volume, n, None, None)
    beta = math.pi * (np.arange(circles) + 1) / (circles + 2) - math.pi / 2
    length = 2 * math.pi * c2d * np.cos(beta)
    count = (length / (length.sum() / n)).astype(int)
    count[-1] = n - count[:-1].sum()
    poses = tuple(pose_3d(2 * math.pi * j / m, b, 0.0, s2c, c2d, volume, grid) for b, m in zip(beta, count, strict=True) for j in range(m))
    return Detector(grid.shape, grid.spacing, poses)


def limited_angle_trajectory(n: int, wedge: tuple[float, float], volume: Grid, arc: float, s2c: float, c2d: float, mirrored: bool = True) -> Detector:
    """Poses on an arc without those in the missing wedge (degrees), nor 180 degrees on if mirrored."""
    if volume.ndim != 2:
        raise InvalidArgumentError("limited-angle trajectories are two-dimensional")
    low, high = wedge
    step = (arc - (high - low) * (2 if mirrored else 1)) / n
    angles = np.arange(math.ceil(arc / step)) * step
    angles = angles[angles < arc]
    out = (angles >= low) & (angles <= high)
    if mirrored:
        out |= (angles >= low + 180) & (angles <= high + 180)
    angles = angles[~out]
    grid = _detector_grid(volume, len(angles), None, None)
    return Detector(grid.shape, grid.spacing, tuple(pose_2d(a, s2c, c2d, volume, grid) for a in np.deg2rad(angles)))


ROUND_ROBIN, ROTATIONAL_CLUSTERING = "round robin", "rotational clustering"


def rotational_distance(a: Pose, b: Pose) -> float:
    product = a.rotation @ b.rotation.T
    if len(product) == 2:
        return math.atan2(product[1, 0], product[0, 0])
    return math.acos(min(1.0, max(-1.0, (np.trace(product) - 1) / 2)))


def subsets(detector: Detector, n: int, strategy: str = ROUND_ROBIN) -> list[list[int]]:
    """Poses dealt to n subsets, in their order or in order of rotation from the first pose."""
    if n < 2:
        raise InvalidArgumentError("two subsets at least")
    order = list(range(len(detector.poses)))
    if strategy == ROTATIONAL_CLUSTERING:
        order.sort(key=lambda i: (rotational_distance(detector.poses[0], detector.poses[i]), i))
    return [order[k::n] for k in range(n)]
