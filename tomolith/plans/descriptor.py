"""Shapes of vectors: grids, blocks and detectors, as immutable driver-side values.

Element (c0, c1, ..) of a grid has index c0 + c1*n0 + c2*n0*n1 + .. (dimension 0 fastest).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError


@dataclass(frozen=True)
class Grid:
    """A plain n-dimensional grid."""

    shape: tuple[int, ...]
    spacing: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if not self.shape or any(n <= 0 for n in self.shape):
            raise InvalidArgumentError("sizes must be positive")
        spacing = tuple(float(s) for s in self.spacing) or (1.0,) * len(self.shape)
        if len(spacing) != len(self.shape):
            raise InvalidArgumentError("one spacing for each dimension is needed")
        if any(s < 0 for s in spacing):
            raise InvalidArgumentError("spacing must not be negative")
        object.__setattr__(self, "spacing", spacing)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(itertools.accumulate((1, *self.shape[:-1]), lambda a, b: a * b))

    @property
    def origin(self) -> tuple[float, ...]:
        return tuple(0.5 * n * s for n, s in zip(self.shape, self.spacing, strict=True))

    def index(self, coordinate: Sequence[int]) -> int:
        return sum(c * s for c, s in zip(coordinate, self.strides, strict=True))

    def coordinate(self, index: int) -> tuple[int, ...]:
        return tuple(index // s % n for s, n in zip(self.strides, self.shape, strict=True))

    def column(self, idx: Column, dim: int) -> Column:
        """The coordinate ``dim`` of an index column."""
        s = self.strides[dim]
        whole = idx if s == 1 else ((idx - idx % s) / s).cast("long")
        return whole if dim == self.ndim - 1 else whole % self.shape[dim]


def _total(parts: Sequence[Grid]) -> int:
    return sum(p.size for p in parts)


@dataclass(frozen=True)
class Blocks(Grid):
    """Blocks one after the other; ``parts`` are their grids."""

    parts: tuple[Grid, ...] = field(default=())

    @property
    def offsets(self) -> tuple[int, ...]:
        return tuple(itertools.accumulate((0, *(p.size for p in self.parts[:-1]))))

    @property
    def identical(self) -> bool:
        return len(set(self.parts)) == 1

    def block_column(self, idx: Column) -> Column:
        """The number of the block that an index lies in."""
        if self.identical:
            return F.floor(idx / self.parts[0].size).cast("int")
        out = F.lit(0)
        for b, o in list(enumerate(self.offsets))[1:]:
            out = F.when(idx >= o, b).otherwise(out)
        return out


def identical_blocks(grid: Grid, n: int) -> Blocks:
    if n <= 0:
        raise InvalidArgumentError("at least one block is needed")
    return Blocks((*grid.shape, n), (*grid.spacing, 1.0), (grid,) * n)


def partition(grid: Grid, n: int | Sequence[int]) -> Blocks:
    """Slabs of the last dimension: ``n`` of nearly equal size (larger ones last), or of given sizes."""
    last = grid.shape[-1]
    if isinstance(n, int):
        if not 0 < n <= last:
            raise InvalidArgumentError("cannot cut into so many slabs")
        sizes = [last // n + (i >= n - last % n) for i in range(n)]
    else:
        sizes = list(n)
        if sum(sizes) != last or any(s <= 0 for s in sizes):
            raise InvalidArgumentError("slabs must add up to the last dimension")
    return Blocks(grid.shape, grid.spacing, tuple(Grid((*grid.shape[:-1], s), grid.spacing) for s in sizes))


def random_blocks(parts: Sequence[Grid]) -> Blocks:
    if not parts:
        raise InvalidArgumentError("at least one block is needed")
    return Blocks((_total(parts),), (), tuple(parts))


def best_common(*grids: Grid) -> Grid:
    """The descriptor that a sum or a stack of the given ones has."""
    if len(grids) == 1 and isinstance(grids[0], (list, tuple)):
        grids = tuple(grids[0])
    if not grids:
        raise InvalidArgumentError("no descriptors")
    first = grids[0]
    if all(g == first and type(g) is type(first) for g in grids):
        return first
    if all(g.shape == first.shape for g in grids):
        return Grid(first.shape, first.spacing if all(g.spacing == first.spacing for g in grids) else ())
    if all(g.size == first.size for g in grids):
        return Grid((first.size,))
    raise InvalidArgumentError("descriptors of different sizes have nothing in common")


def best_block(grids: Sequence[Grid]) -> Blocks:
    """Slabs of one grid if all but the last dimension agree, else a flat sequence of blocks."""
    first = grids[0]
    if all(g == first for g in grids):
        return identical_blocks(first, len(grids))
    if all(g.ndim == first.ndim and g.shape[:-1] == first.shape[:-1] and g.spacing == first.spacing for g in grids):
        return partition(Grid((*first.shape[:-1], sum(g.shape[-1] for g in grids)), first.spacing), [g.shape[-1] for g in grids])
    return random_blocks(grids)


def cartesian_indices(lower: Sequence[int], upper: Sequence[int]) -> Iterator[tuple[int, ...]]:
    """Half-open box of coordinates, last dimension fastest."""
    return itertools.product(*(range(a, b) for a, b in zip(lower, upper, strict=True)))


def neighbours_in_slice(position: Sequence[int], distance: int | Sequence[int], leading: int, lower: Sequence[int] | None = None, upper: Sequence[int] | None = None) -> list[tuple[int, ...]]:
    """The box around a position, flat along the leading dimension, optionally clamped to [lower, upper)."""
    reach = [distance] * len(position) if isinstance(distance, int) else list(distance)
    reach[leading] = 0
    low = [p - r for p, r in zip(position, reach, strict=True)]
    high = [p + r + 1 for p, r in zip(position, reach, strict=True)]
    if lower is not None:
        low = [max(a, b) for a, b in zip(low, lower, strict=True)]
    if upper is not None:
        high = [min(a, b) for a, b in zip(high, upper, strict=True)]
    return list(cartesian_indices(low, high))
