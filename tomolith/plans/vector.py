"""Dense vectors as DataFrames (idx, val) with a descriptor; every operation is one lazy plan.

The contract: each idx in [0, size) occurs exactly once. Complex values are structs (re, im).
Two vectors meet by an equi-join on idx; the right side is broadcast only while the
descriptor proves it small (``BROADCAST_ROWS``), else both sides are hash-partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomolith.errors import BadCastError, InvalidArgumentError, OutOfRangeError
from tomolith.functions import columns as C

from .descriptor import Blocks, Grid, random_blocks
from .storage import saved_as_dealt

#: Rows of (idx, val) that a join may broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000
#: Rows of a vector that an iteration may hold on the driver: 1 MB. Larger ones are checkpointed.
LOCAL_ROWS = 65_536


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its proven number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True, eq=False)
class Vector:
    df: DataFrame
    desc: Grid
    #: The values in index order, held by the driver too: only of saved vectors of up to ``LOCAL_ROWS`` rows.
    local: np.ndarray | None = None

    # --- sources -------------------------------------------------------------------
    @staticmethod
    def full(spark: SparkSession, desc: Grid, value: float = 0.0) -> Vector:
        return Vector(spark.range(desc.size).select(F.col("id").alias("idx"), F.lit(float(value)).alias("val")), desc)

    @staticmethod
    def from_array(spark: SparkSession, array: np.ndarray, desc: Grid | None = None) -> Vector:
        """From a NumPy array of any memory order; dimension 0 is the fastest."""
        a = np.asarray(array)
        desc = desc or Grid(a.shape)
        if a.size != desc.size:
            raise InvalidArgumentError("array and descriptor differ in size")
        flat = a.ravel(order="F")
        if np.iscomplexobj(flat):
            parts = [pa.array(np.ascontiguousarray(x, float)) for x in (flat.real, flat.imag)]
            val = pa.StructArray.from_arrays(parts, names=["re", "im"])
        else:
            flat = flat.astype(float)
            val = pa.array(flat)
        return Vector(spark.createDataFrame(pa.table({"idx": pa.array(np.arange(a.size)), "val": val})), desc, flat if a.size <= LOCAL_ROWS else None)

    @staticmethod
    def generate(spark: SparkSession, desc: Grid, value: Callable[[Column], Column]) -> Vector:
        """``value`` of the index column, computed on the executors."""
        return Vector(spark.range(desc.size).select(F.col("id").alias("idx"), value(F.col("id")).alias("val")), desc)

    # --- facts -----------------------------------------------------------------------
    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def is_complex(self) -> bool:
        return isinstance(self.df.schema["val"].dataType, T.StructType)

    @property
    def size(self) -> int:
        return self.desc.size

    @property
    def blocks(self) -> int:
        return len(self.desc.parts) if isinstance(self.desc, Blocks) else 1

    def validate(self) -> Vector:
        n, low, high, distinct = self.df.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
        if (n, distinct) != (self.size, self.size) or (low, high) != (0, self.size - 1):
            raise InvalidArgumentError("a vector needs every index of its descriptor exactly once")
        return self

    def same_shape(self, other: Vector) -> bool:
        """Equality of descriptors; values are compared by ``allclose``."""
        return type(self.desc) is type(other.desc) and self.desc == other.desc

    def allclose(self, other: Vector, tolerance: float = 1e-9) -> bool:
        d = self - other
        scale = max(1.0, float(other.linf()))
        return d.linf() <= tolerance * scale

    def to_array(self) -> np.ndarray:
        """To the driver, in index order."""
        rows = self.df.orderBy("idx").toPandas()["val"]
        flat = np.array([complex(*v) for v in rows]) if self.is_complex else rows.to_numpy(float)
        return flat.reshape(self.desc.shape, order="F")

    def iterate(self) -> Iterator:
        for row in self.df.orderBy("idx").toLocalIterator():
            yield row["val"]

    def format(self, limit: int = 8) -> str:
        """A short text: the first and last values of a long vector."""
        n = self.size
        ends = self.df.where((F.col("idx") < limit) | (F.col("idx") >= n - limit)).orderBy("idx").collect()
        show = [f"{r['val']:.4g}" if not self.is_complex else str(complex(*r["val"])) for r in ends]
        inner = show if n <= 2 * limit else [*show[:limit], "...", *show[limit:]]
        return f"Vector{self.desc.shape}[{', '.join(inner)}]"

    def saved(self) -> Vector:
        """Cut from its lineage: on the driver while the descriptor proves it small, else a checkpoint."""
        if self.local is not None:
            return self
        if self.size > LOCAL_ROWS:
            return Vector(saved_as_dealt(self.df), self.desc)
        t = self.df.toArrow().combine_chunks()
        idx, val = t.column("idx").to_numpy(), t.column("val").combine_chunks()
        values = val.field("re").to_numpy(zero_copy_only=False) + 1j * val.field("im").to_numpy(zero_copy_only=False) if self.is_complex else val.to_numpy(zero_copy_only=False)
        flat = np.zeros(self.size, values.dtype)
        flat[idx] = values
        return Vector.from_array(self.spark, flat, self.desc)

    def saved_norm(self) -> tuple[Vector, float]:
        """Saved, and the squared length, in one job."""
        if self.size <= LOCAL_ROWS:
            v = self.saved()
            return v, v.squared_l2()
        seen = Observation()
        v = Vector(saved_as_dealt(self.df.observe(seen, self._squares().alias("n"))), self.desc)
        return v, float(seen.get["n"] or 0.0)

    # --- element-wise ----------------------------------------------------------------
    def map(self, f: Callable[[Column], Column]) -> Vector:
        return Vector(self.df.select("idx", f(F.col("val")).alias("val")), self.desc)

    def zip(self, other: Vector, f: Callable[[Column, Column], Column]) -> Vector:
        if self.size != other.size:
            raise InvalidArgumentError("vectors differ in size")
        right = small(other.df.select("idx", F.col("val").alias("_other")), other.size)
        return Vector(self.df.join(right, "idx").select("idx", f(F.col("val"), F.col("_other")).alias("val")), self.desc)

    def _binary(self, other: Vector | float, f: Callable, g: Callable | None = None) -> Vector:
        """f for real values, g for complex ones."""
        both = isinstance(other, Vector)
        if self.local is not None and f is not C.div0 and (not both or other.local is not None):
            if both and self.size != other.size:
                raise InvalidArgumentError("vectors differ in size")
            return Vector.from_array(self.spark, f(self.local, other.local if both else other), self.desc)
        if self.is_complex or (both and other.is_complex) or isinstance(other, complex):
            if g is None:
                raise BadCastError("not defined for complex values")
            up = lambda v, is_complex: v if is_complex else C.complex_of(v)
            if both:
                return self.zip(other, lambda a, b: g(up(a, self.is_complex), up(b, other.is_complex)))
            z = complex(other)
            return self.map(lambda a: g(up(a, self.is_complex), C.complex_of(F.lit(z.real), F.lit(z.imag))))
        return self.zip(other, f) if both else self.map(lambda a: f(a, F.lit(float(other))))

    def __add__(self, other: Vector | float) -> Vector:
        return self._binary(other, lambda a, b: a + b, lambda a, b: C.complex_of(a["re"] + b["re"], a["im"] + b["im"]))

    def __sub__(self, other: Vector | float) -> Vector:
        return self._binary(other, lambda a, b: a - b, lambda a, b: C.complex_of(a["re"] - b["re"], a["im"] - b["im"]))

    def __mul__(self, other: Vector | float) -> Vector:
        return self._binary(other, lambda a, b: a * b, C.times)

    def __truediv__(self, other: Vector | float) -> Vector:
        def over(a: Column, b: Column) -> Column:
            n = b["re"] * b["re"] + b["im"] * b["im"]
            z = C.times(a, C.conj(b))
            return C.complex_of(C.div0(z["re"], n), C.div0(z["im"], n))

        return self._binary(other, C.div0, over)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, s: float) -> Vector:
        return (-self) + s

    def __rtruediv__(self, s: float) -> Vector:
        return self.map(lambda v: C.div0(F.lit(float(s)), v))

    def __neg__(self) -> Vector:
        return self.map(lambda v: C.complex_of(-v["re"], -v["im"]) if self.is_complex else -v)

    def __pos__(self) -> Vector:
        return self

    def filled(self, s: float) -> Vector:
        return self.map(lambda _: F.lit(float(s)))

    def square(self) -> Vector:
        return self * self

    def sqrt(self) -> Vector:
        return self.map(F.sqrt)

    def exp(self) -> Vector:
        return self.map(F.exp)

    def log(self) -> Vector:
        return self.map(C.ln0)

    def abs(self) -> Vector:
        return self.map(C.magnitude if self.is_complex else F.abs)

    def sign(self) -> Vector:
        return self.map(C.complex_sign if self.is_complex else C.sign)

    def clip(self, low: float, high: float) -> Vector:
        return self.map(lambda v: C.clip(v, F.lit(float(low)), F.lit(float(high))))

    def minimum(self, s: float) -> Vector:
        return self._magnitudes().map(lambda v: C.minimum(v, F.lit(float(s))))

    def maximum(self, s: float) -> Vector:
        return self._magnitudes().map(lambda v: C.maximum(v, F.lit(float(s))))

    def _magnitudes(self) -> Vector:
        return self.abs() if self.is_complex else self

    def cwise_max(self, other: Vector) -> Vector:
        return self._magnitudes().zip(other._magnitudes(), lambda a, b: F.when(a > b, a).otherwise(b))

    def cwise_min(self, other: Vector) -> Vector:
        return self._magnitudes().zip(other._magnitudes(), lambda a, b: F.when(a < b, a).otherwise(b))

    def real(self) -> Vector:
        return self.map(lambda v: v["re"]) if self.is_complex else self

    def imag(self) -> Vector:
        return self.map(lambda v: v["im"] if self.is_complex else F.lit(0.0))

    def as_complex(self) -> Vector:
        return self if self.is_complex else self.map(C.complex_of)

    def conj(self) -> Vector:
        return self.map(C.conj) if self.is_complex else self

    def cast(self, kind: str) -> Vector:
        return self.map(lambda v: v.cast(kind))

    # --- reductions ------------------------------------------------------------------
    def reduce(self, **aggregates: Column) -> dict[str, float]:
        """Several aggregates of ``val`` in one job."""
        return self.df.agg(*[c.alias(k) for k, c in aggregates.items()]).first().asDict()

    def _squares(self) -> Column:
        v = F.col("val")
        return F.sum(v["re"] * v["re"] + v["im"] * v["im"] if self.is_complex else v * v)

    def _one(self, c: Column, empty: float = 0.0) -> float:
        out = self.df.agg(c.alias("v")).first()["v"]
        return empty if out is None else out

    def sum(self) -> float | complex:
        if self.local is not None:
            return self.local.sum().item()
        if self.is_complex:
            r = self.reduce(re=F.sum("val.re"), im=F.sum("val.im"))
            return complex(r["re"], r["im"])
        return self._one(F.sum("val"))

    def dot(self, other: Vector) -> float | complex:
        """The left operand is conjugated."""
        if self.local is not None and other.local is not None and self.size == other.size:
            return np.vdot(self.local, other.local).item()
        product = self.conj() * other
        return product.sum()

    def squared_l2(self) -> float:
        if self.local is not None:
            return float(np.vdot(self.local, self.local).real)
        return self._one(self._squares())

    def l2(self) -> float:
        return math.sqrt(self.squared_l2())

    def _size_column(self) -> Column:
        return C.magnitude(F.col("val")) if self.is_complex else F.abs("val")

    def l1(self) -> float:
        return self._one(F.sum(self._size_column()))

    def l0(self, epsilon: float = C.EPSILON) -> int:
        return self._one(F.count_if(self._size_column() >= epsilon), 0)

    def linf(self) -> float:
        return self._one(F.max(self._size_column()))

    def min(self) -> float | complex:
        if self.is_complex:
            return complex(*self._one(F.min_by("val", self._size_column())))
        return self._one(F.min("val"))

    def max(self) -> float | complex:
        if self.is_complex:
            return complex(*self._one(F.max_by("val", self._size_column())))
        return self._one(F.max("val"))

    def _over_blocks(self, total: Column) -> Vector:
        if not isinstance(self.desc, Blocks) or not self.desc.identical:
            raise InvalidArgumentError("identical blocks are needed")
        part = self.desc.parts[0]
        return Vector(self.df.groupBy((F.col("idx") % part.size).alias("idx")).agg(total.alias("val")), part)

    def pl1(self) -> Vector:
        """Sum of magnitudes over the blocks, point by point."""
        return self._over_blocks(F.sum(self._size_column()))

    def pl2(self) -> Vector:
        return self._over_blocks(F.sqrt(F.sum(self._size_column() * self._size_column())))

    # --- indexing --------------------------------------------------------------------
    def __getitem__(self, index: int | Sequence[int]) -> float:
        i = index if isinstance(index, int) else self.desc.index(index)
        if not 0 <= i < self.size:
            raise OutOfRangeError(index)
        return self.df.where(F.col("idx") == i).first()["val"]

    def at(self, coordinate: Sequence[int]) -> float:
        """The value at a coordinate, 0 outside."""
        if any(not 0 <= c < n for c, n in zip(coordinate, self.desc.shape, strict=True)):
            return 0.0
        return self[self.desc.index(coordinate)]

    def block(self, i: int) -> Vector:
        if not isinstance(self.desc, Blocks):
            raise InvalidArgumentError("not a block vector")
        if not 0 <= i < len(self.desc.parts):
            raise OutOfRangeError(i)
        return self._range(self.desc.offsets[i], self.desc.parts[i])

    def _range(self, low: int, grid: Grid) -> Vector:
        idx = F.col("idx")
        return Vector(self.df.where((idx >= low) & (idx < low + grid.size)).select((idx - low).alias("idx"), "val"), grid)

    def slice(self, i: int) -> Vector:
        """Slab i of the last dimension, which stays with size 1."""
        d = self.desc
        if d.shape[-1] == 1:
            return self
        if not 0 <= i < d.shape[-1]:
            raise OutOfRangeError(i)
        grid = Grid((*d.shape[:-1], 1), d.spacing)
        return self._range(i * grid.size, grid)

    def _assigned(self, low: int, part: Vector) -> Vector:
        idx = F.col("idx")
        rest = self.df.where((idx < low) | (idx >= low + part.size))
        return Vector(rest.unionByName(part.df.select((idx + low).alias("idx"), "val")), self.desc)

    def with_block(self, i: int, part: Vector) -> Vector:
        """A copy in which block i has the given values."""
        if part.size != self.desc.parts[i].size:
            raise InvalidArgumentError("sizes differ")
        return self._assigned(self.desc.offsets[i], part)

    def with_slice(self, i: int, part: Vector) -> Vector:
        n = self.size // self.desc.shape[-1]
        if part.size != n:
            raise InvalidArgumentError("sizes differ")
        return self._assigned(i * n, part)

    def view_as(self, desc: Grid) -> Vector:
        if desc.size != self.size:
            raise InvalidArgumentError("sizes differ")
        return Vector(self.df, desc, self.local)

    def fft_shift(self, inverse: bool = False) -> Vector:
        """Circular shift by half of each dimension (rounded down), or back."""
        d, out = self.desc, F.lit(0).cast("long")
        for k, (n, stride) in enumerate(zip(d.shape, d.strides, strict=True)):
            by = -(n // 2) if inverse else n // 2
            out = out + F.pmod(d.column(F.col("idx"), k) + by, F.lit(n)) * stride
        return Vector(self.df.select(out.alias("idx"), "val"), d)


def lincomb(a: float, x: Vector, b: float, y: Vector) -> Vector:
    """a*x + b*y in one join and one projection, or on the driver if both are held there."""
    if x.size != y.size:
        raise InvalidArgumentError("vectors differ in size")
    if x.local is not None and y.local is not None:
        return Vector.from_array(x.spark, a * x.local + b * y.local, x.desc)
    if x.is_complex or y.is_complex:
        return x * a + y * b
    return x.zip(y, lambda p, q: F.lit(float(a)) * p + F.lit(float(b)) * q)


def concatenate(*parts: Vector) -> Vector:
    """A block vector of the parts, one after the other."""
    if len({p.desc.ndim for p in parts}) > 1:
        raise InvalidArgumentError("parts must have the same number of dimensions")
    desc = random_blocks([p.desc for p in parts])
    out = parts[0].df
    for p, o in list(zip(parts, desc.offsets, strict=True))[1:]:
        out = out.unionByName(p.df.select((F.col("idx") + o).alias("idx"), "val"))
    return Vector(out, desc)
