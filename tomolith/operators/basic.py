"""Finite differences, dictionaries, Jacobi preconditioners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError, OutOfRangeError
from tomolith.functions import columns as C
from tomolith.plans.descriptor import Grid, identical_blocks
from tomolith.plans.vector import Vector

from .linear import LinearOperator, Product, Relation, Rule, Scaling


class FiniteDifferences(Rule):
    """One slab of differences for each active dimension; a missing neighbour counts as 0."""

    FORWARD, BACKWARD, CENTRAL = "forward", "backward", "central"
    #: (step, weight) of the entries of one row.
    STENCILS = {FORWARD: ((0, -1.0), (1, 1.0)), BACKWARD: ((0, 1.0), (-1, -1.0)), CENTRAL: ((1, 0.5), (-1, -0.5))}

    def __init__(self, grid: Grid, kind: str = FORWARD, active: Sequence[bool] | None = None):
        if kind not in self.STENCILS:
            raise InvalidArgumentError("kind is forward, backward or central")
        active = [True] * grid.ndim if active is None else list(active)
        if len(active) != grid.ndim or not any(active):
            raise InvalidArgumentError("one flag for each dimension is needed, and one at least set")
        self.kind, self.dims = kind, [d for d, a in enumerate(active) if a]
        self.domain, self.range = grid, identical_blocks(grid, len(self.dims))

    def _entries(self, point: Column, slab: int, sign: int, shift: bool) -> list[Column]:
        """Structs (k, w) of the stencil around a point, reversed for columns; null outside the grid."""
        d = self.dims[slab]
        n, stride, at = self.domain.shape[d], self.domain.strides[d], self.domain.column(point, self.dims[slab])
        offset = slab * self.domain.size if shift else 0
        out = []
        for step, w in self.STENCILS[self.kind]:
            move = sign * step
            entry = F.struct((point + move * stride + offset).alias("k"), F.lit(w).alias("w"))
            out.append(entry if move == 0 else F.when((at + move >= 0) & (at + move < n), entry))
        return out

    def of_col(self, col: Column) -> Column:
        return F.array_compact(F.array(*[e for s in range(len(self.dims)) for e in self._entries(col, s, -1, True)]))

    def of_row(self, row: Column) -> Column:
        size = self.domain.size
        out = F.array_compact(F.array(*self._entries(row - (len(self.dims) - 1) * size, len(self.dims) - 1, 1, False)))
        for s in range(len(self.dims) - 2, -1, -1):
            out = F.when(row < (s + 1) * size, F.array_compact(F.array(*self._entries(row - s * size, s, 1, False)))).otherwise(out)
        return out


class Dictionary(Relation):
    """Atoms (atom, idx, val) of unit norm; coefficients in, signal out."""

    def __init__(self, atoms: DataFrame, signal: Grid, n_atoms: int):
        norms = atoms.groupBy("atom").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("_n"))
        safe = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.raise_error(F.lit("an atom of zeros has no direction")).cast("double"))
        self.atoms = atoms.join(norms, "atom").select(F.col("atom").cast("long").alias("atom"), F.col("idx").cast("long").alias("idx"), (F.col("val") / safe).alias("val"))
        super().__init__(self.atoms.select(F.col("idx").alias("row"), F.col("atom").alias("col"), F.col("val").alias("w")), Grid((n_atoms,)), signal)
        self.n_atoms = n_atoms

    @staticmethod
    def random(spark: SparkSession, signal: Grid, n_atoms: int, seed: int = 0) -> Dictionary:
        n = signal.size
        rows = spark.range(n * n_atoms).select(F.floor(F.col("id") / n).alias("atom"), (F.col("id") % n).alias("idx"), F.randn(seed).alias("val"))
        return Dictionary(rows, signal, n_atoms)

    def atom(self, j: int) -> Vector:
        if not 0 <= j < self.n_atoms:
            raise OutOfRangeError(j)
        return Vector(self.atoms.where(F.col("atom") == j).select("idx", "val"), self.range)

    def with_atom(self, j: int, v: Vector) -> Dictionary:
        """A dictionary in which atom j is replaced (and normalised)."""
        if not 0 <= j < self.n_atoms or v.size != self.range.size:
            raise OutOfRangeError(j)
        rest = self.atoms.where(F.col("atom") != j)
        return Dictionary(rest.unionByName(v.df.select(F.lit(j).cast("long").alias("atom"), "idx", "val")), self.range, self.n_atoms)

    def supported(self, support: Sequence[int]) -> Dictionary:
        """Only the listed atoms, in that order."""
        place = F.create_map(*[F.lit(x) for pair in ((int(a), i) for i, a in enumerate(support)) for x in pair])
        rows = self.atoms.where(F.col("atom").isin([int(a) for a in support]))
        return Dictionary(rows.select(place[F.col("atom").cast("int")].cast("long").alias("atom"), "idx", "val"), self.range, len(support))

    def most_correlated(self, residual: Vector) -> int:
        """The atom with the largest |<atom, residual>|; the first of equals."""
        scores = self.apply_adjoint(residual).df
        return scores.agg(F.max(F.struct(F.abs("val"), -F.col("idx"))).alias("m")).select(-F.col("m.col2")).first()[0]


def diagonal(a: LinearOperator, spark: SparkSession) -> Vector:
    """The diagonal of a square operator, from its relation or, for a product, by joining the two relations."""
    if isinstance(a, Product) and getattr(a.first, "transposed", None) is a.second and a.second is not None:
        merged = a.second.relation(spark).groupBy("row", "col").agg(F.sum("w").alias("w"))
        rows = merged.select(F.col("col").alias("idx"), (F.col("w") * F.col("w")).alias("val"))  # of A*A: the squared lengths of A's columns
    elif isinstance(a, Product):
        left, right = a.first.relation(spark), a.second.relation(spark)
        if left is None or right is None:
            raise InvalidArgumentError("the factors have no relations")
        merge = lambda r: r.groupBy("row", "col").agg(F.sum("w").alias("w"))
        left, right = merge(left).alias("l"), merge(right).alias("r")
        rows = left.join(right, (F.col("l.col") == F.col("r.row")) & (F.col("l.row") == F.col("r.col"))).select(F.col("l.row").alias("idx"), (F.col("l.w") * F.col("r.w")).alias("val"))
    else:
        entries = a.relation(spark)
        if entries is None:
            raise InvalidArgumentError("the operator has no relation")
        rows = entries.where("row = col").select(F.col("row").alias("idx"), F.col("w").alias("val"))
    zero = spark.range(a.domain.size).select(F.col("id").alias("idx"), F.lit(0.0).alias("val"))
    return Vector(rows.unionByName(zero).groupBy("idx").agg(F.sum("val").alias("val")), a.domain)


class JacobiPreconditioner(Scaling):
    """Multiplication by the diagonal of a square operator, or by its inverse."""

    def __init__(self, a: LinearOperator, spark: SparkSession, inverse: bool = True):
        if a.domain.size != a.range.size:
            raise InvalidArgumentError("a square operator is needed")
        d = diagonal(a, spark)
        super().__init__(a.domain, d.map(lambda v: C.div0(F.lit(1.0), v)) if inverse else d)
