"""Linear operators: an expression tree whose leaves are sparse relations (row, col, w).

``apply`` joins the relation with the vector on col and sums w * val by row; the adjoint
swaps the two keys. Sums, scalar multiples, stacks and adjoints of relations are relations
again and cost one join and one aggregation; only products take one stage for each factor.
Adjoints are pushed to the leaves and scalars folded when a tree is built. Rows without an
entry give 0: the sum starts from a zero for every row, so no outer join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.functions import columns as C
from tomolith.plans.descriptor import Blocks, Grid, best_block, best_common
from tomolith.plans import vector as V
from tomolith.plans.storage import kept
from tomolith.plans.vector import Vector, small


class LinearOperator:
    """A linear map between the spaces of two descriptors."""

    domain: Grid
    range: Grid

    def apply(self, x: Vector) -> Vector:
        raise NotImplementedError

    def apply_adjoint(self, y: Vector) -> Vector:
        return self.adjoint().apply(y)

    def adjoint(self) -> LinearOperator:
        raise NotImplementedError

    def relation(self, spark: SparkSession) -> DataFrame | None:
        """(row, col, w), or None for an operator that has no cheap relation."""
        return None

    def _check(self, x: Vector) -> None:
        if x.size != self.domain.size:
            raise InvalidArgumentError(f"operator takes vectors of size {self.domain.size}, not {x.size}")

    def __call__(self, x: Vector) -> Vector:
        return self.apply(x)

    def __add__(self, other: LinearOperator) -> LinearOperator:
        return Sum(self, other)

    def __sub__(self, other: LinearOperator) -> LinearOperator:
        return Sum(self, Scaled(-1.0, other))

    def __mul__(self, other: LinearOperator) -> LinearOperator:
        if isinstance(other, Identity):
            return self
        return Product(self, other)

    def __rmul__(self, s: float) -> LinearOperator:
        return Scaled(float(s), self)


def adjoint(a: LinearOperator) -> LinearOperator:
    return a.adjoint()


def leaf(a: LinearOperator) -> LinearOperator:
    return a


def contract(relation: DataFrame, x: Vector, out: Grid, key: str = "row", inner: str = "col") -> Vector:
    """Sum of w * val by ``key`` where ``inner`` meets idx; every index of ``out`` is present."""
    spark = relation.sparkSession
    joined = relation.join(small(x.df, x.size), F.col(inner) == F.col("idx"))
    zero = spark.range(out.size)
    if x.is_complex:
        rows = joined.select(F.col(key).alias("idx"), (F.col("w") * F.col("val.re")).alias("re"), (F.col("w") * F.col("val.im")).alias("im"))
        rows = rows.unionByName(zero.select(F.col("id").alias("idx"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
        return Vector(rows.groupBy("idx").agg(C.complex_of(F.sum("re"), F.sum("im")).alias("val")), out)
    rows = joined.select(F.col(key).alias("idx"), (F.col("w") * F.col("val")).alias("val"))
    rows = rows.unionByName(zero.select(F.col("id").alias("idx"), F.lit(0.0).alias("val")))
    return Vector(rows.groupBy("idx").agg(F.sum("val").alias("val")), out)


class Relation(LinearOperator):
    """A leaf with its entries in a DataFrame (row, col, w); entries of one place add up.

    ``by_col`` and ``by_row`` may hold the same entries, partitioned by one of the keys.
    """

    def __init__(self, entries: DataFrame, domain: Grid, range_: Grid, by_col: DataFrame | None = None, by_row: DataFrame | None = None, transposed: Relation | None = None):
        self.entries, self.domain, self.range = entries.select("row", "col", "w"), domain, range_
        self.by_col, self.by_row, self.transposed = by_col, by_row, transposed

    def relation(self, spark: SparkSession) -> DataFrame:
        return self.entries

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        return contract(self.entries if self.by_col is None else self.by_col, x, self.range)

    def apply_adjoint(self, y: Vector) -> Vector:
        if y.size != self.range.size:
            raise InvalidArgumentError("sizes differ")
        return contract(self.entries if self.by_row is None else self.by_row, y, self.domain, "col", "row")

    def adjoint(self) -> LinearOperator:
        turn = lambda e: None if e is None else e.select(F.col("col").alias("row"), F.col("row").alias("col"), "w")
        return Relation(turn(self.entries), self.range, self.domain, turn(self.by_row), turn(self.by_col), self)

    def persisted(self) -> Relation:
        """Kept for many applications. Where a vector is too large to broadcast, the entries are laid out by column for
        ``apply`` and by row for its adjoint, so that a step shuffles vectors and partial sums, never the entries."""
        if max(self.domain.size, self.range.size) <= V.BROADCAST_ROWS:
            return Relation(self.entries.persist(), self.domain, self.range)
        n = int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = lambda key, size: kept(self.entries.repartition(n, key)) if size > V.BROADCAST_ROWS else None
        by_col, by_row = laid("col", self.domain.size), laid("row", self.range.size)
        return Relation(by_row if by_col is None else by_col, self.domain, self.range, by_col, by_row)

    def unpersist(self) -> None:
        for e in (self.entries, self.by_col, self.by_row):
            if e is not None:
                e.unpersist()

    def row_sums(self) -> Vector:
        return self.apply(Vector.full(self.entries.sparkSession, self.domain, 1.0))


class Identity(LinearOperator):
    def __init__(self, grid: Grid):
        self.domain = self.range = grid

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        return x

    def adjoint(self) -> LinearOperator:
        return self

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.domain.size).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("w"))

    def __mul__(self, other: LinearOperator) -> LinearOperator:
        return other


class Scaling(LinearOperator):
    """s * x, or d o x for a vector of factors; its adjoint is itself (no conjugate)."""

    def __init__(self, grid: Grid, factor: float | Vector):
        if isinstance(factor, Vector) and factor.size != grid.size:
            raise InvalidArgumentError("one factor for each coefficient is needed")
        self.domain = self.range = grid
        self.factor = factor

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        return x * self.factor

    def adjoint(self) -> LinearOperator:
        return self

    def relation(self, spark: SparkSession) -> DataFrame | None:
        if isinstance(self.factor, complex) or (isinstance(self.factor, Vector) and self.factor.is_complex):
            return None
        if isinstance(self.factor, Vector):
            return self.factor.df.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.col("val").alias("w"))
        return spark.range(self.domain.size).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(float(self.factor)).alias("w"))


class Sum(LinearOperator):
    def __init__(self, *terms: LinearOperator):
        flat = [t for x in terms for t in (x.terms if isinstance(x, Sum) else (x,))]
        self.terms = tuple(flat)
        self.domain = best_common(*[t.domain for t in flat])
        self.range = best_common(*[t.range for t in flat])

    def relation(self, spark: SparkSession) -> DataFrame | None:
        parts = [t.relation(spark) for t in self.terms]
        return None if any(p is None for p in parts) else reduce(DataFrame.unionByName, parts)

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        entries = self.relation(x.spark)
        if entries is not None:
            return contract(entries, x, self.range)
        return reduce(lambda a, b: a + b, [t.apply(x) for t in self.terms]).view_as(self.range)

    def adjoint(self) -> LinearOperator:
        return Sum(*[t.adjoint() for t in self.terms])


class Product(LinearOperator):
    """first(second(x))."""

    def __init__(self, first: LinearOperator, second: LinearOperator):
        if first.domain.size != second.range.size:
            raise InvalidArgumentError("inner sizes differ")
        self.first, self.second = first, second
        self.domain, self.range = second.domain, first.range

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        return self.first.apply(self.second.apply(x))

    def adjoint(self) -> LinearOperator:
        return Product(self.second.adjoint(), self.first.adjoint())


class Scaled(LinearOperator):
    def __init__(self, s: float, a: LinearOperator):
        self.s, self.a = (s * a.s, a.a) if isinstance(a, Scaled) else (s, a)
        self.domain, self.range = a.domain, a.range

    def apply(self, x: Vector) -> Vector:
        return self.a.apply(x) * self.s

    def adjoint(self) -> LinearOperator:
        return Scaled(self.s, self.a.adjoint())

    def relation(self, spark: SparkSession) -> DataFrame | None:
        entries = self.a.relation(spark)
        return None if entries is None else entries.select("row", "col", (F.col("w") * self.s).alias("w"))


class BlockOperator(LinearOperator):
    """Operators side by side: ROW stacks their outputs, COL adds their results on the parts of x."""

    ROW, COL = "row", "col"

    def __init__(self, parts: list[LinearOperator], kind: str, domain: Grid | None = None, range_: Grid | None = None):
        if kind not in (self.ROW, self.COL) or not parts:
            raise InvalidArgumentError("parts and a kind, row or col, are needed")
        self.parts, self.kind = list(parts), kind
        if kind == self.ROW:
            self.domain, self.range = domain or best_common(*[p.domain for p in parts]), range_ or best_block([p.range for p in parts])
        else:
            self.domain, self.range = domain or best_block([p.domain for p in parts]), range_ or best_common(*[p.range for p in parts])
        blocks, sizes = (self.range, [p.range.size for p in parts]) if kind == self.ROW else (self.domain, [p.domain.size for p in parts])
        if not isinstance(blocks, Blocks) or [p.size for p in blocks.parts] != sizes:
            raise InvalidArgumentError("blocks do not fit the operators")
        self.blocks = blocks

    def relation(self, spark: SparkSession) -> DataFrame | None:
        parts = [p.relation(spark) for p in self.parts]
        if any(p is None for p in parts):
            return None
        key = "row" if self.kind == self.ROW else "col"
        return reduce(DataFrame.unionByName, [p.withColumn(key, F.col(key) + o) for p, o in zip(parts, self.blocks.offsets, strict=True)])

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        entries = self.relation(x.spark)
        if entries is not None:
            return contract(entries, x, self.range)
        if self.kind == self.COL:
            x = x.view_as(self.blocks)
            return reduce(lambda a, b: a + b, [p.apply(x.block(i)) for i, p in enumerate(self.parts)]).view_as(self.range)
        rows = [p.apply(x).df.select((F.col("idx") + o).alias("idx"), "val") for p, o in zip(self.parts, self.blocks.offsets, strict=True)]
        return Vector(reduce(DataFrame.unionByName, rows), self.range)

    def adjoint(self) -> LinearOperator:
        other = self.COL if self.kind == self.ROW else self.ROW
        return BlockOperator([p.adjoint() for p in self.parts], other, self.range, self.domain)


class Rule(LinearOperator):
    """A leaf whose entries follow from the index: no join, one aggregation.

    ``of_row`` gives an array of structs (k: col, w) for a row index, ``of_col`` one of (k: row, w).
    """

    def of_row(self, row: Column) -> Column:
        raise NotImplementedError

    def of_col(self, col: Column) -> Column:
        raise NotImplementedError

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.domain.size).select(F.col("id").alias("col"), F.inline(self.of_col(F.col("id")))).select(F.col("k").alias("row"), "col", "w")

    def _spread(self, x: Vector, entries: Column, out: Grid) -> Vector:
        rows = x.df.select("val", F.inline(entries))
        zero = x.spark.range(out.size)
        if x.is_complex:
            rows = rows.select("k", (F.col("w") * F.col("val.re")).alias("re"), (F.col("w") * F.col("val.im")).alias("im"))
            rows = rows.unionByName(zero.select(F.col("id").alias("k"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
            return Vector(rows.groupBy(F.col("k").alias("idx")).agg(C.complex_of(F.sum("re"), F.sum("im")).alias("val")), out)
        rows = rows.select("k", (F.col("w") * F.col("val")).alias("val")).unionByName(zero.select(F.col("id").alias("k"), F.lit(0.0).alias("val")))
        return Vector(rows.groupBy(F.col("k").alias("idx")).agg(F.sum("val").alias("val")), out)

    def apply(self, x: Vector) -> Vector:
        self._check(x)
        return self._spread(x, self.of_col(F.col("idx")), self.range)

    def apply_adjoint(self, y: Vector) -> Vector:
        if y.size != self.range.size:
            raise InvalidArgumentError("sizes differ")
        return self._spread(y, self.of_row(F.col("idx")), self.domain)

    def adjoint(self) -> LinearOperator:
        return _Transposed(self)


class _Transposed(Rule):
    def __init__(self, a: Rule):
        self.a, self.domain, self.range = a, a.range, a.domain

    def of_row(self, row: Column) -> Column:
        return self.a.of_col(row)

    def of_col(self, col: Column) -> Column:
        return self.a.of_row(col)

    def adjoint(self) -> LinearOperator:
        return self.a
