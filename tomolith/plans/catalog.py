"""The engine's queries over the driver's tables, with the SQL each is checked against.

The SQL is written from the definitions, not from the plans: element-wise selects,
aggregates, index arithmetic, and for solvers a chain of CTEs, one for each vector update.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.functions import columns as C
from tomolith.functions import functionals as FN
from tomolith.functions import proximal as PX
from tomolith.operators import basic as OB
from tomolith.operators import fourier as OF
from tomolith.operators import linear as OL
from tomolith.sources import phantoms as PH
from tomolith.streaming.frames import reconstruct_frames

from . import geometry as G
from . import recipes
from . import solvers as S
from . import tables as T
from .descriptor import Grid, identical_blocks, partition
from .vector import Vector, concatenate, lincomb

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = (query, sql)


def shown(v: Vector, digits: int = 6) -> DataFrame:
    """(idx, val) rounded, without negative zeros."""
    return v.df.select("idx", (F.round("val", digits) + 0.0).alias("val"))


def scalars(spark: SparkSession, digits: int = 6, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), digits) + 0.0 for v in values.values())], ", ".join(f"{k} double" for k in values))


# --- relations of the SQL side ------------------------------------------------------------
X = "(SELECT o_orderkey AS idx, o_totalprice / 1000.0 AS val FROM orders)"
Y = "(SELECT c_custkey AS idx, c_acctbal / 1000.0 AS val FROM customer)"
R = "(SELECT p_partkey AS idx, p_retailprice / 1000.0 AS val FROM part)"
SB = "(SELECT s_suppkey AS idx, s_acctbal / 1000.0 AS val FROM supplier)"
IMAGE = "(SELECT g AS idx, coalesce(n, 0)::DOUBLE AS val FROM range(1024) t(g) LEFT JOIN (SELECT p_size % 32 + 32 * (p_partkey % 32) AS k, count(*) AS n FROM part GROUP BY 1) h ON h.k = g)"
TRADE = "(SELECT o_custkey AS r, l_suppkey AS c, sum(l_quantity) / 100.0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_SEG = "list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1"
SEG_A = f"SELECT c_nationkey::BIGINT AS r, ({_SEG})::BIGINT AS c, avg(c_acctbal / 1000.0) AS w FROM customer GROUP BY 1, 2"
SEG_B = "SELECT g AS idx, coalesce(s, 0) / (1 + coalesce(n, 0)) AS val FROM range(25) t(g) LEFT JOIN (SELECT c_nationkey AS k, sum(c_acctbal / 1000.0) AS s, count(*) AS n FROM customer GROUP BY 1) q ON q.k = g"


def _vec(source: str, expression: str, digits: int = 6) -> str:
    return f"SELECT idx, (round({expression}, {digits}) + 0.0)::DOUBLE AS val FROM {source}"


# --- element-wise ---------------------------------------------------------------------------
def _on(load: Callable, f: Callable[[Vector], Vector]) -> Query:
    return lambda s, d: shown(f(load(s, d)))


add("ew_add_scalar", _on(T.prices, lambda x: 2.5 + x), _vec(X, "val + 2.5"))
add("ew_sub_scalar", _on(T.prices, lambda x: 100 - x), _vec(X, "100 - val"))
add("ew_mul", lambda s, d: shown(T.prices(s, d) * T.prices(s, d)), _vec(X, "val * val"))
add("ew_div_scalar", _on(T.prices, lambda x: 3.0 / (x + 1.0)), _vec(X, "3.0 / (val + 1.0)"))
add("ew_add_vectors", lambda s, d: shown(T.balances(s, d) + T.balances(s, d).abs()), _vec(Y, "val + abs(val)"))
add("ew_sub_vectors", lambda s, d: shown(T.balances(s, d).exp() - T.balances(s, d)), _vec(Y, "exp(val) - val", 6))
add("ew_div_vectors", lambda s, d: shown(T.balances(s, d) / (T.balances(s, d).square() + 1.0)), _vec(Y, "val / (val * val + 1.0)"))
add("ew_unary", lambda s, d: shown((-T.balances(s, d)).abs().sqrt()), _vec(Y, "sqrt(abs(val))"))
add("ew_log", _on(T.prices, lambda x: (x + 1.0).log()), _vec(X, "ln(val + 1.0)"))
add("ew_sign", _on(T.balances, lambda x: x.sign()), _vec(Y, "sign(val)"))
add("ew_fill", _on(T.balances, lambda x: x.filled(7.0)), _vec(Y, "7.0"))
add("clip", _on(T.balances, lambda x: x.clip(-0.5, 5.0)), _vec(Y, "CASE WHEN val < -0.5 THEN -0.5 WHEN val > 5 THEN 5 ELSE val END"))
add("minmax_scalar", _on(T.balances, lambda x: x.minimum(4.0) + x.maximum(1.0)), _vec(Y, "least(val, 4.0) + greatest(val, 1.0)"))
add("cwise", lambda s, d: shown(T.balances(s, d).cwise_max(-T.balances(s, d)) - T.balances(s, d).cwise_min(-T.balances(s, d))), _vec(Y, "2 * abs(val)"))
add("lincomb", lambda s, d: shown(lincomb(2.0, T.balances(s, d), -0.5, T.balances(s, d).square())), _vec(Y, "2.0 * val - 0.5 * val * val"))
add("complex_parts", lambda s, d: shown((T.balances(s, d).as_complex() * (2 + 1j)).imag() + (T.balances(s, d).as_complex() * (2 + 1j)).abs()), _vec(Y, "val + sqrt(5.0) * abs(val)"))
add("meyer_window", lambda s, d: shown(T.prices(s, d).map(lambda v: C.meyer(v / 500.0))), _vec(X, "CASE WHEN val < 0 THEN 0 WHEN val > 500 THEN 1 ELSE 35 * pow(val / 500, 4) - 84 * pow(val / 500, 5) + 70 * pow(val / 500, 6) - 20 * pow(val / 500, 7) END"))


# --- reductions --------------------------------------------------------------------------------
def _norms(s: SparkSession, d: str) -> DataFrame:
    """All reductions in one plan."""
    v, size = F.col("val"), F.abs("val")
    every = {
        "l1": F.sum(size), "l2": F.sqrt(F.sum(v * v)), "l2sq": F.sum(v * v), "linf": F.max(size), "l0": F.count_if(size >= C.EPSILON).cast("double"),
        "total": F.sum(v), "low": F.min(v), "high": F.max(v),
    }
    return T.balances(s, d).df.agg(*[(F.round(c, 6) + 0.0).alias(k) for k, c in every.items()])


def _norms_one_by_one(s: SparkSession, d: str) -> DataFrame:
    y = T.balances(s, d).saved()
    return scalars(s, l1=y.l1(), l2=y.l2(), l2sq=y.squared_l2(), linf=y.linf(), l0=y.l0(), total=y.sum(), low=y.min(), high=y.max())


add("norms", _norms, f"SELECT round(sum(abs(val)), 6) AS l1, round(sqrt(sum(val * val)), 6) AS l2, round(sum(val * val), 6) AS l2sq, round(max(abs(val)), 6) AS linf, count(*) FILTER (WHERE abs(val) >= pow(2, -23))::DOUBLE AS l0, round(sum(val), 6) AS total, round(min(val), 6) AS low, round(max(val), 6) AS high FROM {Y}")
add("norms_one_by_one", _norms_one_by_one, f"SELECT round(sum(abs(val)), 6) AS l1, round(sqrt(sum(val * val)), 6) AS l2, round(sum(val * val), 6) AS l2sq, round(max(abs(val)), 6) AS linf, count(*) FILTER (WHERE abs(val) >= pow(2, -23))::DOUBLE AS l0, round(sum(val), 6) AS total, round(min(val), 6) AS low, round(max(val), 6) AS high FROM {Y}")
add("dot", lambda s, d: scalars(s, dot=T.balances(s, d).dot(T.balances(s, d).abs())), f"SELECT round(sum(val * abs(val)), 6) AS dot FROM {Y}")


def _by_flag(s: SparkSession, d: str) -> Vector:
    """Three blocks of a year of days: quantities by return flag."""
    lines = T.table(s, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = lines.select((flag * 366 + F.dayofyear("l_shipdate") - 1).cast("long").alias("idx"), (F.col("l_quantity") - 25.5).alias("val"))
    desc = identical_blocks(Grid((366,)), 3)
    zero = s.range(desc.size).select(F.col("id").alias("idx"), F.lit(0.0).alias("val"))
    return Vector(rows.unionByName(zero).groupBy("idx").agg(F.sum("val").alias("val")), desc)


FLAGS = "(SELECT g AS idx, coalesce(v, 0) AS val FROM range(1098) t(g) LEFT JOIN (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 366 + dayofyear(l_shipdate) - 1 AS k, sum(l_quantity - 25.5) AS v FROM lineitem GROUP BY 1) q ON q.k = g)"
add("pnorm_l1", lambda s, d: shown(_by_flag(s, d).pl1()), f"SELECT idx % 366 AS idx, round(sum(abs(val)), 6) + 0.0 AS val FROM {FLAGS} GROUP BY 1")
add("pnorm_l2", lambda s, d: shown(_by_flag(s, d).pl2()), f"SELECT idx % 366 AS idx, round(sqrt(sum(val * val)), 6) + 0.0 AS val FROM {FLAGS} GROUP BY 1")

# --- blocks, slices, shifts ----------------------------------------------------------------------
add("block", lambda s, d: shown(_by_flag(s, d).block(1)), f"SELECT idx - 366 AS idx, round(val, 6) + 0.0 AS val FROM {FLAGS} WHERE idx BETWEEN 366 AND 731")
add("slice", lambda s, d: shown(T.image(s, d).slice(5)), f"SELECT idx - 160 AS idx, val FROM {IMAGE} WHERE idx BETWEEN 160 AND 191")
add("assign_slice", lambda s, d: shown(T.image(s, d).with_slice(3, T.image(s, d).slice(4) * 2.0)), f"SELECT a.idx, CASE WHEN a.idx BETWEEN 96 AND 127 THEN 2.0 * b.val ELSE a.val END AS val FROM {IMAGE} a LEFT JOIN {IMAGE} b ON b.idx = a.idx + 32")
add("partition_block", lambda s, d: shown(T.image(s, d).view_as(partition(Grid((32, 32)), 5)).block(4)), f"SELECT idx - 800 AS idx, val FROM {IMAGE} WHERE idx >= 800")
add("concatenate", lambda s, d: shown(concatenate(T.balances(s, d), T.retail(s, d))), f"SELECT idx, round(val, 6) + 0.0 AS val FROM {Y} UNION ALL SELECT idx + (SELECT count(*) FROM customer), round(val, 6) FROM {R}")
add("fft_shift", lambda s, d: shown(T.image(s, d).fft_shift()), f"SELECT (idx % 32 + 16) % 32 + 32 * ((idx // 32 + 16) % 32) AS idx, val FROM {IMAGE}")
add("ifft_shift", lambda s, d: shown(T.image(s, d).fft_shift(inverse=True)), f"SELECT (idx % 32 + 16) % 32 + 32 * ((idx // 32 + 16) % 32) AS idx, val FROM {IMAGE}")

# --- operators ----------------------------------------------------------------------------------
_AX = f"SELECT k AS idx, coalesce(v, 0) AS val FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN (SELECT r, sum(w * val) AS v FROM {TRADE} JOIN {SB} x ON c = x.idx GROUP BY r) ON r = k"
_ATY = f"SELECT k AS idx, coalesce(v, 0) AS val FROM (SELECT s_suppkey AS k FROM supplier) LEFT JOIN (SELECT c, sum(w * val) AS v FROM {TRADE} JOIN {Y} y ON r = y.idx GROUP BY c) ON c = k"
add("matvec", lambda s, d: shown(T.trade(s, d).apply(T.supplier_balances(s, d)), 8), _vec(f"({_AX})", "val", 8))
add("adjoint", lambda s, d: shown(T.trade(s, d).apply_adjoint(T.balances(s, d)), 8), _vec(f"({_ATY})", "val", 8))
add("op_sum", lambda s, d: shown((T.trade(s, d) + 2.0 * T.trade(s, d)).apply(T.supplier_balances(s, d)), 8), _vec(f"({_AX})", "3.0 * val", 8))
add("op_prod", lambda s, d: shown((T.trade(s, d).adjoint() * T.trade(s, d)).apply(T.supplier_balances(s, d)), 4), f"WITH ax AS ({_AX}) SELECT k AS idx, round(coalesce(v, 0), 4) + 0.0 AS val FROM (SELECT s_suppkey AS k FROM supplier) LEFT JOIN (SELECT c, sum(w * val) AS v FROM {TRADE} JOIN ax ON r = ax.idx GROUP BY c) ON c = k")


def _stacked(s: SparkSession, d: str, kind: str) -> DataFrame:
    a = T.trade(s, d)
    op = OL.BlockOperator([a, OL.Scaled(-1.0, a)], kind)
    x = T.supplier_balances(s, d)
    return shown(op.apply(x if kind == "row" else concatenate(x, x * 3.0)), 8)


add("op_block_row", lambda s, d: _stacked(s, d, "row"), f"WITH ax AS ({_AX}) SELECT idx, round(val, 8) + 0.0 AS val FROM ax UNION ALL SELECT idx + (SELECT count(*) FROM customer), round(-val, 8) + 0.0 FROM ax")
add("op_block_col", lambda s, d: _stacked(s, d, "col"), _vec(f"({_AX})", "-2.0 * val", 8))
add("identity_scaling", lambda s, d: shown((OL.Scaling(Grid((T.balances(s, d).size,)), 3.0) + OL.Identity(Grid((T.balances(s, d).size,)))).apply(T.balances(s, d))), _vec(Y, "4.0 * val"))
add("scaling_diagonal", lambda s, d: shown(OL.Scaling(T.balances(s, d).desc, T.balances(s, d).abs()).apply(T.balances(s, d))), _vec(Y, "val * abs(val)"))
add("jacobi", lambda s, d: shown(OB.JacobiPreconditioner(T.trade(s, d).adjoint() * T.trade(s, d), s, inverse=False).factor), f"SELECT k AS idx, round(coalesce(v, 0), 6) + 0.0 AS val FROM (SELECT s_suppkey AS k FROM supplier) LEFT JOIN (SELECT c, sum(w * w) AS v FROM {TRADE} GROUP BY c) ON c = k")

_STENCILS = {"forward": "coalesce(n.val, 0) - a.val", "backward": "a.val - coalesce(p.val, 0)", "central": "0.5 * (coalesce(n.val, 0) - coalesce(p.val, 0))"}
_STENCILS_T = {"forward": "coalesce(p.val, 0) - a.val", "backward": "a.val - coalesce(n.val, 0)", "central": "0.5 * (coalesce(p.val, 0) - coalesce(n.val, 0))"}


def _fd_sql(expression: str) -> str:
    slabs = []
    for stride, low, high, offset in ((1, "a.idx % 32 > 0", "a.idx % 32 < 31", 0), (32, "a.idx >= 32", "a.idx < 992", 1024)):
        slabs.append(f"SELECT a.idx + {offset} AS idx, {expression} AS val FROM {IMAGE} a LEFT JOIN {IMAGE} n ON n.idx = a.idx + {stride} AND {high} LEFT JOIN {IMAGE} p ON p.idx = a.idx - {stride} AND {low}")
    return " UNION ALL ".join(slabs)


for _k in ("forward", "backward", "central"):
    add(f"fd_{_k}", lambda s, d, k=_k: shown(OB.FiniteDifferences(Grid((32, 32)), k).apply(T.image(s, d))), _fd_sql(_STENCILS[_k]))
    add(
        f"fd_{_k}_adjoint", lambda s, d, k=_k: shown(OB.FiniteDifferences(Grid((32, 32)), k).apply_adjoint(concatenate(T.image(s, d), T.image(s, d)).view_as(identical_blocks(Grid((32, 32)), 2)))),
        f"SELECT idx % 1024 AS idx, sum(val) AS val FROM ({_fd_sql(_STENCILS_T[_k])}) GROUP BY 1",
    )


def _dictionary(s: SparkSession, d: str) -> OB.Dictionary:
    """Every embedding is an atom."""
    e = T.table(s, d, "embeddings")
    atoms = e.select(F.col("vec_id").alias("atom"), F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "val"))
    return OB.Dictionary(atoms, Grid((64,)), T.rows(s, d, "embeddings"))


def _signal(s: SparkSession, d: str) -> Vector:
    """The weighted sum of all embeddings."""
    e = T.table(s, d, "embeddings").select(F.col("vec_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "val"))
    return Vector(e.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.sum(F.col("val") * (1 + F.col("vec_id") % 3)).alias("val")), Grid((64,)))


def _coefficients(s: SparkSession, d: str) -> Vector:
    return Vector.generate(s, Grid((T.rows(s, d, "embeddings"),)), lambda i: (i % 5).cast("double") - 1.5)


_ENTRIES = "(SELECT vec_id AS atom, unnest(range(64)) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_ATOMS = f"(SELECT atom, idx, v / sqrt(sum(v * v) OVER (PARTITION BY atom)) AS val FROM {_ENTRIES})"
_SIGNAL = f"(SELECT idx, sum(v * (1 + atom % 3)) AS val FROM {_ENTRIES} GROUP BY idx)"
_SCORES = f"atoms AS MATERIALIZED (SELECT * FROM {_ATOMS}), y AS MATERIALIZED (SELECT * FROM {_SIGNAL}), s1 AS MATERIALIZED (SELECT a.atom, sum(a.val * y.val) AS c FROM atoms a JOIN y USING (idx) GROUP BY 1), a1 AS MATERIALIZED (SELECT * FROM s1 ORDER BY abs(c) DESC, atom LIMIT 1)"
_OMP2 = f"""WITH {_SCORES},
g AS MATERIALIZED (SELECT a.atom, sum(a.val * b.val) AS g FROM atoms a JOIN (SELECT idx, val FROM atoms WHERE atom = (SELECT atom FROM a1)) b USING (idx) GROUP BY 1),
a2 AS MATERIALIZED (SELECT s1.atom, s1.c, g.g FROM s1 JOIN g USING (atom) ORDER BY abs(s1.c - g.g * (SELECT c FROM a1)) DESC, s1.atom LIMIT 1)
SELECT i AS idx, round(CASE WHEN i = a1.atom THEN (a1.c - a2.g * a2.c) / (1 - a2.g * a2.g) WHEN i = a2.atom THEN (a2.c - a2.g * a1.c) / (1 - a2.g * a2.g) ELSE 0 END, 4) + 0.0 AS val FROM a1, a2, range((SELECT count(*) FROM embeddings)) t(i)"""
add("dict_apply", lambda s, d: shown(_dictionary(s, d).apply(_coefficients(s, d))), f"SELECT idx, round(sum(val * (atom % 5 - 1.5)), 6) + 0.0 AS val FROM {_ATOMS} GROUP BY 1")
add("dict_adjoint", lambda s, d: shown(_dictionary(s, d).apply_adjoint(_signal(s, d))), f"SELECT a.atom AS idx, round(sum(a.val * x.val), 6) + 0.0 AS val FROM {_ATOMS} a JOIN {_SIGNAL} x ON a.idx = x.idx GROUP BY 1")
add("dict_update", lambda s, d: shown(_dictionary(s, d).with_atom(2, _signal(s, d)).atom(2)), f"SELECT idx, round(val / sqrt(sum(val * val) OVER ()), 6) + 0.0 AS val FROM {_SIGNAL}")
add("dict_support", lambda s, d: shown(_dictionary(s, d).supported([7, 3, 11]).apply_adjoint(_signal(s, d))), f"SELECT list_position([7, 3, 11], a.atom)::BIGINT - 1 AS idx, round(sum(a.val * x.val), 6) + 0.0 AS val FROM {_ATOMS} a JOIN {_SIGNAL} x ON a.idx = x.idx WHERE a.atom IN (3, 7, 11) GROUP BY 1")
add("omp_step", lambda s, d: s.createDataFrame([(int(_dictionary(s, d).most_correlated(_signal(s, d))),)], "atom long"), f"WITH {_SCORES} SELECT atom FROM a1")
add("omp", lambda s, d: shown(S.OrthogonalMatchingPursuit(_dictionary(s, d), _signal(s, d).saved(), 1e-6).solve(2), 4), _OMP2)


def _parts(v: Vector, digits: int) -> DataFrame:
    return v.df.select("idx", (F.round("val.re", digits) + 0.0).alias("re"), (F.round("val.im", digits) + 0.0).alias("im"))


add(
    "dft_1d", lambda s, d: _parts(OF.FourierTransform(Grid((64,)), OF.BACKWARD).apply(_signal(s, d).as_complex()), 6),
    f"SELECT k AS idx, round(sum(val * cos(2 * pi() * k * idx / 64)), 6) + 0.0 AS re, round(-sum(val * sin(2 * pi() * k * idx / 64)), 6) + 0.0 AS im FROM {_SIGNAL} x, range(64) t(k) GROUP BY k",
)
_PHASE = "2 * pi() * ((k % 32) * (idx % 32) + (k // 32) * (idx // 32)) / 32"
add(
    "dft_2d", lambda s, d: _parts(OF.fft(T.image(s, d), OF.ORTHO), 7),
    f"SELECT k AS idx, round(sum(val * cos({_PHASE})) / 32, 7) + 0.0 AS re, round(-sum(val * sin({_PHASE})) / 32, 7) + 0.0 AS im FROM {IMAGE} x, range(1024) t(k) GROUP BY k",
)
add("idft_2d", lambda s, d: _parts(OF.ifft(OF.fft(T.image(s, d), OF.ORTHO), OF.ORTHO), 6), f"SELECT idx, val AS re, 0.0::DOUBLE AS im FROM {IMAGE}")
add("shearlet_roundtrip", lambda s, d: shown((lambda op, x: op.apply_adjoint(op.apply(x)))(OF.ShearletTransform(Grid((32, 32)), 4), T.image(s, d).as_complex()).real()), f"SELECT idx, val FROM {IMAGE}")


# --- functionals -------------------------------------------------------------------------------
def _functional(name: str, make: Callable[[Vector], FN.Functional], value: str, gradient: str | None = None) -> None:
    add(f"f_{name}", lambda s, d: (lambda x: scalars(s, 4, value=make(x).evaluate(x)))(T.balances(s, d)), f"SELECT (round({value}, 4) + 0.0)::DOUBLE AS value FROM {Y}")
    if gradient:
        add(f"f_{name}_gradient", lambda s, d: (lambda x: shown(make(x).gradient(x)))(T.balances(s, d)), _vec(Y, gradient))


_functional("l1", lambda x: FN.L1Norm(x.desc), "sum(abs(val))")
_functional("weighted_l1", lambda x: FN.WeightedL1Norm(x.square()), "sum(abs(val) * val * val)")
_functional("l2squared", lambda x: FN.L2Squared(x.desc, x.abs()), "sum((val - abs(val)) * (val - abs(val))) / 2", "val - abs(val)")
_functional("l2reg", lambda x: FN.L2Reg(a=OL.Scaling(x.desc, 2.0)), "2 * sum(val * val)", "4 * val")
_functional("weighted_l2squared", lambda x: FN.WeightedL2Squared(x.abs()), "sum(abs(val) * val * val) / 2", "abs(val) * val")
_functional("linf", lambda x: FN.LInfNorm(x.desc), "max(abs(val))")
_functional("l0", lambda x: FN.L0PseudoNorm(x.desc), "count(*) FILTER (WHERE abs(val) >= pow(2, -23))")
_functional("huber", lambda x: FN.Huber(x.desc, 2.0), "sum(CASE WHEN abs(val) <= 2 THEN val * val / 2 ELSE 2 * (abs(val) - 1) END)", "greatest(least(val, 2.0), -2.0)")
_functional("pseudo_huber", lambda x: FN.PseudoHuber(x.desc, 2.0), "sum(4 * (sqrt(1 + val * val / 4) - 1))", "val / sqrt(1 + val * val / 4)")
_functional("quadric", lambda x: FN.Quadric(OL.Scaling(x.desc, 3.0), x.abs()), "sum(1.5 * val * val - val * abs(val))", "3 * val - abs(val)")
_functional("least_squares", lambda x: FN.LeastSquares(OL.Scaling(x.desc, 2.0), x.abs()), "sum((2 * val - abs(val)) * (2 * val - abs(val))) / 2", "2 * (2 * val - abs(val))")
_functional("weighted_least_squares", lambda x: FN.WeightedLeastSquares(OL.Scaling(x.desc, 2.0), x.abs(), x.square()), "sum((2 * val - abs(val)) * (2 * val - abs(val)) * val * val) / 2", "2 * (2 * val - abs(val)) * val * val")
_functional("emission", lambda x: FN.EmissionLogLikelihood(OL.Identity(x.desc), x.abs(), x.square() + 3.0), "sum(val + val * val + 3 - abs(val) * ln(val + val * val + 3))", "1 - abs(val) / (val + val * val + 3)")
_functional("transmission", lambda x: FN.TransmissionLogLikelihood(OL.Identity(x.desc), x.abs(), x.square() + 1.0), "sum((val * val + 1) * exp(-val) - abs(val) * (ln(val * val + 1) - val))", "abs(val) - (val * val + 1) * exp(-val)")
_functional("constant", lambda x: FN.ConstantFunctional(x.desc, 4.5), "4.5 * max(1)", "0.0")
_functional("zero", lambda x: FN.ZeroFunctional(x.desc), "0.0 * max(1)", "0.0")
_functional("indicator", lambda x: FN.IndicatorBox(x.desc, -2.0, 20.0), "CASE WHEN bool_or(val < -2 OR val > 20) THEN 'inf'::DOUBLE ELSE 0 END")
_functional("sum_scaled", lambda x: FN.L2Squared(x.desc) + 2.0 * FN.Huber(x.desc, 1.0), "sum(val * val / 2 + 2 * (CASE WHEN abs(val) <= 1 THEN val * val / 2 ELSE abs(val) - 0.5 END))", "val + 2 * greatest(least(val, 1.0), -1.0)")
add("f_separable", lambda s, d: (lambda x, y: scalars(s, 4, value=FN.SeparableSum(FN.L1Norm(x.desc), FN.L2Squared(y.desc)).evaluate(concatenate(x, y))))(T.balances(s, d), T.retail(s, d)), f"SELECT round((SELECT sum(abs(val)) FROM {Y}) + (SELECT sum(val * val) / 2 FROM {R}), 4) AS value")
add("linear_residual", lambda s, d: shown(FN.LinearResidual(T.trade(s, d), T.balances(s, d)).evaluate(T.supplier_balances(s, d)), 8), f"SELECT a.idx, round(a.val - y.val, 8) + 0.0 AS val FROM ({_AX}) a JOIN {Y} y USING (idx)")


# --- proximal operators -------------------------------------------------------------------------
def _prox(name: str, make: Callable[[Vector], PX.ProximalOperator], t: float, expression: str) -> None:
    add(f"prox_{name}", lambda s, d: (lambda x: shown(PX.prox_apply(make(x), x, t)))(T.balances(s, d)), _vec(Y, expression))


_prox("identity", lambda x: PX.ProximalIdentity(), 1.0, "val")
_prox("l1", lambda x: PX.ProximalL1(0.5), 4.0, "sign(val) * greatest(abs(val) - 2, 0)")
_prox("l0", lambda x: PX.ProximalL0(), 4.0, "CASE WHEN abs(val) > 4 THEN val ELSE 0 END")
_prox("l2squared", lambda x: PX.ProximalL2Squared(x.abs(), 2.0), 0.25, "(val + 0.5 * abs(val)) / 1.5")
_prox("huber", lambda x: PX.ProximalHuber(0.5), 3.0, f"(1 - 3.0 / (greatest((SELECT sqrt(sum(val * val)) FROM {Y}), 3.0) + 0.5)) * val")
_prox("box", lambda x: PX.ProximalBoxConstraint(0.0, 6.0), 1.0, "least(greatest(val, 0.0), 6.0)")
add("prox_mixed_l21", lambda s, d: shown(PX.ProximalMixedL21Norm(2.0).apply(_by_flag(s, d), 5.0)), f"WITH v AS (SELECT * FROM {FLAGS}), n AS (SELECT idx % 366 AS k, sqrt(sum(val * val)) AS n FROM v GROUP BY 1) SELECT idx, round((1 - 10 / greatest(n, 10)) * val, 6) + 0.0 AS val FROM v JOIN n ON idx % 366 = k")
add("prox_combined", lambda s, d: shown(PX.CombinedProximal(PX.ProximalL1(), PX.ProximalL0(), PX.ProximalIdentity()).apply(_by_flag(s, d), 20.0)), f"SELECT idx, round(CASE WHEN idx < 366 THEN sign(val) * greatest(abs(val) - 20, 0) WHEN idx < 732 THEN (CASE WHEN abs(val) > 20 THEN val ELSE 0 END) ELSE val END, 6) + 0.0 AS val FROM {FLAGS}")


# --- solvers: the SQL is a chain of common table expressions ----------------------------------------
class Chain:
    """Vectors and scalars as CTEs over the small problem a(r, c, w), b(idx, val)."""

    def __init__(self) -> None:
        self.parts = [f"a AS MATERIALIZED ({SEG_A})", f"b AS MATERIALIZED ({SEG_B})", "x0 AS (SELECT i AS idx, 0.0::DOUBLE AS val FROM range(5) t(i))", "u0 AS (SELECT i AS idx, 1.0::DOUBLE AS val FROM range(5) t(i))", "v0 AS (SELECT i AS idx, 1.0::DOUBLE AS val FROM range(25) t(i))"]
        self.n = 0

    def add(self, sql: str) -> str:
        self.n += 1
        self.parts.append(f"t{self.n} AS MATERIALIZED ({sql})")
        return f"t{self.n}"

    def ax(self, x: str) -> str:
        return self.add(f"SELECT r AS idx, sum(w * val) AS val FROM a JOIN {x} ON c = idx GROUP BY r")

    def aty(self, y: str) -> str:
        return self.add(f"SELECT c AS idx, sum(w * val) AS val FROM a JOIN {y} ON r = idx GROUP BY c")

    def lin(self, p: str, x: str, q: str, y: str) -> str:
        return self.add(f"SELECT x.idx, {p} * x.val + {q} * y.val AS val FROM {x} x JOIN {y} y USING (idx)")

    def map(self, x: str, expression: str) -> str:
        return self.add(f"SELECT idx, {expression} AS val FROM {x}")

    def mul(self, x: str, y: str) -> str:
        return self.add(f"SELECT x.idx, x.val * y.val AS val FROM {x} x JOIN {y} y USING (idx)")

    def dot(self, x: str, y: str) -> str:
        return f"(SELECT v FROM {self.add(f'SELECT sum(x.val * y.val) AS v FROM {x} x JOIN {y} y USING (idx)')})"

    def scalar(self, expression: str) -> str:
        return f"(SELECT v FROM {self.add(f'SELECT {expression} AS v')})"

    def normal(self, x: str, ridge: float = 0.0) -> str:
        """(A'A + ridge I) x."""
        out = self.aty(self.ax(x))
        return self.lin("1.0", out, repr(ridge), x) if ridge else out

    def power(self, n: int = 5, ridge: float = 0.0) -> str:
        u = "u0"
        for _ in range(n):
            w = self.normal(u, ridge)
            u = self.map(w, f"val / sqrt({self.dot(w, w)})")
        return self.scalar(f"{self.dot(u, self.normal(u, ridge))} / {self.dot(u, u)}")

    def solve(self, normal: Callable[[str], str], rhs: str, x: str, n: int = 5) -> str:
        """Conjugate gradients; five steps solve for five unknowns. A step on a solved system changes nothing."""
        r = self.lin("1.0", rhs, "-1.0", normal(x))
        p, k = r, self.dot(r, r)
        for _ in range(n):
            q = normal(p)
            alpha = self.scalar(f"CASE WHEN {k} < 1e-24 THEN 0 ELSE {k} / {self.dot(p, q)} END")
            x, r = self.lin("1.0", x, alpha, p), self.lin("1.0", r, f"-{alpha}", q)
            now = self.dot(r, r)
            p, k = self.lin("1.0", r, f"CASE WHEN {k} < 1e-24 THEN 0 ELSE {now} / {k} END", p), now
        return x

    def done(self, x: str, digits: int = 4) -> str:
        return f"WITH {', '.join(self.parts)} SELECT idx, round(val, {digits}) + 0.0 AS val FROM {x}"


def _residual_gradient(c: Chain, x: str) -> str:
    return c.aty(c.lin("1.0", c.ax(x), "-1.0", "b"))


def _power_sql() -> str:
    c = Chain()
    v = c.power()
    return f"WITH {', '.join(c.parts)} SELECT round({v}, 4) AS value"


def _landweber_sql(n: int, step: Callable[[Chain], str], project: str = "val", weights: bool = False) -> str:
    c = Chain()
    tau, x = step(c), "x0"
    m = c.map(c.ax("u0"), "1 / (val + 1e-10)") if weights else None
    t = c.map(c.aty("v0"), "CASE WHEN val <> 0 THEN 1 / val ELSE 0 END") if weights else None
    for _ in range(n):
        r = c.lin("1.0", c.ax(x), "-1.0", "b")
        g = c.aty(c.mul(r, m) if weights else r)
        g = c.mul(g, t) if weights else g
        x = c.map(c.lin("1.0", x, f"-{tau}", g), project)
    return c.done(x)


def _cg_sql(n: int, ridge: float = 0.0) -> str:
    c = Chain()
    x, r = "x0", c.aty("b")
    p, k = r, c.dot(r, r)
    for _ in range(n):
        q = c.normal(p, ridge)
        alpha = c.scalar(f"{k} / {c.dot(p, q)}")
        x, r = c.lin("1.0", x, alpha, p), c.lin("1.0", r, f"-{alpha}", q)
        now = c.dot(r, r)
        p, k = c.lin("1.0", r, f"{now} / {k}", p), now
    return c.done(x)


def _fast_sql(n: int, last: int = 4, optimised: bool = False, ridge: float = 0.0) -> str:
    c = Chain()
    step, x, y, t = c.scalar(f"1 / {c.power(20 if optimised else 5, ridge)}"), "x0", "x0", 1.0
    for k in range(n):
        g = _residual_gradient(c, x)
        new = c.lin("1.0", x, f"-{step}", c.lin("1.0", g, repr(ridge), x) if ridge else g)
        tn = (1 + math.sqrt(1 + (last if k == n - 1 else 4) * t * t)) / 2
        a, b = (t - 1) / tn, t / tn
        x = c.lin("1.0", c.lin(repr(1 + a + b), new, repr(-a), y), repr(-b), x) if optimised else c.lin(repr(1 + a), new, repr(-a), y)
        y, t = new, tn
    return c.done(x if optimised else y)


def _pgd_sql(n: int, prox: str, fast: bool, frames: int = 1) -> str:
    """``prox`` is an expression of val and the step {mu}; frame f has the right side f * b and starts from the one before."""
    c = Chain()
    mu = c.scalar(f"0.45 / {c.power()}")
    x = "x0"
    for f in range(1, frames + 1):
        x = _pgd_steps(c, n, prox, fast, mu, x, f)
    return c.done(x)


def _pgd_steps(c: Chain, n: int, prox: str, fast: bool, mu: str, x: str, f: int) -> str:
    y, t = x, 1.0
    for _ in range(n):
        before = x
        gradient = c.aty(c.lin("1.0", c.ax(y), repr(-float(f)), "b"))
        x = c.map(c.lin("1.0", y, f"-{mu}", gradient), prox.format(mu=mu))
        tn = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, t = (c.lin(repr(1 + (t - 1) / tn), x, repr(-(t - 1) / tn), before), tn) if fast else (x, t)
    return x


def _sqs_sql(n: int) -> str:
    """Steps divided by the row sums of A'A."""
    c = Chain()
    x, inverse = "x0", c.map(c.normal("u0"), "1 / val")
    for _ in range(n):
        x = c.lin("1.0", x, "-1.0", c.mul(_residual_gradient(c, x), inverse))
    return c.done(x)


def _admm_sql(n: int, prox: str, weight: float = 1.0, differences: bool = False) -> str:
    """min |Ax - b|^2 / 2 + g(Dx): x solves (A'A + weight D'D) x = A'b + weight D'(z - u); ``prox`` of val for g."""
    c = Chain()
    d = (lambda x: c.add(f"SELECT x.idx, coalesce(y.val, 0) - x.val AS val FROM {x} x LEFT JOIN {x} y ON y.idx = x.idx + 1")) if differences else (lambda x: x)
    dt = (lambda y: c.add(f"SELECT x.idx, coalesce(y.val, 0) - x.val AS val FROM {y} x LEFT JOIN {y} y ON y.idx = x.idx - 1")) if differences else (lambda y: y)
    x, z, u, rhs = "x0", "x0", "x0", c.aty("b")
    for _ in range(n):
        x = c.solve(lambda p: c.lin("1.0", c.normal(p), repr(weight), dt(d(p))), c.lin("1.0", rhs, repr(weight), dt(c.lin("1.0", z, "-1.0", u))), x)
        w = c.lin("1.0", d(x), "1.0", u)
        z = c.map(w, prox)
        u = c.lin("1.0", w, "-1.0", z)
    return c.done(x)


def _linearized_sql(n: int, sigma: float, tau: float) -> str:
    c = Chain()
    x, z, u = "x0", c.map("v0", "0.0"), c.map("v0", "0.0")
    kx = c.ax(x)
    for _ in range(n):
        x = c.map(c.lin("1.0", x, repr(-tau / sigma), c.aty(c.lin("1.0", c.lin("1.0", kx, "1.0", u), "-1.0", z))), "greatest(val, 0)")
        kx = c.ax(x)
        w = c.lin("1.0", kx, "1.0", u)
        z = c.lin(repr(1 / (1 + sigma)), w, repr(sigma / (1 + sigma)), "b")
        u = c.lin("1.0", w, "-1.0", z)
    return c.done(x)


def _solver(name: str, run: Callable[[OL.Relation, Vector, SparkSession], Vector], sql: str | None) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        a, b = T.segments(s, d)
        a = a.persisted()
        try:
            return shown(run(a, b.saved(), s).saved(), 4)
        finally:
            a.unpersist()

    add(name, query, sql)


add("power_iter", lambda s, d: (lambda a: scalars(s, 4, value=S.power_iterations(OL.Product(a.adjoint(), a), s)))(T.segments(s, d)[0]), _power_sql())
_solver("gradient_descent", lambda a, b, s: S.GradientDescent(FN.LeastSquares(a, b), s).solve(4), _landweber_sql(4, lambda c: c.scalar(f"1 / {c.power()}")))
_solver("landweber", lambda a, b, s: S.Landweber(a, b).solve(4), _landweber_sql(4, lambda c: c.scalar(f"1.8 / {c.power()}")))
_solver("landweber_projected", lambda a, b, s: S.Landweber(a, b, 0.002, S.box_projection(0.0, 0.15)).solve(4), _landweber_sql(4, lambda c: "0.002", "least(greatest(val, 0.0), 0.15)"))
_solver("sirt", lambda a, b, s: S.SIRT(a, b).solve(4), _landweber_sql(4, lambda c: "1.0", weights=True))
_solver("cgls_small", lambda a, b, s: S.CGLS(a, b, tol=0.0).solve(3), _cg_sql(3))
_solver("cgne", lambda a, b, s: S.CGNE(a, b).solve(3), _cg_sql(3))
_solver("cgnl", lambda a, b, s: S.CGNL(FN.LeastSquares(a, b), s, 0.0, line_search=lambda f, x, d: S.newton_raphson_search(f, x, d, 1)).solve(3), _cg_sql(3))
_solver("fgm", lambda a, b, s: S.FGM(FN.LeastSquares(a, b), s).solve(4), _fast_sql(4))
_solver("ogm", lambda a, b, s: S.OGM(FN.LeastSquares(a, b), s).solve(4), _fast_sql(4, 8, True))
_solver("sqs", lambda a, b, s: S.SQS(FN.LeastSquares(a, b), s, momentum=False).solve(3), _sqs_sql(3))
_solver("pgd_l1", lambda a, b, s: S.PGD(a, b, PX.ProximalL1(2.0)).solve(4), _pgd_sql(4, "sign(val) * greatest(abs(val) - 2.0 * {mu}, 0)", False))
_solver("apgd_l1", lambda a, b, s: S.APGD(a, b, PX.ProximalL1(2.0)).solve(4), _pgd_sql(4, "sign(val) * greatest(abs(val) - 2.0 * {mu}, 0)", True))
_solver("apgd_nonneg", lambda a, b, s: S.APGD(a, b, PX.ProximalBoxConstraint(0.0)).solve(4), _pgd_sql(4, "greatest(val, 0)", True))
_solver("admm", lambda a, b, s: S.ADMML2(a, b, OL.Identity(a.domain), PX.ProximalL1(0.5), 1.0).solve(2), _admm_sql(2, "sign(val) * greatest(abs(val) - 0.5, 0)"))
_solver("linearized_admm", lambda a, b, s: S.LinearizedADMM(a, PX.ProximalBoxConstraint(0.0), PX.ProximalL2Squared(b), 1.0, 0.001, s).solve(3), _linearized_sql(3, 1.0, 0.001))


_solver("sqs_momentum", lambda a, b, s: S.SQS(FN.LeastSquares(a, b), s).solve(1), _sqs_sql(1))
_solver("regularized_inversion", lambda a, b, s: S.regularized_inversion(a, b, [(2.0, OL.Identity(a.domain), Vector.full(s, a.domain, 0.0))], 3), _cg_sql(3, 4.0))
_solver("tikhonov", lambda a, b, s: recipes.tikhonov(a, b, 3.0, 4), _fast_sql(4, ridge=3.0))
_solver("tikhonov_ogm", lambda a, b, s: recipes.tikhonov(a, b, 3.0, 3, optimised=True), _fast_sql(3, 8, True, 3.0))
_solver("total_variation", lambda a, b, s: recipes.total_variation(a, b, 0.05, 2.0, 2), _admm_sql(2, "sign(val) * greatest(abs(val) - 0.1, 0)", 0.5, True))
_solver("plug_and_play", lambda a, b, s: recipes.plug_and_play(a, b, PX.ProximalBoxConstraint(0.0, 0.2), OL.Identity(a.domain), 1.0, 2), _admm_sql(2, "least(greatest(val, 0), 0.2)"))
_solver("lasso", lambda a, b, s: recipes.lasso(a, b, 2.0, 3), _pgd_sql(3, "sign(val) * greatest(abs(val) - 2.0 * {mu}, 0)", True))
_solver("nnls", lambda a, b, s: recipes.non_negative_least_squares(a, b, 3), _pgd_sql(3, "greatest(val, 0)", True))
_solver("frames", lambda a, b, s: list(reconstruct_frames(a, [b, b * 2.0], 3))[-1], _pgd_sql(3, "greatest(val, 0)", True, 2))


def _gmres_exact_sql() -> str:
    """Five steps in five unknowns are exact: the least-squares solution, by conjugate gradients run to the end."""
    return _cg_sql(5)


_solver("ab_gmres", lambda a, b, s: S.ABGMRES(a, b).solve(5), _gmres_exact_sql())
_solver("ba_gmres", lambda a, b, s: S.BAGMRES(a, b).solve(5), _gmres_exact_sql())


def _cgls(s: SparkSession, d: str) -> DataFrame:
    a, b, norms = T.order_fit(s, d)
    a = a.persisted()
    try:
        x = S.CGLS(a, b.saved(), tol=0.0).solve(4).saved()
    finally:
        a.unpersist()
    scale = F.array(*[F.lit(n) for n in norms])
    return x.df.select("idx", (F.round(F.col("val") / scale[F.col("idx").cast("int")], 4) + 0.0).alias("val"))


add(
    "cgls", _cgls,
    """WITH p AS (SELECT count(*)::DOUBLE AS a, sum(l_quantity) AS b, sum(l_discount) AS c, sum(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey),
m AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc, sum(a*y) ay, sum(b*y) by_, sum(c*y) cy FROM p),
k AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM m)
SELECT 0::BIGINT AS idx, round((ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy)) / det, 4) + 0.0 AS val FROM k
UNION ALL SELECT 1, round((aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac)) / det, 4) + 0.0 FROM k
UNION ALL SELECT 2, round((aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac)) / det, 4) + 0.0 FROM k""",
)

# --- phantoms, geometry, projectors -------------------------------------------------------------
add("phantom_circular", lambda s, d: shown(PH.circular(s, (64, 64), 20.5)), "SELECT g AS idx, (CASE WHEN pow(g % 64 - 32, 2) + pow(g // 64 - 32, 2) <= 20.5 * 20.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS val FROM range(4096) t(g)")
add("phantom_rectangle", lambda s, d: shown(PH.rectangle(s, (16, 16, 16), (2, 3, 4), (9, 12, 15))), "SELECT g AS idx, (CASE WHEN g % 16 BETWEEN 2 AND 8 AND (g // 16) % 16 BETWEEN 3 AND 11 AND g // 256 BETWEEN 4 AND 14 THEN 1.0 ELSE 0.0 END)::DOUBLE AS val FROM range(4096) t(g)")
add("phantom_ellipsoid", lambda s, d: shown(PH.rasterize(s, Grid((24, 24, 24)), [PH.Solid("ellipsoid", 1.5, (12, 11, 10), (8, 6, 5)), PH.Solid("box", 0.25, (12, 12, 12), (4, 4, 4))])), "SELECT g AS idx, (CASE WHEN pow(g % 24 - 12, 2) / 64.0 + pow((g // 24) % 24 - 11, 2) / 36.0 + pow(g // 576 - 10, 2) / 25.0 <= 1 THEN 1.5 ELSE 0.0 END + CASE WHEN abs(g % 24 - 12) <= 4 AND abs((g // 24) % 24 - 12) <= 4 AND abs(g // 576 - 12) <= 4 THEN 0.25 ELSE 0.0 END)::DOUBLE AS val FROM range(13824) t(g)")
add("noise_gaussian", lambda s, d: shown(PH.gaussian_noise(T.balances(s, d), 0.0, 0.1, 7)))
add("noise_poisson", lambda s, d: shown(PH.poisson_noise(T.balances(s, d), 4.0, 7)))


def _pose_columns(det: G.Detector, s: SparkSession) -> DataFrame:
    return det.table(s).select(F.col("pose").cast("long").alias("pose"), *[(F.round(F.col("C")[i], 6) + 0.0).alias(f"c{i}") for i in range(len(det.poses[0].centre))])


add("trajectory_circle", lambda s, d: _pose_columns(G.circle_trajectory(36, Grid((32, 32)), 350, 100.0, 20.0), s), "SELECT i AS pose, round(16 - 100 * sin(radians(10.0 * i)), 6) + 0.0 AS c0, round(16 - 100 * cos(radians(10.0 * i)), 6) + 0.0 AS c1 FROM range(36) t(i)")
add("subset_round_robin", lambda s, d: s.createDataFrame([(k, int(p)) for k, ps in enumerate(G.subsets(G.circle_trajectory(20, Grid((8, 8)), 190, 100.0, 20.0), 3)) for p in ps], "subset long, pose long"), "SELECT i % 3 AS subset, i AS pose FROM range(20) t(i)")
add("subset_rotational", lambda s, d: s.createDataFrame([(k, int(p)) for k, ps in enumerate(G.subsets(G.circle_trajectory(18, Grid((8, 8)), 170, 100.0, 20.0), 3, G.ROTATIONAL_CLUSTERING)) for p in ps], "subset long, pose long"), "SELECT (17 - i) % 3 AS subset, i AS pose FROM range(1, 18) t(i) UNION ALL SELECT 17 % 3, 0")


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


from . import catalog_more, catalog_rays  # noqa: E402, F401  (they register their queries)
