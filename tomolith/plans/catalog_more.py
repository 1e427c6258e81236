"""Queries of the operators that the main catalogue leaves out, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolith.errors import Error
from tomolith.functions import basis as B
from tomolith.functions import columns as C
from tomolith.functions import functionals as FN
from tomolith.operators import linear as OL
from tomolith.sources import files as IO
from tomolith.sources import phantoms as PH
from tomolith.streaming.frames import reconstruct_stream

from . import descriptor as D
from . import geometry as G
from . import recipes
from . import tables as T
from .catalog import FLAGS, IMAGE, SB, TRADE, X, Y, _by_flag, _pgd_sql, _vec, add, scalars, shown
from .descriptor import Grid
from .vector import Vector, concatenate

# --- access, copies, types -----------------------------------------------------------------------
add(
    "access", lambda s, d: (lambda v: scalars(s, linear=v[37], place=v[(5, 9)], at=v.at((31, 31)), outside=v.at((-1, 3)), beyond=v.at((3, 32))))(T.image(s, d).saved()),
    f"SELECT max(CASE WHEN idx = 37 THEN val END) AS linear, max(CASE WHEN idx = 293 THEN val END) AS place, max(CASE WHEN idx = 1023 THEN val END) AS at, 0.0::DOUBLE AS outside, 0.0::DOUBLE AS beyond FROM {IMAGE}",
)
add("assign_block", lambda s, d: (lambda v: shown(v.with_block(1, v.block(0) * 2.0)))(_by_flag(s, d)), f"SELECT a.idx, round(CASE WHEN a.idx BETWEEN 366 AND 731 THEN 2 * b.val ELSE a.val END, 6) + 0.0 AS val FROM {FLAGS} a LEFT JOIN {FLAGS} b ON b.idx = a.idx - 366")
add("materialize", lambda s, d: shown(T.balances(s, d).saved()), _vec(Y, "val"))
add("array_round_trip", lambda s, d: shown(Vector.from_array(s, T.image(s, d).to_array(), Grid((32, 32)))), f"SELECT idx, val FROM {IMAGE}")
add("iterate", lambda s, d: s.createDataFrame([(i, float(x)) for i, x in enumerate(T.image(s, d).iterate())], "idx long, val double"), f"SELECT idx, val FROM {IMAGE}")
add("zeros", lambda s, d: shown(Vector.full(s, Grid((4, 5, 6)))), "SELECT g AS idx, 0.0::DOUBLE AS val FROM range(120) t(g)")
add("cast", lambda s, d: scalars(s, 3, total=T.balances(s, d).map(lambda x: x * 10).cast("bigint").cast("double").sum()), f"SELECT sum(trunc(val * 10))::DOUBLE AS total FROM {Y}")
add("complex_conj", lambda s, d: shown((T.balances(s, d).as_complex() * (2 + 1j)).conj().imag()), _vec(Y, "-val"))
add("complex_sign", lambda s, d: shown((lambda y: ((y - 3.0).as_complex() + y.as_complex() * 1j).sign())(T.balances(s, d))), _vec(Y, "CASE WHEN val = 3 THEN sign(val) ELSE sign(val - 3) END"))
add("complex_quotient", lambda s, d: shown(((T.balances(s, d).as_complex() * (2 + 1j)) / ((T.balances(s, d) + 20.0).as_complex() * (1 - 1j))).real()), _vec(Y, "val / (val + 20) * 0.5"))


def _complex_dot(s: SparkSession, d: str) -> DataFrame:
    y = T.balances(s, d).as_complex()
    z = (y * (2 + 1j)).dot(y * (1 - 3j))
    return scalars(s, 4, re=z.real, im=z.imag)


add("complex_dot", _complex_dot, f"SELECT round(-sum(val * val), 4) AS re, round(-7 * sum(val * val), 4) AS im FROM {Y}")
add("complex_norms", lambda s, d: (lambda z: scalars(s, 4, l1=z.l1(), l2=z.squared_l2(), linf=z.linf(), total=z.sum().imag))(T.balances(s, d).as_complex() * (3 + 4j)), f"SELECT round(5 * sum(abs(val)), 4) AS l1, round(25 * sum(val * val), 4) AS l2, round(5 * max(abs(val)), 4) AS linf, round(4 * sum(val), 4) AS total FROM {Y}")
add("fft_shift_odd", lambda s, d: shown(Vector.generate(s, Grid((5, 7)), lambda i: i * 1.0).fft_shift()), "SELECT (g % 5 + 2) % 5 + 5 * ((g // 5 + 3) % 7) AS idx, g::DOUBLE AS val FROM range(35) t(g)")
add("ifft_shift_odd", lambda s, d: shown(Vector.generate(s, Grid((5, 7)), lambda i: i * 1.0).fft_shift(inverse=True)), "SELECT (g % 5 + 3) % 5 + 5 * ((g // 5 + 4) % 7) AS idx, g::DOUBLE AS val FROM range(35) t(g)")


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Shape, size, blocks and comparisons of a stack of two images."""
    a = T.image(s, d)
    stack = concatenate(a, a)
    same, other = a.same_shape(T.image(s, d)), a.same_shape(stack)
    return scalars(s, size=stack.size, dims=stack.desc.ndim, blocks=stack.blocks, same=float(same), other=float(other), close=float(a.allclose(a * 1.0)), far=float(a.allclose(a + 1.0)))


add("facts", _facts, "SELECT 2048.0::DOUBLE AS size, 1.0::DOUBLE AS dims, 2.0::DOUBLE AS blocks, 1.0::DOUBLE AS same, 0.0::DOUBLE AS other, 1.0::DOUBLE AS close, 0.0::DOUBLE AS far")
add("format", lambda s, d: s.createDataFrame([(Vector.generate(s, Grid((20,)), lambda i: i * 0.5).format(2),)], "text string"), "SELECT 'Vector(20,)[0, 0.5, ..., 9, 9.5]' AS text")

# --- scalar functions ----------------------------------------------------------------------------
add("column_functions", lambda s, d: shown(T.balances(s, d).map(lambda v: C.heaviside(v, 0.5) + C.sign(v) * 2 + C.lerp(v, v * 3, F.lit(0.25)))), _vec(Y, "CASE WHEN val > 0 THEN 1 WHEN val < 0 THEN 0 ELSE 0.5 END + 2 * sign(val) + val + 0.5 * val"))
add("factorial", lambda s, d: s.range(21).select(F.col("id").cast("int").alias("n"), C.factorial(F.col("id")).alias("value")), "SELECT g::INT AS n, factorial(g::INT)::BIGINT AS value FROM range(21) t(g)")
add(
    "binomial", lambda s, d: s.range(231).select(F.floor((F.sqrt(8 * F.col("id") + 1) - 1) / 2).cast("long").alias("n"), "id").select("n", (F.col("id") - F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("k")).select("n", "k", C.binom(F.col("n"), F.col("k")).alias("value")),
    "SELECT n, k, (factorial(n::INT) / (factorial(k::INT) * factorial((n - k)::INT)))::BIGINT AS value FROM range(21) t(n), range(21) u(k) WHERE k <= n",
)
add(
    "bessel", lambda s, d: s.createDataFrame([(n, i, round(float(B.bessel_i(n, i / 4)), 6)) for n in range(4) for i in range(41)], "n long, i long, value double"),
    "SELECT n, i, round(sum(pow(i / 8.0, 2 * k + n) / (factorial(k::INT)::DOUBLE * factorial((k + n)::INT)::DOUBLE)), 6) AS value FROM range(4) t(n), range(41) u(i), range(28) w(k) GROUP BY 1, 2",
)
_I = "(SELECT sum(pow({z} / 2, 2 * k + 2) / (factorial(k::INT)::DOUBLE * factorial((k + 2)::INT)::DOUBLE)) FROM range(30) q(k))"
_W = "(1 - pow(i / 20.0, 2))"
add(
    "blob_basis", lambda s, d: s.createDataFrame([(i, *(round(float(x), 7) + 0.0 for x in (B.blob(i / 10, 2.0, 10.83, 2), B.blob_projected(i / 10), B.blob_derivative_projected(i / 10)))) for i in range(20)], "i long, blob double, line double, slope double"),
    f"""WITH i2 AS MATERIALIZED (SELECT {_I.format(z="10.83")} AS v),
z AS MATERIALIZED (SELECT i, {_W} AS w, 10.83 * sqrt({_W}) AS z FROM range(20) t(i)),
b AS (SELECT i, w, z, sum(pow(z / 2, 2 * k + 2) / (factorial(k::INT)::DOUBLE * factorial((k + 2)::INT)::DOUBLE)) AS top FROM z, range(30) q(k) GROUP BY 1, 2, 3)
SELECT i, round(top / v * w, 7) + 0.0 AS blob, round(4 / 10.83 * w * ((3 / (z * z) + 1) * (exp(z) - exp(-z)) / 2 - 3 / z * (exp(z) + exp(-z)) / 2) / v, 7) + 0.0 AS line,
round(i / 10.0 * -2 * ((exp(z) + exp(-z)) / 2 * z - (exp(z) - exp(-z)) / 2) / (10.83 * 2) / v, 7) + 0.0 AS slope FROM b, i2""",
)
add(
    "bspline_basis", lambda s, d: s.createDataFrame([(i, *(round(float(x), 8) + 0.0 for x in (B.bspline(i / 8 - 2, 2), B.bspline(i / 8 - 2, 3), B.bspline_derivative(i / 8 - 2, 2)))) for i in range(33)], "i long, two double, three double, slope double"),
    """SELECT i, round(CASE WHEN a <= 0.5 THEN 0.75 - a * a WHEN a <= 1.5 THEN (1.5 - a) * (1.5 - a) / 2 ELSE 0 END, 8) + 0.0 AS two, round(CASE WHEN a <= 1 THEN 2.0 / 3 - a * a + a * a * a / 2 WHEN a <= 2 THEN pow(2 - a, 3) / 6 ELSE 0 END, 8) + 0.0 AS three,
round(greatest(1 - abs(x + 0.5), 0) - greatest(1 - abs(x - 0.5), 0), 8) + 0.0 AS slope FROM (SELECT i, i / 8.0 - 2 AS x, abs(i / 8.0 - 2) AS a FROM range(33) t(i))""",
)


def _interval(s: SparkSession, d: str) -> DataFrame:
    values = [float(x) for x in T.supplier_balances(s, d).iterate()]
    mean, deviation = B.mean_stddev(values)
    low, high = B.confidence_interval_95(len(values), mean, deviation)
    few = B.confidence_interval_95(5, mean, deviation)
    return scalars(s, mean=mean, deviation=deviation, low=low, high=high, few=few[1])


add("statistics", _interval, f"SELECT round(m, 6) AS mean, round(v, 6) AS deviation, round(m - c * v, 6) AS low, round(m + c * v, 6) AS high, round(m + 2.776445 * v, 6) AS few FROM (SELECT avg(val) AS m, stddev_pop(val) AS v, CASE WHEN count(*) > 30 THEN 1.96 WHEN count(*) = 10 THEN 2.262157 END AS c FROM {SB})")

# --- operators, functionals, preprocessing ------------------------------------------------------------
add("op_leaf", lambda s, d: shown(OL.leaf(T.trade(s, d)).apply(T.supplier_balances(s, d)), 8), f"SELECT k AS idx, round(coalesce(v, 0), 8) + 0.0 AS val FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN (SELECT r, sum(w * val) AS v FROM {TRADE} JOIN {SB} x ON c = x.idx GROUP BY r) ON r = k")
add("op_row_sums", lambda s, d: shown(T.trade(s, d).row_sums(), 6), f"SELECT k AS idx, round(coalesce(v, 0), 6) + 0.0 AS val FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN (SELECT r, sum(w) AS v FROM {TRADE} GROUP BY r) ON r = k")
add("f_nonnegativity", lambda s, d: (lambda y: scalars(s, some=FN.IndicatorNonNegativity(y.desc).evaluate(y), none=FN.IndicatorNonNegativity(y.desc).evaluate(y.abs())))(T.balances(s, d)), f"SELECT CASE WHEN bool_or(val < 0) THEN 'inf'::DOUBLE ELSE 0 END AS some, 0.0::DOUBLE AS none FROM {Y}")


def _constraint(s: SparkSession, d: str) -> DataFrame:
    """Ax + Bz - c of a constraint at x = the balances, z = their magnitudes."""
    y = T.balances(s, d)
    c = FN.Constraint(OL.Scaling(y.desc, 2.0), OL.Identity(y.desc), y.square())
    return shown(c.a.apply(y) + c.b.apply(y.abs()) - c.c)


add("f_constraint", _constraint, _vec(Y, "2 * val + abs(val) - val * val"))
add("f_least_squares_relation", lambda s, d: scalars(s, 4, value=FN.LeastSquares(T.trade(s, d), T.balances(s, d)).evaluate(T.supplier_balances(s, d))), f"SELECT round(sum(pow(coalesce(v, 0) - val, 2)) / 2, 4) AS value FROM {Y} y LEFT JOIN (SELECT r, sum(w * val) AS v FROM {TRADE} JOIN {SB} x ON c = x.idx GROUP BY r) ON r = y.idx")
add("f_least_squares_relation_gradient", lambda s, d: shown(FN.LeastSquares(T.trade(s, d), T.balances(s, d)).gradient(T.supplier_balances(s, d)), 4), f"WITH e AS (SELECT y.idx, coalesce(v, 0) - val AS val FROM {Y} y LEFT JOIN (SELECT r, sum(w * val) AS v FROM {TRADE} JOIN {SB} x ON c = x.idx GROUP BY r) ON r = y.idx) SELECT k AS idx, round(coalesce(g, 0), 4) + 0.0 AS val FROM (SELECT s_suppkey AS k FROM supplier) LEFT JOIN (SELECT c, sum(w * val) AS g FROM {TRADE} JOIN e ON r = e.idx GROUP BY c) ON c = k")
add("beam_hardening", lambda s, d: shown(recipes.beam_hardening(T.balances(s, d), (1.0, 0.25, -0.125))), _vec(Y, "val + 0.25 * val * val - 0.125 * val * val * val"))
add("absorption", lambda s, d: shown(recipes.absorption(T.prices(s, d) + 1.0, 700.0)), _vec(X, "-ln((val + 1) / 700)"))
add("background", lambda s, d: scalars(s, mean=recipes.background_mean(T.image(s, d), (2, 4), (9, 20))), f"SELECT round(avg(val), 6) AS mean FROM {IMAGE} WHERE idx % 32 BETWEEN 2 AND 8 AND idx // 32 BETWEEN 4 AND 19")
add("rebin", lambda s, d: shown(recipes.rebin(T.image(s, d), 3)), f"SELECT (idx % 32) // 3 + 10 * ((idx // 32) // 3) AS idx, round(avg(val), 6) AS val FROM {IMAGE} WHERE idx % 32 < 30 AND idx // 32 < 30 GROUP BY 1")

# --- phantoms --------------------------------------------------------------------------------------
_SOLIDS = ", ".join(str(row) for row in PH.SHEPP_LOGAN_3D)
_TABLE = f"(SELECT * FROM (VALUES {_SOLIDS}) t(amp, hx, hy, hz, px, py, pz, phi, theta, psi))"


def _scaled(n: int) -> str:
    one = lambda c: f"round({c}::DOUBLE * {(n - 1) / 2})::BIGINT"
    return f"SELECT amp::DOUBLE AS amp, {one('hx')} AS hx, {one('hy')} AS hy, {one('hz')} AS hz, {one('px')} + {n // 2} AS cx, {one('py')} + {n // 2} AS cy, {one('pz')} + {n // 2} AS cz, radians(phi::DOUBLE + psi::DOUBLE) AS turn, radians(phi::DOUBLE) AS phi FROM {_TABLE}"


add(
    "phantom_shepp_logan_3d", lambda s, d: shown(PH.shepp_logan(s, (24, 24, 24))),
    f"""WITH e AS (SELECT * FROM ({_scaled(24)}) WHERE least(hx, hy, hz) >= 1),
p AS (SELECT g, amp, hx, hy, hz, cos(turn) * (g % 24 - cx) + sin(turn) * ((g // 24) % 24 - cy) AS qx, cos(turn) * ((g // 24) % 24 - cy) - sin(turn) * (g % 24 - cx) AS qy, g // 576 - cz AS qz FROM range(13824) t(g), e)
SELECT g AS idx, round(sum(CASE WHEN qx * qx / (hx * hx) + qy * qy / (hy * hy) + qz * qz / (hz * hz) <= 1 THEN amp ELSE 0 END), 6) + 0.0 AS val FROM p GROUP BY g""",
)
add(
    "phantom_shepp_logan_2d", lambda s, d: shown(PH.shepp_logan(s, (32, 32))),
    f"""WITH e0 AS (SELECT row_number() OVER () AS k, * FROM ({_scaled(32)})),
e1 AS (SELECT *, CASE WHEN hx <> hy AND phi <> 0 THEN floor(sqrt(pow(hx * cos(phi), 2) + pow(hy * sin(phi), 2)))::BIGINT ELSE 0 END AS far FROM e0 WHERE hx > 0 OR hy > 0),
e AS MATERIALIZED (SELECT k, amp, cx, cy, CASE WHEN far > 0 THEN far ELSE hx END AS a, CASE WHEN far > 0 THEN hx * hy // far ELSE hy END AS b, CASE WHEN far > 0 THEN far ELSE 1 END AS run, CASE WHEN far > 0 THEN floor((hx * hx - hy * hy) * sin(phi) * cos(phi) / sqrt(pow(hx * cos(phi), 2) + pow(hy * sin(phi), 2)))::BIGINT ELSE 0 END AS rise FROM e1),
f AS (SELECT k, a, b, y, coalesce(max(x) FILTER (WHERE y <= b AND 2 * b * b * x * x + a * a * (y * y + (y - 1) * (y - 1)) <= 2 * a * a * b * b), -1) AS flat, coalesce(max(x) FILTER (WHERE b * b * (x * x + (x - 1) * (x - 1)) + 2 * a * a * y * y <= 2 * a * a * b * b), -1) AS steep FROM e, range(40) t(y), range(40) u(x) GROUP BY 1, 2, 3, 4),
w AS MATERIALIZED (SELECT f.k, f.y, CASE WHEN f.a = 0 OR f.b = 0 THEN CASE WHEN f.y = 0 THEN f.a ELSE -1 END WHEN f.y > f.b THEN -1 WHEN f.b * f.b * greatest(f.flat, n.flat + 1) < f.a * f.a * f.y THEN greatest(f.flat, n.flat + 1) WHEN f.b * f.b * f.steep >= f.a * f.a * f.y THEN f.steep ELSE -1 END AS width FROM f JOIN f n ON n.k = f.k AND n.y = f.y + 1),
p AS (SELECT g, e.k, amp, g % 32 - cx AS dx, abs(32 - g // 32 - cy - trunc((g % 32 - cx) * rise / run)) AS y FROM range(1024) t(g), e)
SELECT g AS idx, round(sum(CASE WHEN abs(dx) <= coalesce(width, -1) THEN amp ELSE 0 END), 6) + 0.0 AS val FROM p LEFT JOIN w ON w.k = p.k AND w.y = p.y GROUP BY g""",
)
add(
    "phantom_blob", lambda s, d: shown(PH.smooth_blob(s, (32, 32))),
    f"""WITH i2 AS MATERIALIZED (SELECT {_I.format(z="10.83")} AS v), p AS (SELECT g, greatest(1 - (pow(g % 32 - 15.5, 2) + pow(g // 32 - 15.5, 2)) / 256, 0) AS w FROM range(1024) t(g)),
b AS (SELECT g, w, sum(pow(10.83 * sqrt(w) / 2, 2 * k + 2) / (factorial(k::INT)::DOUBLE * factorial((k + 2)::INT)::DOUBLE)) AS top FROM p, range(30) q(k) GROUP BY 1, 2)
SELECT g AS idx, round(top / v * w, 6) + 0.0 AS val FROM b, i2""",
)
add(
    "phantom_solids", lambda s, d: shown(PH.rasterize(s, Grid((20, 20, 20)), [PH.Solid("sphere", 1.0, (9, 9, 9), (7, 7, 7), order=0), PH.Solid("cylinder", 2.0, (10, 9, 8), (6, 3, 2), axis=2, order=1), PH.Solid("box", 3.0, (10, 10, 10), (6, 1, 1), (45.0, 0.0, 0.0), order=2), PH.Solid("ellipsoid", 4.0, (5, 12, 12), (4, 3, 3), clip_x=5, order=3)], PH.OVERWRITE)),
    """SELECT g AS idx, (CASE WHEN x <= 5 AND pow(x - 5, 2) / 16.0 + pow(y - 12, 2) / 9.0 + pow(z - 12, 2) / 9.0 <= 1 THEN 4 WHEN abs((x - 10) + (y - 10)) / sqrt(2) <= 6 AND abs((y - 10) - (x - 10)) / sqrt(2) <= 1 AND abs(z - 10) <= 1 THEN 3
WHEN abs(z - 8) <= 6 AND pow(x - 10, 2) / 9.0 + pow(y - 9, 2) / 4.0 <= 1 THEN 2 WHEN pow(x - 9, 2) + pow(y - 9, 2) + pow(z - 9, 2) <= 49 THEN 1 ELSE 0 END)::DOUBLE AS val FROM (SELECT g, g % 20 AS x, (g // 20) % 20 AS y, g // 400 AS z FROM range(8000) t(g))""",
)


def _noise(s: SparkSession, d: str) -> DataFrame:
    """Whether mean and spread of much noise are what they should be, and the same seed gives the same."""
    zero = Vector.full(s, Grid((40_000,)))
    g, p = PH.gaussian_noise(zero, 1.0, 2.0, 3), PH.poisson_noise(zero, 4.0, 3)
    (gm, gs), (pm, ps, low) = (v.df.agg(*c).first() for v, c in ((g, (F.avg("val"), F.stddev("val"))), (p, (F.avg("val"), F.stddev("val"), F.min("val")))))
    again = (g - PH.gaussian_noise(zero, 1.0, 2.0, 3)).linf()
    return scalars(s, gauss=float(abs(gm - 1) < 0.05 and abs(gs - 2) < 0.05), waiting=float(abs(pm - 0.25) < 0.01 and abs(ps - 0.25) < 0.01 and low >= 0), again=again, none=(PH.no_noise(zero) - zero).linf())


add("noise_moments", _noise, "SELECT 1.0::DOUBLE AS gauss, 1.0::DOUBLE AS waiting, 0.0::DOUBLE AS again, 0.0::DOUBLE AS none")


# --- trajectories ------------------------------------------------------------------------------------
def _poses(det: G.Detector, s: SparkSession) -> DataFrame:
    return det.table(s).select(F.col("pose").cast("long").alias("pose"), *[(F.round(F.col("C")[i], 6) + 0.0).alias(f"c{i}") for i in range(len(det.poses[0].centre))])


add("trajectory_limited", lambda s, d: _poses(G.limited_angle_trajectory(30, (40.0, 70.0), Grid((32, 32)), 360, 100.0, 20.0), s), "SELECT row_number() OVER (ORDER BY a) - 1 AS pose, round(16 - 100 * sin(radians(a)), 6) + 0.0 AS c0, round(16 - 100 * cos(radians(a)), 6) + 0.0 AS c1 FROM (SELECT 10.0 * i AS a FROM range(36) t(i)) WHERE a % 180 < 40 OR a % 180 > 70")
add(
    "trajectory_sphere", lambda s, d: _poses(G.sphere_trajectory(40, Grid((8, 8, 8)), 4, 100.0, 20.0), s),
    """WITH b AS (SELECT k, pi() * (k + 1) / 6 - pi() / 2 AS beta FROM range(4) t(k)), l AS (SELECT k, beta, floor(40 * cos(beta) / sum(cos(beta)) OVER ())::BIGINT AS n FROM b),
m AS (SELECT k, beta, CASE WHEN k = 3 THEN 40 - sum(n) FILTER (WHERE k < 3) OVER () ELSE n END::BIGINT AS n FROM l),
p AS (SELECT k, j, beta, 2 * pi() * j / n AS gamma FROM m, range(40) u(j) WHERE j < n)
SELECT row_number() OVER (ORDER BY k, j) - 1 AS pose, round(4 + 100 * sin(gamma) * cos(beta), 6) + 0.0 AS c0, round(4 - 100 * sin(gamma) * sin(beta), 6) + 0.0 AS c1, round(4 - 100 * cos(gamma), 6) + 0.0 AS c2 FROM p""",
)
add("detector_default", lambda s, d: scalars(s, **{f"n{n}": G.circle_trajectory(2, Grid((n, n)), 90, 100.0, 20.0).shape[0] for n in (16, 32, 100, 129)}), "SELECT floor(16 * sqrt(2)) AS n16, floor(32 * sqrt(2)) AS n32, floor(100 * sqrt(2)) AS n100, floor(129 * sqrt(2)) AS n129")


# --- files: written and read back -------------------------------------------------------------------
def _through(name: str, write, digits: int) -> None:  # noqa: ANN001
    def query(s: SparkSession, d: str) -> DataFrame:
        folder = f"{s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/files-{uuid.uuid4().hex}"
        path = write(T.image(s, d) * 0.25, folder)
        return shown(IO.read(s, path).saved(), digits)

    add(name, query, f"SELECT idx, round(val * 0.25, {digits}) + 0.0 AS val FROM {IMAGE}")


def _edf(v: Vector, folder: str) -> str:
    IO.write(v, f"{folder}/a.edf")
    return f"{folder}/a.edf"


def _mhd(v: Vector, folder: str) -> str:
    IO.write_mhd(v, f"{folder}/a.mhd", f"{folder}/a.raw", "MET_DOUBLE")
    return f"{folder}/a.mhd"


def _mha(v: Vector, folder: str) -> str:
    IO.write(v, f"{folder}/a.mha")
    return f"{folder}/a.mha"


for _name, _write in (("file_edf", _edf), ("file_mhd", _mhd), ("file_mha", _mha)):
    _through(_name, _write, 4)


def _pgm(s: SparkSession, d: str) -> DataFrame:
    """The lines of a grey map, without its three header lines, as index and grey."""
    path = f"{s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/files-{uuid.uuid4().hex}/a.pgm"
    IO.write(T.image(s, d), path)
    text = s.read.text(path, wholetext=True).select(F.slice(F.split(F.trim("value"), r"\s+"), 5, 1024).alias("v"))
    return text.select(F.posexplode("v").alias("idx", "grey")).select(F.col("idx").cast("long").alias("idx"), F.col("grey").cast("double").alias("val"))


add("file_pgm", _pgm, f"SELECT idx, floor((val - lo) * (255 / (hi - lo))) AS val FROM (SELECT *, min(val) OVER () AS lo, max(val) OVER () AS hi FROM {IMAGE})")


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Element types of a header decoded from bytes: 16-bit integers behind a header of an EDF file."""
    path = f"{s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/files-{uuid.uuid4().hex}/a.edf"
    IO.write_edf(Vector.generate(s, Grid((9, 7)), lambda i: i * 3.0 - 50), path, "SignedShort")
    return shown(IO.read(s, path).saved())


add("file_raw_short", _raw, "SELECT g AS idx, (g * 3.0 - 50)::DOUBLE AS val FROM range(63) t(g)")



# --- a stream of frames --------------------------------------------------------------------------------
def _stream(s: SparkSession, d: str) -> DataFrame:
    """Two frames as files, b and 2 b, read as a stream and solved one after the other."""
    folder = f"{s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/stream-{uuid.uuid4().hex}"
    a, b = T.segments(s, d)
    for k in (0, 1):
        (b * (k + 1.0)).df.select(F.lit(k).cast("long").alias("frame"), "idx", "val").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    frames = s.readStream.schema("frame long, idx long, val double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    a = a.persisted()
    try:
        reconstruct_stream(a, frames, f"{folder}/out", f"{folder}/state", 3, once=True).awaitTermination()
    finally:
        a.unpersist()
    out = s.read.parquet(f"{folder}/out")
    return out.select(F.col("frame").cast("long").alias("frame"), "idx", (F.round("val", 4) + 0.0).alias("val"))


add("stream_frames", _stream, " UNION ALL ".join(f"SELECT {k} AS frame, idx, val FROM ({_pgd_sql(3, 'greatest(val, 0)', True, k + 1)})" for k in (0, 1)))


# --- places, sizes, shapes ---------------------------------------------------------------------------
def _places(s: SparkSession, d: str) -> DataFrame:
    """Every coordinate of a box in order, with its index."""
    rows = [(i, *map(int, c)) for i, c in enumerate(D.cartesian_indices((2, 1, 3), (5, 4, 6)))]
    return s.createDataFrame(rows, "n long, x long, y long, z long")


add("cartesian_indices", _places, "SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS n, x, y, z FROM range(2, 5) a(x), range(1, 4) b(y), range(3, 6) c(z)")


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Whether wrong sizes and places are refused: 1 for each that raises."""
    calls = {
        "array": lambda: Vector.from_array(s, np.zeros(5), Grid((2, 3))), "sum": lambda: Vector.full(s, Grid((3,))) + Vector.full(s, Grid((4,))), "place": lambda: Vector.full(s, Grid((3,)))[3],
        "view": lambda: Vector.full(s, Grid((3,))).view_as(Grid((2, 2))), "grid": lambda: Grid((0, 2)), "file": lambda: IO.read(s, "a.txt"),
    }
    out = {}
    for name, call in calls.items():
        try:
            call()
            out[name] = 0.0
        except Error:
            out[name] = 1.0
    return scalars(s, **out)


add("refused_arguments", _refused, "SELECT 1.0::DOUBLE AS array, 1.0::DOUBLE AS sum, 1.0::DOUBLE AS place, 1.0::DOUBLE AS view, 1.0::DOUBLE AS grid, 1.0::DOUBLE AS file")
add("phantom_scale", lambda s, d: s.createDataFrame([(n, k, PH.scale(Grid((n, n)), k / 20), PH.scale_shift(Grid((n, n)), k / 20 - 0.5)) for n in (16, 33, 128) for k in range(21)], "n long, k long, size long, place long"), "SELECT n, k, round(k / 20.0 * (n - 1) / 2)::BIGINT AS size, round((k / 20.0 - 0.5) * (n - 1) / 2)::BIGINT + n // 2 AS place FROM (VALUES (16::BIGINT), (33), (128)) t(n), range(21) u(k)")
add(
    "phantom_ellipse", lambda s, d: shown(PH.draw_ellipses(Vector.full(s, Grid((64, 64)), 0.5), [PH.Ellipse(2.0, (30, 33), (14, 9)), PH.Ellipse(1.0, (30, 33), (9, 20))])),
    """WITH e(k, amp, a, b) AS (VALUES (1, 2.0, 14, 9), (2, 1.0, 9, 20)),
f AS (SELECT k, a, b, y, coalesce(max(x) FILTER (WHERE y <= b AND 2 * b * b * x * x + a * a * (y * y + (y - 1) * (y - 1)) <= 2 * a * a * b * b), -1) AS flat, coalesce(max(x) FILTER (WHERE b * b * (x * x + (x - 1) * (x - 1)) + 2 * a * a * y * y <= 2 * a * a * b * b), -1) AS steep FROM e, range(40) t(y), range(40) u(x) GROUP BY 1, 2, 3, 4),
w AS MATERIALIZED (SELECT f.k, f.y, CASE WHEN f.y > f.b THEN -1 WHEN f.b * f.b * greatest(f.flat, n.flat + 1) < f.a * f.a * f.y THEN greatest(f.flat, n.flat + 1) WHEN f.b * f.b * f.steep >= f.a * f.a * f.y THEN f.steep ELSE -1 END AS width FROM f JOIN f n ON n.k = f.k AND n.y = f.y + 1)
SELECT g AS idx, round(0.5 + sum(CASE WHEN abs(g % 64 - 30) <= coalesce(width, -1) THEN amp ELSE 0 END), 6)::DOUBLE AS val FROM range(4096) t(g) CROSS JOIN e LEFT JOIN w ON w.k = e.k AND w.y = abs(64 - g // 64 - 33) GROUP BY g""",
)
add("trajectory_curved", lambda s, d: _poses(G.curved_circle_trajectory(10, Grid((32, 32)), 90, 100.0, 20.0, 0.8), s), "SELECT i AS pose, round(16 - 100 * sin(radians(10.0 * i)), 6) + 0.0 AS c0, round(16 - 100 * cos(radians(10.0 * i)), 6) + 0.0 AS c1 FROM range(10) t(i)")
add(
    "neighbours_in_slice", lambda s, d: s.createDataFrame([tuple(map(int, c)) for c in D.neighbours_in_slice((3, 0, 6), 2, 1, (0, 0, 0), (8, 8, 8))], "x long, y long, z long"),
    "SELECT x, 0::BIGINT AS y, z FROM range(1, 6) a(x), range(4, 8) b(z)",
)


def _forbild(s: SparkSession, d: str) -> DataFrame:
    """A head-sized phantom from a table of three solids in centimetres, the last on top."""
    path = f"{s.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/solids-{uuid.uuid4().hex}"
    rows = [("ellipsoid", 1.0, 0.0, 0.0, 0.0, 9.0, 11.0, 8.0, 0), ("sphere", 2.0, 2.0, -3.0, 1.0, 4.0, 4.0, 4.0, 1), ("box", 3.0, -3.0, 2.0, 0.0, 2.0, 3.0, 2.0, 2), ("sphere", 4.0, 0.0, 0.0, 0.0, 0.3, 0.3, 0.3, 3)]
    s.createDataFrame([(*r[:8], 0.0, 0.0, 0.0, 2, None, r[8]) for r in rows], PH.SOLIDS).write.parquet(path)
    return shown(PH.forbild(s, 21, "head", path))


_AT, _LONG = "round(({v} + 12.8) * 20 / 25.6)", "({v} * 20 / 25.6)"


def _away(axis: str, centre: float, half: float, power: bool) -> str:
    offset = f"({axis} - {_AT.format(v=centre)})"
    return f"pow({offset} / {_LONG.format(v=half)}, 2)" if power else f"abs({offset}) <= {_LONG.format(v=half)}"


add(
    "phantom_forbild", _forbild,
    f"""SELECT g AS idx, (CASE WHEN {" AND ".join(_away(a, c, h, False) for a, c, h in (("x", -3.0, 2.0), ("y", 2.0, 3.0), ("z", 0.0, 2.0)))} THEN 3 WHEN {" + ".join(_away(a, c, 4.0, True) for a, c in (("x", 2.0), ("y", -3.0), ("z", 1.0)))} <= 1 THEN 2
WHEN {" + ".join(_away(a, 0.0, h, True) for a, h in (("x", 9.0), ("y", 11.0), ("z", 8.0)))} <= 1 THEN 1 ELSE 0 END)::DOUBLE AS val FROM (SELECT g, g % 21 AS x, (g // 21) % 21 AS y, g // 441 AS z FROM range(9261) t(g))""",
)
