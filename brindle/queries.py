"""Registered queries of the event operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import ID, Dataset, concat
from .functions import lineshape as ls
from .functions import special as sp
from .functions.channel import Channel, Edge, Vertex
from .functions.vectors import Vec3, Vec4
from .operators.binning import Bins
from .operators.cross_section import Axis, CrossSection, Estimate, binned_sums, combine
from .operators.histogram import Histogram
from .operators.likelihood import NLL, ExtendedNLL, LassoPenalty, Likelihood, Normalization, Projection, RidgePenalty
from .operators.predicate import between
from .operators.reduce import LOG, reduce
from .plans.expr import Expr, acos, atan2, complex_, dot, matrix, matvec, parameter, polar_complex, scalar, solve, vector
from .plans.lower import Lowered
from .sources.parquet import read_frame, read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, sf_dir: str, where: str | None = None, weighted: bool = True) -> Dataset:
    """lineitem as events: price, discount, tax, quantity; the quantity is the weight too."""
    cols = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", rename=cols | ({"weight": "l_quantity"} if weighted else {}), where=where, nulls="trust")


def clicks(spark: SparkSession, sf_dir: str) -> Dataset:
    """The stream table as events with ids: value, weighted by 1 + id mod 3."""
    return read_frame(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", value="value", weight="1 + event_id % 3")


def momenta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Vec4, Vec4]:
    """Two four-momenta a and b made of lineitem's columns, with their keys."""
    frame = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        *[F.expr(x) for x in P4],
    )
    return frame, Vec4.event("a"), Vec4.event("b")


P4 = (
    "l_quantity / 10 AS a_px",
    "l_discount * 20 AS a_py",
    "l_tax * 30 + 1 AS a_pz",
    "sqrt(pow(l_quantity / 10, 2) + pow(l_discount * 20, 2) + pow(l_tax * 30 + 1, 2) + 0.25) AS a_e",
    "l_tax * 10 AS b_px",
    "l_quantity / 20 AS b_py",
    "l_discount * 5 - 3 AS b_pz",
    "sqrt(pow(l_tax * 10, 2) + pow(l_quantity / 20, 2) + pow(l_discount * 5 - 3, 2) + 1.0) AS b_e",
)
P4_SQL = f"SELECT l_orderkey, l_linenumber, {', '.join(P4)} FROM lineitem"


def one(spark: SparkSession, **values) -> DataFrame:
    """A row of figures."""
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def columns(frame: DataFrame, keys: list[str], digits: int = 8, **exprs: Expr) -> DataFrame:
    """Keys and the rounded real parts of expressions."""
    low = Lowered(frame, [e for e in exprs.values()])
    return low.frame.select(*keys, *[F.round(p.re, digits).alias(k) for k, p in zip(exprs, low.pairs(), strict=True)])


KEYS = ["l_orderkey", "l_linenumber"]
PRICE, DISCOUNT, TAX, QUANTITY, VALUE = scalar("price"), scalar("discount"), scalar("tax"), scalar("quantity"), scalar("value")


def item_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEYS, *[F.col(c).alias(a) for a, c in (("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"), ("quantity", "l_quantity"))])


# -- reductions and selections ----------------------------------------------------------------------------------------


@query("SELECT round(sum(l_quantity * l_extendedprice * (1 - l_discount)), 0) AS total FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
def weighted_sum(spark, sf_dir):
    return one(spark, total=round(items(spark, sf_dir).select(between(DISCOUNT, 0.05, 0.07)).weighted_sum(PRICE * (1.0 - DISCOUNT)), 0))


@query("SELECT count(*) AS events, round(sum(l_quantity), 3) AS sum_weights FROM lineitem")
def dataset_stats(spark, sf_dir):
    events, weights = items(spark, sf_dir).stats()
    return spark.createDataFrame([(events, round(weights, 3))], "events long, sum_weights double")


def _between(closed: str) -> Query:
    def run(spark, sf_dir):
        ds = items(spark, sf_dir).select(between(TAX, 0.02, 0.05, closed))
        return ds.frame.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(ds.weight), 3).alias("sum_weights"))

    return run


for _name, _closed, _lo, _hi in (("closed", "both", ">=", "<="), ("open", "neither", ">", "<"), ("left", "left", ">=", "<"), ("right", "right", ">", "<=")):
    QUERIES[f"select_between_{_name}"] = _between(_closed)
    ORACLE_SQL[f"select_between_{_name}"] = f"SELECT count(*) AS events, round(sum(l_quantity), 3) AS sum_weights FROM lineitem WHERE l_tax {_lo} 0.02 AND l_tax {_hi} 0.05"


@query("""SELECT sum(CASE WHEN l_discount <> 0 AND l_discount / l_discount <> 2 THEN 1 ELSE 0 END) AS not_equal,
  sum(CASE WHEN l_discount <> 0 AND 1.0 < 2 THEN 1 ELSE 0 END) AS below,
  sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS not_below FROM lineitem""")
def predicate_nan(spark, sf_dir):
    """0 / 0 is NaN: no comparison holds for it, and their negations do."""
    ratio = DISCOUNT / DISCOUNT
    ds = items(spark, sf_dir)
    return one_row(spark, not_equal=ds.select(ratio != 2.0), below=ds.select(ratio < 2.0), not_below=ds.select(~(ratio < 2.0)))


def one_row(spark: SparkSession, **sets: Dataset) -> DataFrame:
    """Event counts as one row, without leaving Spark."""
    out = None
    for k, d in sets.items():
        n = d.frame.agg(F.count(F.lit(1)).alias(k))
        out = n if out is None else out.crossJoin(n)
    return out


@query("SELECT count(*) AS events FROM lineitem WHERE (l_discount < 0.03 OR l_tax > 0.06) AND NOT (l_quantity = 10)")
def predicate_logic(spark, sf_dir):
    return one_row(spark, events=items(spark, sf_dir).select(((DISCOUNT < 0.03) | (TAX > 0.06)) & ~(QUANTITY == 10.0)))


@query("""SELECT bin, count(*) AS events, round(sum(1 + event_id % 3), 3) AS sum_weights FROM (
  SELECT event_id, CASE WHEN value = 400 THEN 3 WHEN value >= 200 AND value < 400 THEN 3 WHEN value >= 50 AND value < 200 THEN 2
    WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 0 AND value < 10 THEN 0 END AS bin FROM events) WHERE bin IS NOT NULL GROUP BY bin""")
def bin_by_last_edge(spark, sf_dir):
    return clicks(spark, sf_dir).bin_by(VALUE, Bins((0, 10, 50, 200, 400))).stats().withColumn("sum_weights", F.round("sum_weights", 3))


@query("""SELECT bin, round(sum(w), 4) AS counts, CASE WHEN bin BETWEEN 0 AND 3 THEN round(sqrt(sum(w * w)), 6) END AS errors FROM (
  SELECT 1 + event_id % 3 AS w, CASE WHEN value < 10 THEN -1 WHEN value >= 300 THEN 4 WHEN value < 50 THEN 0 WHEN value < 100 THEN 1
    WHEN value < 150 THEN 2 ELSE 3 END AS bin FROM events) GROUP BY bin""")
def histogram_flow(spark, sf_dir):
    """Underflow as bin -1, overflow as bin 4; flow has no errors."""
    h = Histogram.of_dataset(clicks(spark, sf_dir), VALUE, (10, 50, 100, 150, 300))
    rows = [(k, round(float(c), 4), round(float(e), 6)) for k, (c, e) in enumerate(zip(h.counts, h.errors, strict=True)) if c]
    rows += [(k, round(float(c), 4), None) for k, c in ((-1, h.underflow), (4, h.overflow)) if c]
    return spark.createDataFrame(rows, "bin int, counts double, errors double")


@query("""SELECT CAST(bin AS BIGINT) AS bin, round(sum(w), 4) AS counts, round(sqrt(sum(w * w)), 6) AS errors FROM (
  SELECT 1 + event_id % 3 AS w, floor(value / 25) AS bin FROM events WHERE value >= 0 AND value < 500) GROUP BY 1""")
def histogram_uniform(spark, sf_dir):
    h = Histogram.of_dataset(clicks(spark, sf_dir), VALUE, tuple(25.0 * k for k in range(21)))
    rows = [(k, round(float(c), 4), round(float(e), 6)) for k, (c, e) in enumerate(zip(h.counts, h.errors, strict=True)) if c]
    return spark.createDataFrame(rows, "bin long, counts double, errors double")


# splitmix64 in SQL, over 128-bit integers
def _uniform_sql(seed: int) -> str:
    return f"""WITH a AS (SELECT event_id, value, CAST((CAST(xor(event_id::UBIGINT, {seed}::UBIGINT) AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z FROM events),
b AS (SELECT event_id, value, CAST((CAST(xor(z, z >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS z FROM a),
c AS (SELECT event_id, value, CAST((CAST(xor(z, z >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS z FROM b),
u AS (SELECT event_id, value, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM c)
"""


@query(_uniform_sql(7) + "SELECT event_id, value FROM u WHERE u < 0.25")
def subsample(spark, sf_dir):
    return clicks(spark, sf_dir).subsample(0.25, 7).frame.select(F.col(ID).alias("event_id"), "value")


def _poisson_sql() -> str:
    from .operators.sampling import poisson_table

    return "CASE " + " ".join(f"WHEN u <= {c!r}::DOUBLE THEN {k}" for k, c in enumerate(poisson_table())) + " ELSE 99 END"


@query(_uniform_sql(11) + f"SELECT event_id, CAST((1 + event_id % 3) * ({_poisson_sql()}) AS DOUBLE) AS weight FROM u")
def bootstrap(spark, sf_dir):
    return clicks(spark, sf_dir).bootstrap(11).frame.select(F.col(ID).alias("event_id"), "weight")


@query(_uniform_sql(5) + ", s AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS k FROM u WHERE value > 100) SELECT k AS event_id, value FROM s WHERE k >= 50 AND k < 200")
def select_rebased_slice(spark, sf_dir):
    """Ids start again after a selection; slices count in them."""
    return clicks(spark, sf_dir).select(VALUE > 100.0).slice(50, 200).frame.select(F.col(ID).alias("event_id"), "value")


@query("SELECT count(*) AS events, round(sum(value), 4) AS total FROM events WHERE event_id % 7 = 3")
def strided_rows(spark, sf_dir):
    return clicks(spark, sf_dir).strided(7, 3).frame.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(*) AS events, round(sum(w), 4) AS sum_weights, CAST(max(k) AS BIGINT) AS last_id FROM (SELECT 1 + event_id % 3 AS w, event_id AS k FROM events UNION ALL SELECT 1 + event_id % 3, event_id + (SELECT count(*) FROM events) FROM events)")
def concat_batches(spark, sf_dir):
    ds = clicks(spark, sf_dir)
    both = concat([ds, ds])
    return both.frame.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(both.weight), 4).alias("sum_weights"), F.max(ID).alias("last_id"))


@query("SELECT event_id, round(value * value / (1 + value), 9) AS weight FROM events")
def reweight(spark, sf_dir):
    return clicks(spark, sf_dir).reweight(VALUE**2 / (1.0 + VALUE)).frame.select(F.col(ID).alias("event_id"), F.round("weight", 9).alias("weight"))


@query("SELECT round(sum(l_quantity * l_discount * cos(l_tax)), 6) AS re, round(sum(l_quantity * l_discount * sin(l_tax)), 6) AS im FROM lineitem")
def weighted_complex_sum(spark, sf_dir):
    z = items(spark, sf_dir).weighted_complex_sum(polar_complex(DISCOUNT, TAX))
    return one(spark, re=round(z.real, 6), im=round(z.imag, 6))


# -- expressions --------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax - 0.04 >= 0 THEN sqrt(l_tax - 0.04) ELSE 0 END, 8) AS root_re,
  round(CASE WHEN l_tax - 0.04 >= 0 THEN 0 ELSE sqrt(0.04 - l_tax) END, 8) AS root_im, round(ln(abs(l_tax - 0.045)), 8) AS log_re,
  round(CASE WHEN l_tax - 0.045 < 0 THEN pi() ELSE 0 END, 8) AS log_im, round(exp(l_discount) * cos(l_tax), 8) AS exp_re,
  round(sin(l_discount) * cosh(l_tax), 8) AS sin_re, round(cos(l_discount) * sinh(l_tax), 8) AS sin_im,
  round(acos(l_discount), 8) AS angle, round(power(1 + l_tax, 5), 8) AS fifth, round(power(1 + l_tax, -3), 8) AS inverse_cube FROM lineitem""")
def complex_functions(spark, sf_dir):
    z = complex_(DISCOUNT, TAX)
    root, log, wave = (TAX - 0.04).sqrt(), (TAX - 0.045).log(), z.sin()
    return columns(item_frame(spark, sf_dir), KEYS, root_re=root.real(), root_im=root.imag(), log_re=log.real(), log_im=log.imag(), exp_re=z.exp().real(), sin_re=wave.real(), sin_im=wave.imag(), angle=acos(DISCOUNT), fifth=(1.0 + TAX) ** 5, inverse_cube=(1.0 + TAX) ** -3)


@query("""SELECT l_orderkey, l_linenumber, round((l_discount * (1 + l_tax) + l_tax * 2) / (power(1 + l_tax, 2) + 4), 8) AS quot_re,
  round((l_tax * (1 + l_tax) - l_discount * 2) / (power(1 + l_tax, 2) + 4), 8) AS quot_im, round(l_discount * l_discount + l_tax * l_tax, 8) AS norm,
  round(atan2(l_tax, l_discount), 8) AS phase, round(-l_tax, 8) AS conj_im FROM lineitem""")
def complex_arithmetic(spark, sf_dir):
    z, w = complex_(DISCOUNT, TAX), complex_(1.0 + TAX, 2.0)
    q = z / w
    return columns(item_frame(spark, sf_dir), KEYS, quot_re=q.real(), quot_im=q.imag(), norm=z.norm_sqr(), phase=atan2(TAX, DISCOUNT), conj_im=z.conj().imag())


@query("""SELECT l_orderkey, l_linenumber, round(l_discount * 2 + l_tax * 3, 8) AS dot, round(l_quantity * l_discount + 2 * l_tax, 8) AS first,
  round((5 * (2 + l_tax) - l_discount * 7) / ((1 + l_quantity) * (2 + l_tax) - l_discount * 0.5), 8) AS x,
  round(((1 + l_quantity) * 7 - 0.5 * 5) / ((1 + l_quantity) * (2 + l_tax) - l_discount * 0.5), 8) AS y FROM lineitem""")
def linear_algebra(spark, sf_dir):
    v = vector([DISCOUNT, TAX])
    x = solve(matrix([[1.0 + QUANTITY, DISCOUNT], [0.5, 2.0 + TAX]]), vector([5.0, 7.0]))
    return columns(item_frame(spark, sf_dir), KEYS, dot=dot(v, vector([2.0, 3.0])), first=matvec(matrix([[QUANTITY, 2.0], [1.0, 1.0]]), v)[0], x=x[0], y=x[1])


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 8) AS dot FROM embeddings")
def vector_dot(spark, sf_dir):
    """The dot product of an embedding's first and second half."""
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])
    a, b = (vector([scalar(f"e{k}") for k in range(s, s + 32)]) for s in (0, 32))
    return columns(frame, ["vec_id"], dot=dot(a, b))


# -- kinematics ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, round(sqrt(power(a_e + b_e, 2) - power(a_px + b_px, 2) - power(a_py + b_py, 2) - power(a_pz + b_pz, 2)), 8) AS mass,
  round(a_e * b_e - a_px * b_px - a_py * b_py - a_pz * b_pz, 8) AS dot, round(a_pz / sqrt(a_px * a_px + a_py * a_py + a_pz * a_pz), 8) AS costheta,
  round(atan2(a_py, a_px), 8) AS phi, round(a_py * b_pz - a_pz * b_py, 8) AS cross_x,
  round(1 / sqrt(1 - (b_px * b_px + b_py * b_py + b_pz * b_pz) / (b_e * b_e)), 8) AS gamma FROM ({P4_SQL})""")
def invariant_mass(spark, sf_dir):
    frame, a, b = momenta(spark, sf_dir)
    return columns(frame, KEYS, mass=(a + b).m(), dot=a.dot(b), costheta=a.vec3().costheta(), phi=a.vec3().phi(), cross_x=a.vec3().cross(b.vec3()).px, gamma=b.gamma())


@query(f"""WITH p AS ({P4_SQL}), t AS (SELECT *, a_e + b_e AS te, a_px + b_px AS tx, a_py + b_py AS ty, a_pz + b_pz AS tz FROM p),
m AS (SELECT *, sqrt(te * te - tx * tx - ty * ty - tz * tz) AS tm FROM t)
SELECT l_orderkey, l_linenumber, round((te * a_e - tx * a_px - ty * a_py - tz * a_pz) / tm, 7) AS energy,
  round(sqrt(power((te * a_e - tx * a_px - ty * a_py - tz * a_pz) / tm, 2) - 0.25), 6) AS momentum FROM m""")
def boost_to_rest(spark, sf_dir):
    """The energy of a in the rest frame of a + b, by a boost."""
    frame, a, b = momenta(spark, sf_dir)
    rest = a.boost(-(a + b).beta())
    low = Lowered(frame, [rest.e, rest.vec3().mag()])
    e, p = low.pairs()
    return low.frame.select(*KEYS, F.round(e.re, 7).alias("energy"), F.round(p.re, 6).alias("momentum"))


def reaction() -> Channel:
    """a beam and b target to X and a recoil r; X is not measured."""
    return Channel.of([Edge("a", "a"), Edge("b", "b"), Edge("x"), Edge("r", "r")], [Vertex("v", ("a", "b"), ("x", "r"))])


@query(f"""SELECT l_orderkey, l_linenumber, round(power(a_e + b_e, 2) - power(a_px + b_px, 2) - power(a_py + b_py, 2) - power(a_pz + b_pz, 2), 7) AS s,
  round(power(b_e - b_e / 2, 2) - power(b_px / 2, 2) - power(b_py / 2, 2) - power(b_pz / 2, 2), 7) AS t,
  round(power(a_e - b_e / 2, 2) - power(a_px - b_px / 2, 2) - power(a_py - b_py / 2, 2) - power(a_pz - b_pz / 2, 2), 7) AS u FROM ({P4_SQL})""")
def mandelstam(spark, sf_dir):
    frame, _, b = momenta(spark, sf_dir)
    frame = frame.withColumns({f"r_{c}": F.col(f"b_{c}") / 2 for c in ("e", "px", "py", "pz")})
    v = reaction().vertex("v")
    low = Lowered(frame, [v.s(), v.t(), v.u()])
    return low.frame.select(*KEYS, *[F.round(p.re, 7).alias(k) for k, p in zip("stu", low.pairs(), strict=True)])


@query(f"""WITH p AS ({P4_SQL}), t AS (SELECT *, a_e + b_e AS te, a_px + b_px AS tx, a_py + b_py AS ty, a_pz + b_pz AS tz FROM p),
m AS (SELECT *, sqrt(te * te - tx * tx - ty * ty - tz * tz) AS tm FROM t),
k AS (SELECT *, (-(a_px * tx + a_py * ty + a_pz * tz) / tm + (te * a_e) / tm * 0 ) AS unused,
  a_px - tx / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS rx,
  a_py - ty / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS ry,
  a_pz - tz / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS rz FROM m)
SELECT l_orderkey, l_linenumber, round(rz / sqrt(rx * rx + ry * ry + rz * rz), 6) AS costheta, round(atan2(ry, rx), 6) AS phi FROM k""")
def decay_angles(spark, sf_dir):
    """Angles of a in the rest frame of its parent, about z with y as the hint."""
    frame, _, _ = momenta(spark, sf_dir)
    ch = Channel.of([Edge("p"), Edge("a", "a"), Edge("b", "b")], [Vertex("d", ("p",), ("a", "b"))])
    v = ch.vertex("d")
    low = Lowered(frame, [v.costheta("a", Vec3.z_axis()), v.phi("a", Vec3.z_axis(), Vec3.y_axis())])
    return low.frame.select(*KEYS, *[F.round(p.re, 6).alias(k) for k, p in zip(("costheta", "phi"), low.pairs(), strict=True)])


# -- special functions and line shapes ----------------------------------------------------------------------------------

#: A squared mass well above all thresholds used here.
S_SQL = "(1.2 + l_quantity / 25)"
S = 1.2 + QUANTITY / 25.0


@query("""SELECT l_orderkey, l_linenumber, round(-sqrt(15 / (8 * pi())) * sqrt(1 - l_discount * l_discount) * l_discount * cos(l_tax), 8) AS y21_re,
  round(sqrt(15 / (32 * pi())) * (1 - l_discount * l_discount) * cos(2 * l_tax), 8) AS y22_re, round(sqrt(3 / (8 * pi())) * sqrt(1 - l_discount * l_discount) * cos(l_tax), 8) AS y1m1_re,
  round(sqrt(7 / (16 * pi())) * (5 * power(l_discount, 3) - 3 * l_discount), 8) AS y30 FROM lineitem""")
def spherical_harmonics(spark, sf_dir):
    y = lambda l, m: sp.spherical_harmonic(l, m, DISCOUNT, TAX).real()
    return columns(item_frame(spark, sf_dir), KEYS, y21_re=y(2, 1), y22_re=y(2, 2), y1m1_re=y(1, -1), y30=y(3, 0))


@query("""SELECT l_orderkey, l_linenumber, round((1 + cos(l_quantity)) / 2, 8) AS d111, round(-sin(l_quantity) / sqrt(2), 8) AS d110, round(cos(l_quantity / 2), 8) AS dhalf,
  round((3 * power(cos(l_quantity), 2) - 1) / 2, 8) AS d200, round(cos(l_tax + l_discount) * (1 + cos(l_quantity)) / 2, 8) AS big_re FROM lineitem""")
def wigner_d(spark, sf_dir):
    d = lambda j, a, b: sp.WignerD(j, a, b).d(QUANTITY)
    return columns(item_frame(spark, sf_dir), KEYS, d111=d(1, 1, 1), d110=d(1, 1, 0), dhalf=d(0.5, 0.5, 0.5), d200=d(2, 0, 0), big_re=sp.WignerD(1, 1, 1).D(TAX, QUANTITY, DISCOUNT).real())


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem), q AS (SELECT *, sqrt((s - power(0.6, 2)) * (s - power(0.2, 2))) / (2 * sqrt(s)) AS q FROM k),
z AS (SELECT *, q * q / power(0.1973, 2) AS z FROM q)
SELECT l_orderkey, l_linenumber, round(q, 8) AS q, round(2 * q / sqrt(s), 8) AS rho, round(sqrt(2 * z / (z + 1)), 8) AS b1, round(sqrt(13 * z * z / (power(z - 3, 2) + 9 * z)), 8) AS b2,
  round(sqrt(13 * z * z / (power(z - 3, 2) + 9 * z)) / (q * q), 8) AS tensor2, round(sqrt(277 * power(z, 3) / (power(z, 3) + 6 * z * z + 45 * z + 225)), 8) AS b3 FROM z""")
def barriers(spark, sf_dir):
    q = sp.q(S, 0.4, 0.2)
    b = lambda l, kind=sp.FULL: sp.blatt_weisskopf(q, l, kind).real()
    return columns(item_frame(spark, sf_dir), KEYS, q=q.real(), rho=sp.rho(S, 0.4, 0.2).real(), b1=b(1), b2=b(2), tensor2=b(2, sp.TENSOR), b3=b(3))


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem), r AS (SELECT *, sqrt((s - 0.36) * (s - 0.04)) / s AS rho, 1 - 0.36 / s AS chi FROM k)
SELECT l_orderkey, l_linenumber, round((rho * ln(abs((chi + rho) / (chi - rho))) - chi * ((0.2 - 0.4) / 0.6) * ln(0.2 / 0.4)) / pi(), 7) AS loop_re,
  round(CASE WHEN (chi + rho) / (chi - rho) < 0 THEN -rho ELSE 0 END, 7) AS loop_im FROM r""")
def chew_mandelstam(spark, sf_dir):
    c = sp.chew_mandelstam(S, 0.4, 0.2)
    low = Lowered(item_frame(spark, sf_dir), [c])
    p = low.pairs()[0]
    return low.frame.select(*KEYS, F.round(p.re, 7).alias("loop_re"), F.round(p.imag, 7).alias("loop_im"))


@query(f"SELECT l_orderkey, l_linenumber, round(1 / (power(1.8 - {S_SQL}, 2) + power(1.3416407864998738 * 0.2, 2)), 7) AS intensity FROM lineitem")
def breit_wigner_norm_sqr(spark, sf_dir):
    return columns(item_frame(spark, sf_dir), KEYS, 7, intensity=ls.breit_wigner(S, math.sqrt(1.8), 0.2).norm_sqr())


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem), q AS (SELECT *, sqrt((s - 0.36) * (s - 0.04)) / (2 * sqrt(s)) AS q, sqrt((1.69 - 0.36) * (1.69 - 0.04)) / 2.6 AS q0 FROM k),
w AS (SELECT *, 0.2 * (1.3 / sqrt(s)) * (q / q0) * ((2 * (q * q / 0.03892729) / (q * q / 0.03892729 + 1)) / (2 * (q0 * q0 / 0.03892729) / (q0 * q0 / 0.03892729 + 1))) AS w FROM q)
SELECT l_orderkey, l_linenumber, round(1 / (power(1.69 - s, 2) + power(1.3 * w, 2)), 6) AS intensity FROM w""")
def relativistic_breit_wigner(spark, sf_dir):
    return columns(item_frame(spark, sf_dir), KEYS, 6, intensity=ls.relativistic_breit_wigner(S, 1.3, 0.2, 0.4, 0.2, 1).norm_sqr())


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem), r AS (SELECT *, sqrt((s - 0.36) * (s - 0.04)) / s AS rho, 1 - 0.36 / s AS chi FROM k),
c AS (SELECT *, (rho * ln(abs((chi + rho) / (chi - rho))) - chi * ((0.2 - 0.4) / 0.6) * ln(0.2 / 0.4)) / pi() AS cr, CASE WHEN (chi + rho) / (chi - rho) < 0 THEN rho ELSE 0 END AS ci FROM r)
SELECT l_orderkey, l_linenumber, round(power(0.8 * 0.5, 2) / (power(1.69 - s + 0.25 * cr, 2) + power(0.25 * ci, 2)), 6) AS intensity FROM c""")
def k_matrix_one_channel(spark, sf_dir):
    """One channel, one pole: |g beta / (m^2 - s + g^2 C)|^2."""
    b = ls.blatt_weisskopf_barriers(S, [0.4], [0.2], [1.3], 0)
    k = ls.k_matrix(S, [1.3], [[0.5]], b)
    p = ls.p_vector(S, [1.3], [0.8], [[0.5]], b)
    f = ls.f_vector(S, [1.3], k, p, matrix([[sp.chew_mandelstam(S, 0.4, 0.2)]]))
    return columns(item_frame(spark, sf_dir), KEYS, 6, intensity=f[0].norm_sqr())


# -- likelihoods --------------------------------------------------------------------------------------------------------

#: Two interfering parts of unit and slope one, with parameters re, im: |a + (re + i im) b|^2 + background.
DATA, MC = "l_linestatus = 'O'", "l_linestatus = 'F'"
POINT = {"re": 0.7, "im": -0.4}
I_SQL = "(power(1 + 0.7 * l_discount * 10, 2) + power(0.4 * l_discount * 10, 2) + 0.1)"


def intensity() -> Expr:
    c = complex_(parameter("re", 0.7, bounds=(-3, 3)), parameter("im", -0.4, bounds=(-3, 3)))
    one_ = Expr.of(1.0).tagged("flat")
    slope = (c * (10.0 * DISCOUNT)).tagged("slope")
    return (one_ + slope).norm_sqr() + 0.1


def nll_term(spark, sf_dir, kind=NLL) -> NLL:
    return kind(intensity(), items(spark, sf_dir, DATA), items(spark, sf_dir, MC))


NLL_SQL = f"""WITH d AS (SELECT l_quantity AS w, {I_SQL} AS i, l_discount * 10 AS b FROM lineitem WHERE {DATA}), m AS (SELECT l_quantity AS w, {I_SQL} AS i, l_discount * 10 AS b FROM lineitem WHERE {MC}),
D AS (SELECT sum(w) AS w, sum(w * ln(i)) AS l, sum(w * (2 * (1 + 0.7 * b) * b) / i) AS gr, sum(w * (2 * (-0.4) * b * b) / i) AS gi FROM d), N AS (SELECT sum(w * i) AS n, sum(w * 2 * (1 + 0.7 * b) * b) AS gr, sum(w * 2 * (-0.4) * b * b) AS gi FROM m)
"""
NLL_SQL = NLL_SQL.replace("D AS", "ds AS").replace("N AS", "ns AS")


@query(NLL_SQL + "SELECT round(ds.w * ln(ns.n) - ds.l, 2) AS nll, round(ds.w * ns.gr / ns.n - ds.gr, 3) AS d_re, round(ds.w * ns.gi / ns.n - ds.gi, 3) AS d_im FROM ds, ns")
def nll(spark, sf_dir):
    v, g = nll_term(spark, sf_dir).nll_with_gradient(POINT, ["re", "im"])
    return one(spark, nll=round(v, 2), d_re=round(g[0], 3), d_im=round(g[1], 3))


@query(NLL_SQL + "SELECT round(ns.n - ds.l, 2) AS nll, round(ns.gr - ds.gr, 2) AS d_re, round(ns.gi - ds.gi, 2) AS d_im FROM ds, ns")
def extended_nll(spark, sf_dir):
    v, g = nll_term(spark, sf_dir, ExtendedNLL).nll_with_gradient(POINT, ["re", "im"])
    return one(spark, nll=round(v, 2), d_re=round(g[0], 2), d_im=round(g[1], 2))


@query(NLL_SQL + "SELECT round(ds.w * ln(ns.n) - ds.l + 2.0 * (0.49 + 0.16) + 3.0 * (0.7 + 0.4), 2) AS nll, round(ds.w * ns.gr / ns.n - ds.gr + 2.8 + 3, 3) AS d_re, round(ds.w * ns.gi / ns.n - ds.gi - 1.6 - 3, 3) AS d_im FROM ds, ns")
def penalised_likelihood(spark, sf_dir):
    like = Likelihood([nll_term(spark, sf_dir), RidgePenalty(["re", "im"], 2.0), LassoPenalty(["re", "im"], 3.0)])
    v, g = like.value_and_gradient([0.7, -0.4])
    return one(spark, nll=round(v, 2), d_re=round(g[0], 3), d_im=round(g[1], 3))


@query(f"SELECT round(sum(l_quantity * {I_SQL}), 5) AS total, 'statistics' AS strategy FROM lineitem WHERE {MC}")
def normalization_statistics(spark, sf_dir):
    """One pass for the bases' sums; the value then costs no job."""
    n = Normalization(items(spark, sf_dir, MC), intensity())
    return spark.createDataFrame([(round(n.value(POINT)[0], 5), n.strategy)], "total double, strategy string")


@query("""WITH t AS (SELECT * FROM (VALUES (0, 0.7, -0.4), (1, 0.1, 0.2), (2, -0.5, 0.3)) v(draw, re, im)), d AS (SELECT draw, sum(l_quantity * ln(power(1 + re * l_discount * 10, 2) + power(im * l_discount * 10, 2) + 0.1)) AS l, sum(l_quantity) AS w FROM lineitem, t WHERE l_linestatus = 'O' GROUP BY draw),
n AS (SELECT draw, sum(l_quantity * (power(1 + re * l_discount * 10, 2) + power(im * l_discount * 10, 2) + 0.1)) AS n FROM lineitem, t WHERE l_linestatus = 'F' GROUP BY draw) SELECT CAST(draw AS INTEGER) AS draw, round(w * ln(n) - l, 2) AS nll FROM d JOIN n USING (draw)""")
def nll_many_points(spark, sf_dir):
    """Several parameter points in one job."""
    v = nll_term(spark, sf_dir).nll_many([[0.7, -0.4], [0.1, 0.2], [-0.5, 0.3]], ["re", "im"])
    return spark.createDataFrame([(k, round(float(x), 2)) for k, x in enumerate(v)], "draw int, nll double")


@query(f"SELECT round(sum(l_quantity * ln({I_SQL})), 3) AS log_sum, round(sum(l_quantity * {I_SQL}), 5) AS sum FROM lineitem")
def reductions(spark, sf_dir):
    ds = items(spark, sf_dir)
    return one(spark, log_sum=round(reduce(ds, intensity(), LOG, POINT)[0], 3), sum=round(reduce(ds, intensity(), "positive", POINT)[0], 5))


SLOPE_SQL = "(power(0.7 * l_discount * 10, 2) + power(0.4 * l_discount * 10, 2) + 0.1)"


@query(f"""SELECT round(a.i / g.i, 8) AS acceptance, round(d.w * g.i / f.i, 4) AS yield, round(d.w * g.i / f.i / 12.5, 4) AS cross_section FROM
 (SELECT sum(l_quantity * {SLOPE_SQL}) AS i FROM lineitem WHERE {MC}) a, (SELECT sum(l_quantity * {SLOPE_SQL}) AS i FROM lineitem) g,
 (SELECT sum(l_quantity * {I_SQL}) AS i FROM lineitem WHERE {MC}) f, (SELECT sum(l_quantity) AS w FROM lineitem WHERE {DATA}) d""")
def projection_integrals(spark, sf_dir):
    p = Projection(nll_term(spark, sf_dir), items(spark, sf_dir), ("slope",))
    return one(spark, acceptance=round(p.acceptance(POINT), 8), **{"yield": round(p.acceptance_corrected_yield(POINT), 4)}, cross_section=round(p.observed_cross_section(POINT, 12.5), 4))


@query(f"SELECT count(*) AS events, round(sum(l_quantity * {I_SQL} * (SELECT sum(l_quantity) FROM lineitem WHERE {DATA}) / (SELECT sum(l_quantity * {I_SQL}) FROM lineitem WHERE {MC})), 3) AS sum_weights FROM lineitem")
def projection_weights(spark, sf_dir):
    w = Projection(nll_term(spark, sf_dir), items(spark, sf_dir)).weights(POINT)
    return w.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("weight"), 3).alias("sum_weights"))


XS_BIN = "CASE WHEN l_tax >= 0 AND l_tax < 0.025 THEN 0 WHEN l_tax >= 0.025 AND l_tax < 0.055 THEN 1 WHEN l_tax >= 0.055 AND l_tax < 0.085 THEN 2 END"


@query(f"""WITH e AS (SELECT {XS_BIN} AS bin, l_linestatus AS s, l_quantity AS w, {I_SQL} AS i FROM lineitem), b AS (SELECT bin, sum(CASE WHEN s = 'O' THEN w ELSE 0 END) AS d, sum(w * i) AS g, sum(CASE WHEN s = 'F' THEN w * i ELSE 0 END) AS a FROM e WHERE bin IS NOT NULL GROUP BY bin),
t AS (SELECT sum(CASE WHEN s = 'O' THEN w ELSE 0 END) AS d, sum(CASE WHEN s = 'F' THEN w * i ELSE 0 END) AS a FROM e)
SELECT bin, round(b.d * b.g / b.a / (20 * v), 3) AS data, round(t.d * b.g / t.a / (20 * v), 3) AS model FROM (SELECT *, CASE bin WHEN 0 THEN 0.025 ELSE 0.03 END AS v FROM b) b, t""")
def differential_cross_section(spark, sf_dir):
    x = CrossSection(nll_term(spark, sf_dir), items(spark, sf_dir), 20.0, POINT)
    d = x.differential([Axis(TAX, (0.0, 0.025, 0.055, 0.085))])
    rows = [(k, round(float(a), 3), round(float(b), 3)) for k, (a, b) in enumerate(zip(d.data.central, d.model.central, strict=True))]
    return spark.createDataFrame(rows, "bin int, data double, model double")


@query("""SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(l_quantity), 3) AS sum_weights FROM (SELECT l_quantity, CASE WHEN l_tax < 0.045 THEN 0 ELSE 1 END AS i, CASE WHEN l_discount < 0.025 THEN 0 WHEN l_discount < 0.055 THEN 1 ELSE 2 END AS j FROM lineitem WHERE l_tax < 0.085 AND l_discount < 0.105) GROUP BY i, j""")
def histogram_two_axes(spark, sf_dir):
    h = binned_sums(items(spark, sf_dir), [Axis(TAX, (0.0, 0.045, 0.085)), Axis(DISCOUNT, (0.0, 0.025, 0.055, 0.105))])[0]
    rows = [(i, j, round(float(h[i, j]), 3)) for i in range(2) for j in range(3)]
    return spark.createDataFrame(rows, "i int, j int, sum_weights double")


@query(f"""WITH e AS (SELECT {XS_BIN} AS bin, l_linestatus AS s, l_quantity AS w, {I_SQL} AS i FROM lineitem), b AS (SELECT bin, sum(CASE WHEN s = 'O' THEN w ELSE 0 END) AS d, sum(w * i) AS g, sum(CASE WHEN s = 'F' THEN w * i ELSE 0 END) AS a FROM e WHERE bin IS NOT NULL GROUP BY bin)
SELECT bin, round(2 * d / (18 * a / g + 25 * 0.9 * a / g) / CASE bin WHEN 0 THEN 0.025 ELSE 0.03 END, 3) AS pooled FROM b""")
def pooled_cross_section(spark, sf_dir):
    parts = [CrossSection(nll_term(spark, sf_dir), items(spark, sf_dir), lum, POINT) for lum in (18.0, 25.0)]
    v = combine(parts, [Axis(TAX, (0.0, 0.025, 0.055, 0.085))], [1.0, 0.9])
    return spark.createDataFrame([(k, round(float(x), 3)) for k, x in enumerate(v)], "bin int, pooled double")


@query("""WITH d AS (SELECT avg(value) AS x FROM events GROUP BY event_id % 200)
SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.16), 6) AS low, round(quantile_cont(x, 0.84), 6) AS high FROM d""")
def estimate_summary(spark, sf_dir):
    """An estimate whose draws are the means of 200 groups, which share out all events by id."""
    means = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id % 200").alias("k")).agg(F.avg("value").alias("x")).orderBy("k").collect()
    e = Estimate(0.0, np.array([r.x for r in means]))
    return one(spark, mean=round(e.mean(), 6), std=round(e.std(), 6), median=round(e.median(), 6), low=round(e.quantile(0.16), 6), high=round(e.quantile(0.84), 6))


@query("""SELECT event_id, round(power(value / 100 * 0.5 + 1, 2) + 0.09 * power(value / 100, 2), 10) AS value, round(2 * (value / 100 * 0.5 + 1) * value / 100, 10) AS d_re, round(0.6 * power(value / 100, 2), 10) AS d_im FROM events""")
def model_gradient(spark, sf_dir):
    """A model's value and derivatives for every event, in one projection."""
    from .model import Model

    m = Model((1.0 + complex_(parameter("re", 0.5), parameter("im", 0.3)) * (VALUE / 100.0)).norm_sqr())
    return m.evaluate_with_gradient(clicks(spark, sf_dir)).select(F.col(ID).alias("event_id"), *[F.round(c, 10).alias(c) for c in ("value", "d_re", "d_im")])


@query("SELECT round(covar_samp(l_discount, l_discount), 10) AS dd, round(covar_samp(l_discount, l_tax), 10) AS dt, round(covar_samp(l_tax, l_tax), 10) AS tt FROM lineitem")
def covariance(spark, sf_dir):
    from .model import covariance as cov

    c = cov(item_frame(spark, sf_dir), ["discount", "tax"])
    return one(spark, dd=round(c[0, 0], 10), dt=round(c[0, 1], 10), tt=round(c[1, 1], 10))


@query(f"SELECT round(sum(l_quantity * ln({I_SQL})), 3) AS log_sum FROM lineitem")
def cached_reduction(spark, sf_dir):
    """The same sum over columns that hold the model's parameter-free parts."""
    from .model import Model

    ds, m = Model(intensity()).cached(items(spark, sf_dir))
    out = one(spark, log_sum=round(m.value_and_gradient(ds, POINT, LOG)[0], 3))
    ds.streaming()
    return out


@query("SELECT count(*) AS events, coalesce(sum(value), 0.0) AS total, coalesce(sum(1 + event_id % 3), 0.0) AS sum_weights FROM events WHERE value < -1")
def empty_selection(spark, sf_dir):
    """A selection without events reduces to zero, not to an error."""
    ds = clicks(spark, sf_dir).select(VALUE < -1.0)
    events, weights = ds.stats()
    return spark.createDataFrame([(events, ds.weighted_sum(VALUE), weights)], "events long, total double, sum_weights double")


from . import queries_more  # noqa: E402, F401  its queries join these
