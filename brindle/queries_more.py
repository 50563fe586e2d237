"""More registered queries: public operators that the first module has no query for, each with the SQL that gives its rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .dataset import ID, Dataset
from .functions import lineshape as ls
from .functions import quantum as qn
from .functions import special as sp
from .functions.channel import Channel, Edge, Vertex
from .functions.vectors import RealVec3, RealVec4, Vec3, Vec4
from .operators import generate as gen
from .operators.binning import Bins
from .operators.cross_section import Axis, CrossSection, Ensemble, combined_total
from .operators.draws import FrameEnsemble
from .operators.fit import bootstrap_fit, fit, fit_restarts
from .operators.histogram import Histogram
from .operators.likelihood import NLL, CustomTerm, ExtendedNLL, Likelihood, Projection
from .operators.reduce import weighted_sums
from .plans.expr import Expr, ShapeError, cis, complex_, matmul, matrix, parameter, scalar, solve, vector
from .plans.lower import Lowered
from .queries import DATA, DISCOUNT, I_SQL, KEYS, MC, NLL_SQL, P4_SQL, POINT, PRICE, QUANTITY, S_SQL, SLOPE_SQL, TAX, VALUE, XS_BIN, S, _poisson_sql, _uniform_sql, clicks, columns, intensity, item_frame, items, momenta, nll_term, one, query
from .schema import EventSchema
from .sources.contract import EventSource, FragmentedSource, fragments
from .sources.memory import BatchBuilder, BatchSource, MemorySink, MemorySource
from .sources.parquet import ParquetSink, ParquetSource, read_frame, read_parquet, scratch
from .sql import Steps, values


def table(spark, schema: str, rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def floats(frame, digits: int, *keys: str):
    """All other columns rounded."""
    return frame.select(*keys, *[F.round(F.col(f"`{c}`"), digits).alias(c) for c in frame.columns if c not in keys])


# -- sources and sinks --------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS events, round(sum(l_quantity * l_extendedprice), 0) AS total FROM lineitem WHERE l_tax > 0.02 AND l_discount < 0.05")
def parquet_checked_for_nulls(spark, sf_dir):
    """The default: a null is an error. The source's own condition reaches the scan."""
    cols = {"price": "l_extendedprice", "discount": "l_discount", "weight": "l_quantity"}
    ds = read_parquet(spark, f"{sf_dir}/lineitem*.parquet", rename=cols, where="l_tax > 0.02").select(DISCOUNT < 0.05)
    return table(spark, "events long, total double", [(ds.num_events(), round(ds.weighted_sum(PRICE), 0))])


@query("SELECT count(*) AS events, round(sum(l_quantity), 3) AS sum_weights, sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS gone FROM lineitem WHERE l_discount = 0 OR l_discount >= 0.05")
def parquet_nulls_as_nan(spark, sf_dir):
    """A null that is read as NaN fails every comparison, and passes its negation."""
    cols = {"x": "nullif(l_discount, 0)", "weight": "l_quantity"}
    ds = read_parquet(spark, f"{sf_dir}/lineitem.parquet", rename=cols, nulls="nan").select(~(scalar("x") < 0.05))
    return ds.frame.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("weight"), 3).alias("sum_weights"), F.sum(F.isnan("x").cast("long")).alias("gone"))


@query("SELECT event_id, value, CAST(1 + event_id % 3 AS DOUBLE) AS weight FROM events")
def parquet_round_trip(spark, sf_dir):
    """Written by a sink in parts of four tasks, and read again in the order of the files."""
    path = scratch(spark, "round-trip")
    ds = clicks(spark, sf_dir)
    spread = Dataset(ds.frame.repartitionByRange(4, ID).sortWithinPartitions(ID), ds.schema)
    ParquetSink(path, mode="overwrite").write(spread)
    return ParquetSource(path).load(spark).frame.select(F.col(ID).alias("event_id"), "value", "weight")


def _batches(rank: int, ranks: int):
    for k in range(5):
        x = np.arange(k * 40, k * 40 + 40) + 200.0 * rank
        yield {"scalars": {"x": x / 8}, "p4s": {"p": np.column_stack([x + 1, 0 * x, x / 4, x / 2])}, "weights": 1 + x % 3}


@query("SELECT k AS event_id, k / 8.0 AS x, round(sqrt(power(k + 1, 2) - power(k / 4.0, 2) - power(k / 2.0, 2)), 9) AS mass, 1.0 + k % 3 AS weight FROM (SELECT CAST(range AS DOUBLE) AS v, range AS k FROM range(800))")
def batch_source(spark, sf_dir):
    """Batches from a user's factory, which four tasks call; ids follow the ranks."""
    schema = EventSchema(("p",), ("x",), True)
    ds = BatchSource(_batches, schema, 4).load(spark).with_ids()
    low = Lowered(ds.frame, [Vec4.event("p").m()])
    return low.frame.select(F.col(ID).alias("event_id"), "x", F.round(low.pairs()[0].re, 9).alias("mass"), "weight")


@query("SELECT count(*) AS events, round(sum((1 + k % 4) * k * k / 4.0), 6) AS total, round(sum(1.0 + k % 4), 3) AS sum_weights FROM (SELECT range AS k FROM range(1000)) UNION ALL SELECT 3, 1 * 2 + 2 * 4.5 + 0.5 * 8, 3.5")
def memory_events(spark, sf_dir):
    """Arrays kept by a sink, and events pushed one by one."""
    k = np.arange(1000)
    sink = MemorySink()
    sink.write(MemorySource(scalars={"x": k / 2}, weights=1.0 + k % 4).load(spark))
    builder = BatchBuilder(EventSchema((), ("x",), True))
    for x, w in ((2, 1), (4.5, 2), (8, 0.5)):
        builder.push({"x": x}, w)
    out = []
    for ds, f in ((sink.dataset, scalar("x") ** 2), (builder.finish(spark), scalar("x"))):
        out.append((ds.num_events(), round(ds.weighted_sum(f), 6), round(ds.sum_weights(), 3)))
    sink.dataset.streaming()
    return table(spark, "events long, total double, sum_weights double", out)


@query(f"SELECT * FROM {values(('batches', False, False, True, False, True, False), ('memory', True, True, True, True, True, True), ('parquet', True, True, True, True, True, True))} v(source, known_length, fragments, rereadable, projection, is_source, is_fragmented)")
def source_capabilities(spark, sf_dir):
    schema = EventSchema((), ("x",), False)
    sources = {"batches": BatchSource(_batches, schema), "memory": MemorySource(scalars={"x": [1.0]}), "parquet": ParquetSource(f"{sf_dir}/lineitem.parquet")}
    rows = [(k, c.known_length, c.fragments, c.rereadable, c.projection, isinstance(s, EventSource), isinstance(s, FragmentedSource)) for k, s in sources.items() for c in [s.capabilities()]]
    return table(spark, "source string, known_length boolean, fragments boolean, rereadable boolean, projection boolean, is_source boolean, is_fragmented boolean", rows)


@query("WITH k AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT i, n * i // 3 AS a, n * (i + 1) // 3 AS b FROM k, (SELECT range AS i FROM range(3))) SELECT CAST(i AS INTEGER) AS fragment, b - a AS events FROM p")
def source_fragments(spark, sf_dir):
    """Three fragments share out a source."""
    source = ParquetSource(f"{sf_dir}/lineitem.parquet", rename={"x": "l_tax"}, nulls="trust")
    return table(spark, "fragment int, events long", [(i, d.num_events()) for i, d in enumerate(fragments(source, spark, 3))])


# -- dataset operators ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS by_column, count(*) AS by_function, round(sum(value), 4) AS total FROM events WHERE value * value > 2500")
def filters(spark, sf_dir):
    ds = clicks(spark, sf_dir)
    a, b = ds.filter(F.col("value") ** 2 > 2500), ds.filter(lambda f: f["value"] ** 2 > 2500)
    return table(spark, "by_column long, by_function long, total double", [(a.num_events(), b.num_events(), round(b.frame.agg(F.sum("value")).first()[0], 4))])


def nations(spark, sf_dir):
    """The nations as events: key and region, weighted by the region's number and one."""
    return read_frame(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", key="n_nationkey", region="n_regionkey", weight="n_regionkey + 1")


@query("""SELECT CAST(sum(n_nationkey * n_nationkey) AS DOUBLE) AS mapped, CAST(sum(n_nationkey) AS DOUBLE) AS folded, CAST(count(*) AS DOUBLE) AS accumulated,
  CAST(sum((n_regionkey + 1) * n_nationkey) AS DOUBLE) AS visited, CAST(count(*) AS DOUBLE) AS batched, CAST(1 + 3 + 7 AS DOUBLE) AS picked, CAST(sum(n_regionkey + 1) AS DOUBLE) AS weights FROM nation""")
def ordered_traversals(spark, sf_dir):
    """What walks over events in order, on the driver, and what visits them where they are."""
    ds = nations(spark, sf_dir)
    total = spark.sparkContext.accumulator(0.0)
    ds.for_each_event(lambda r: total.add(r["weight"] * r["key"]))
    count = spark.sparkContext.accumulator(0)
    ds.for_each_batch(lambda rows: count.add(sum(1 for _ in rows)))
    seen: list[float] = []
    ds.accumulate_events(seen, lambda s, r: s.append(r["key"]))
    assert seen == sorted(seen) and [b.key.iloc[0] for b in ds.batches()] == seen[:1]
    return one(
        spark,
        mapped=sum(ds.map_events(lambda r: r["key"] ** 2)),
        folded=ds.fold_events(0.0, lambda s, r: s + r["key"]),
        accumulated=len(seen),
        visited=total.value,
        batched=count.value,
        picked=ds.rows([1, 3, 7]).frame.agg(F.sum("key")).first()[0],
        weights=float(ds.weights().sum()),
    )


@query("SELECT event_id, round(value / (1 + value), 9) AS share FROM events")
def mapped_batches(spark, sf_dir):
    """A pandas function over batches of at most 1000 rows."""

    def share(b):
        assert len(b) <= 1000
        return b.assign(share=(b["value"] / (1 + b["value"])).round(9))[[ID, "share"]]

    return clicks(spark, sf_dir).chunked(1000).map_batches(share, f"{ID} long, share double").withColumnRenamed(ID, "event_id")


@query("SELECT event_id, round(value * cos(value / 100), 7) AS re, round(value * sin(value / 100), 7) AS im FROM events")
def evaluated_expression(spark, sf_dir):
    frame = clicks(spark, sf_dir).evaluate_frame(VALUE * cis(VALUE / 100.0))
    return floats(frame.withColumnRenamed(ID, "event_id"), 7, "event_id")


@query("SELECT n_nationkey AS key, CAST(n_nationkey * (n_regionkey + 2) AS DOUBLE) AS value, CAST(n_regionkey AS DOUBLE) AS im FROM nation")
def values_in_order(spark, sf_dir):
    """Complex and real values of every event, in order, on the driver."""
    ds, key, region = nations(spark, sf_dir), scalar("key"), scalar("region")
    z = ds.evaluate(complex_(key, region))
    x = ds.evaluate_real(key * (region + 2.0))
    return table(spark, "key long, value double, im double", [(int(a.real), float(b), float(a.imag)) for a, b in zip(z, x, strict=True)])


@query("""SELECT CAST(least(floor(value / 12.5), 39) AS INTEGER) AS bin, count(*) AS events, round(sum(1 + event_id % 3), 3) AS sum_weights FROM events WHERE value >= 0 AND value <= 500 GROUP BY 1""")
def uniform_bins(spark, sf_dir):
    """Forty even bins, by arithmetic; the last edge belongs to the last bin."""
    binned = clicks(spark, sf_dir).bin_by(VALUE, Bins.uniform(40, 0.0, 500.0))
    return binned.stats().withColumn("sum_weights", F.round("sum_weights", 3))


@query("SELECT round(sum(CAST((1 + event_id % 3) AS DECIMAL(38, 12)) * CAST(value AS DECIMAL(38, 12))), 4)::DOUBLE AS total FROM events")
def accurate_sum(spark, sf_dir):
    """A sum that is rounded once, whatever the order of its terms."""
    return one(spark, total=round(clicks(spark, sf_dir).weighted_sum(VALUE, accurate=True), 4))


# -- expressions ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_tax + l_discount + l_quantity + 2 * l_tax + 1.5 + l_discount * l_discount, 8) AS total, round(l_quantity * (1 + l_tax) * (2 - l_discount) * 0.5 * (1 + l_tax), 8) AS product FROM lineitem")
def flattened_terms(spark, sf_dir):
    """Sums and products of many terms."""
    total = TAX + (DISCOUNT + (QUANTITY + (2.0 * TAX + 1.5))) + DISCOUNT * DISCOUNT
    product = QUANTITY * (1.0 + TAX) * ((2.0 - DISCOUNT) * (0.5 * (1.0 + TAX)))
    return columns(item_frame(spark, sf_dir), KEYS, total=total, product=product)


@query(f"SELECT * FROM {values(('add', True), ('index', True), ('matmul', True), ('scalar', False), ('solve', True))} v(case_, fails)")
def shape_errors(spark, sf_dir):
    v, m = vector([TAX, DISCOUNT]), matrix([[TAX, 1.0], [0.0, 1.0]])
    cases = {"add": lambda: v + vector([1.0, 2.0, 3.0]), "index": lambda: v[2], "matmul": lambda: matmul(m, matrix([[1.0, 2.0]])), "scalar": lambda: TAX + DISCOUNT, "solve": lambda: solve(m, vector([1.0]))}
    rows = []
    for k, f in cases.items():
        try:
            f()
            rows.append((k, False))
        except (ShapeError, IndexError, ValueError):
            rows.append((k, True))
    return table(spark, "case_ string, fails boolean", rows)


@query(NLL_SQL + "SELECT round(ds.w * ln(ns.n) - ds.l, 2) AS nll, round(ds.w * ns.gi / ns.n - ds.gi, 3) AS d_im, 'im' AS free, 're,im' AS freed FROM ds, ns")
def fixed_parameters(spark, sf_dir):
    """One parameter held, in a model that went to JSON and back; freed again it is a parameter as before."""
    model = Expr.from_json(intensity().to_json()).fix(re=0.7)
    term = NLL(model, items(spark, sf_dir, DATA), items(spark, sf_dir, MC))
    like = Likelihood([term])
    v, g = like.value_and_gradient([-0.4])
    freed = [p.name for p in model.free("re").parameters() if not p.fixed]
    return table(spark, "nll double, d_im double, free string, freed string", [(round(v, 2), round(float(g[0]), 3), ",".join(like.parameter_names()), ",".join(freed))])


# -- kinematics -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, round(sqrt(a_px * a_px + a_py * a_py + a_pz * a_pz + 0.81), 7) AS energy, round(sqrt(9 * (a_e * a_e + 1) - a_px * a_px - a_py * a_py - a_pz * a_pz), 7) AS mass,
  round(a_px / sqrt(a_px * a_px + a_py * a_py + a_pz * a_pz), 7) AS direction FROM ({P4_SQL})""")
def mass_and_energy_shells(spark, sf_dir):
    frame, a, _ = momenta(spark, sf_dir)
    p = a.vec3()
    return columns(frame, KEYS, 7, energy=p.with_mass(0.9).e, mass=p.with_energy(3.0 * (a.e**2 + 1.0).sqrt()).m(), direction=p.unit().px)


@query(f"""WITH p AS ({P4_SQL}), t AS (SELECT *, a_e + b_e AS te, a_px + b_px AS tx, a_py + b_py AS ty, a_pz + b_pz AS tz FROM p),
m AS (SELECT *, sqrt(te * te - tx * tx - ty * ty - tz * tz) AS tm FROM t), k AS (SELECT *,
  a_px - tx / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS rx, a_py - ty / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS ry,
  a_pz - tz / tm * (a_e - (a_px * tx + a_py * ty + a_pz * tz) / (te + tm)) AS rz FROM m)
SELECT l_orderkey, l_linenumber, round(tm, 6) AS mass, round(tm * tm, 5) AS s, round(te, 6) AS energy, round(tx, 6) AS px, round(acos(rz / sqrt(rx * rx + ry * ry + rz * rz)), 6) AS theta FROM k""")
def channel_edges(spark, sf_dir):
    """An unmeasured parent: its momentum, mass and squared mass, and the polar angle of a daughter in its rest frame."""
    frame, _, _ = momenta(spark, sf_dir)
    ch = Channel.of([Edge("p"), Edge("a", "a"), Edge("b", "b")], [Vertex("d", ("p",), ("a", "b"))])
    low = Lowered(frame, [ch.mass("p"), ch.s("p"), ch.p4("p").e, ch.vec3("p").px, ch.vertex("d").theta("a", Vec3.z_axis())])
    cells = zip(("mass", "s", "energy", "px", "theta"), low.pairs(), (6, 5, 6, 6, 6), strict=True)
    return low.frame.select(*KEYS, *[F.round(p.re, d).alias(k) for k, p, d in cells])


@query("""SELECT k AS key, round(sqrt(power(k + 3.0, 2) - power(k / 4.0, 2) - 1 - k), 9) AS mass, round((k + 3.0) / sqrt(power(k + 3.0, 2) - power(k / 4.0, 2) - 1 - k), 9) AS gamma,
  round(sqrt(power(k / 4.0, 2) + 1 + k), 9) AS momentum, round(k / 4.0 * 2 - 3 * sqrt(k), 9) AS dot, round(sqrt(power(k / 4.0, 2) + 1 + k + 0.49), 9) AS energy, round(-1.0, 9) AS cross_x, round(sqrt(power(k + 3.0, 2) - power(k / 4.0, 2) - 1 - k), 7) AS rest FROM (SELECT n_nationkey AS k FROM nation)""")
def numeric_vectors(spark, sf_dir):
    """Vectors of numbers, one a nation."""
    rows = []
    for (k,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
        v = RealVec4(k + 3.0, k / 4, 1.0, math.sqrt(k))
        p = v.vec3()
        cross = p.cross(RealVec3(1.0, 0.0, 0.0) * 0.0 + RealVec3(0.0, 0.0, -1.0))
        rest = v.boost(v.beta() * -1.0)
        rows.append((k, round(v.m(), 9), round(v.gamma(), 9), round(p.mag(), 9), round(p.dot(RealVec3(2.0, 0.0, -3.0)), 9), round(p.with_mass(0.7).e, 9), round(cross.x, 9), round(rest.e, 7)))
    return table(spark, "key long, mass double, gamma double, momentum double, dot double, energy double, cross_x double, rest double", rows)


# -- special functions and line shapes ------------------------------------------------------------------------------------


def _barrier_sql(l: int, z: str = "z") -> str:
    bottom = "1.0"
    for c in sp.BARRIER[l][1:]:
        bottom = f"({bottom} * {z} + {float(c)!r})"
    return f"sqrt({float(sp.BARRIER_TOP[l])!r} * pow({z}, {l}) / {bottom})"


_Q = f"WITH k AS (SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem), q AS (SELECT *, sqrt((s - 0.36) * (s - 0.04)) / (2 * sqrt(s)) AS q FROM k), z AS (SELECT *, q * q / power(0.1973, 2) AS z FROM q)\n"


@query(_Q + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_barrier_sql(l)}, 7) AS b{l}" for l in range(4, 9)) + " FROM z")
def high_barriers(spark, sf_dir):
    q = sp.q(S, 0.4, 0.2)
    return columns(item_frame(spark, sf_dir), KEYS, 7, **{f"b{l}": sp.blatt_weisskopf(q, l).real() for l in range(4, 9)})


_Z0 = (1.69 - 0.36) * (1.69 - 0.04) / (4 * 1.69) / 0.1973**2


@query(_Q + f"SELECT l_orderkey, l_linenumber, round(sqrt(2 * z / (z + 1)) / {math.sqrt(2 * _Z0 / (_Z0 + 1))!r}, 7) AS p_wave, round({_barrier_sql(2)} / {math.sqrt(13 * _Z0**2 / (_Z0**2 + 3 * _Z0 + 9))!r}, 7) AS d_wave FROM z")
def barrier_matrix(spark, sf_dir):
    b = lambda l: ls.blatt_weisskopf_barriers(S, [0.4], [0.2], [1.3], l)[0, 0].real()
    return columns(item_frame(spark, sf_dir), KEYS, 7, p_wave=b(1), d_wave=b(2))


_CG = [
    ("cg", 0.5, 0.5, 0.5, -0.5, 1.0, 0.0, math.sqrt(1 / 2)),
    ("cg", 0.5, -0.5, 0.5, 0.5, 0.0, 0.0, -math.sqrt(1 / 2)),
    ("cg", 1.0, 1.0, 0.5, -0.5, 1.5, 0.5, math.sqrt(1 / 3)),
    ("cg", 1.0, 0.0, 0.5, 0.5, 0.5, 0.5, -math.sqrt(1 / 3)),
    ("cg", 1.0, 1.0, 1.0, -1.0, 2.0, 0.0, math.sqrt(1 / 6)),
    ("cg", 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, -math.sqrt(1 / 3)),
    ("cg", 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.0),
    ("cg", 2.0, 1.0, 1.0, 0.0, 2.0, 1.0, math.sqrt(1 / 6)),
    ("3j", 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, -math.sqrt(1 / 3)),
    ("3j", 1.0, 1.0, 2.0, 0.0, 0.0, 0.0, math.sqrt(2 / 15)),
    ("3j", 2.0, 2.0, 0.0, 1.0, -1.0, 0.0, -math.sqrt(1 / 5)),
    ("3j", 0.5, 0.5, 1.0, 0.5, 0.5, -1.0, -math.sqrt(1 / 3)),
]


@query(f"SELECT kind, a, b, c, d, e, f, round(value, 12) AS value FROM {values(*_CG)} v(kind, a, b, c, d, e, f, value)")
def coupling_coefficients(spark, sf_dir):
    """Clebsch-Gordan coefficients <j1 m1 j2 m2 | j m>, and 3j symbols (j1 j2 j3; m1 m2 m3), against published ones."""
    call = {"cg": sp.clebsch_gordan, "3j": sp.wigner_3j}
    return table(spark, "kind string, a double, b double, c double, d double, e double, f double, value double", [(k, *x, round(call[k](*x), 12)) for k, *x, _ in _CG])


def _background_sql() -> str:
    s = Steps(f"SELECT l_orderkey, l_linenumber, {S_SQL} AS s FROM lineitem").loop("c", "s", 0.4, 0.2)
    s.add(gap="1.69 - s").add(k="0.25 + 0.3 * gap", p="0.8 * 0.5 + 0.15 * gap")
    return s.select("l_orderkey, l_linenumber, round(p * p / (power(gap + k * c_re, 2) + power(k * c_im, 2)), 6) AS intensity FROM _")


@query(_background_sql())
def k_matrix_with_background(spark, sf_dir):
    """One channel and pole with constant parts beside it: K = g^2 / (m^2 - s) + 0.3, P = g beta / (m^2 - s) + 0.15."""
    b = ls.blatt_weisskopf_barriers(S, [0.4], [0.2], [1.3], 0)
    k = ls.k_matrix(S, [1.3], [[0.5]], b, [[0.3]])
    p = ls.p_vector(S, [1.3], [0.8], [[0.5]], b, [0.15])
    f = ls.f_vector(S, [1.3], k, p, matrix([[sp.chew_mandelstam(S, 0.4, 0.2)]]))
    return columns(item_frame(spark, sf_dir), KEYS, 6, intensity=f[0].norm_sqr())


def _coupled_sql(r: ls.Resonances, production: list[complex]) -> str:
    """The summed intensities of a coupled-channel amplitude, by elimination."""
    n, m = len(r.channels), len(r.poles)
    s = Steps(f"SELECT l_quantity AS w, {S_SQL} AS s FROM lineitem")
    s.add(**{f"gap{k}": f"{r.poles[k] ** 2!r} - s" for k in range(m)})
    gap = " * ".join(f"gap{k}" for k in range(m))
    s.add(every=gap, adler="1.0" if not r.adler else f"(s - {r.adler[0]!r}) / {r.adler[1]!r}", **{f"but{k}": " * ".join(["1.0", *(f"gap{j}" for j in range(m) if j != k)]) for k in range(m)})
    for i, (a, b) in enumerate(r.masses):
        s.loop(f"c{i}", "s", a, b)
        # the squared barrier's numerator and denominator may both be negative below threshold; their root then is imaginary twice
        s.add(**{f"z{i}": f"c{i}_l / (4 * s) / {sp.Q_R**2!r}"})
    for i, (a, b) in enumerate(r.masses):
        cells = {}
        for k, pole in enumerate(r.poles):
            s0 = pole**2
            z0 = (s0 - (a + b) ** 2) * (s0 - (a - b) ** 2) / (4 * s0) / sp.Q_R**2
            square = lambda z: f"{float(sp.BARRIER_TOP[r.l])!r} * pow({z}, {r.l}) / ({_bottom(r.l, z)})" if r.l else "1.0"
            cells |= {f"b{i}_{k}s": f"({square(f'z{i}')}) / ({square(f'({z0!r})')})"}
        s.add(**cells)
        # a barrier is a root: real where its square is positive, else imaginary
        s.add(**{f"b{i}_{k}r": f"CASE WHEN b{i}_{k}s >= 0 THEN sqrt(b{i}_{k}s) ELSE 0 END" for k in range(m)}, **{f"b{i}_{k}i": f"CASE WHEN b{i}_{k}s < 0 THEN sqrt(-b{i}_{k}s) ELSE 0 END" for k in range(m)})
    for i in range(n):
        cells = {}
        for j in range(n):
            re, im = [], []
            for k in range(m):
                re.append(f"(b{i}_{k}r * b{j}_{k}r - b{i}_{k}i * b{j}_{k}i) * ({r.couplings[i][k] * r.couplings[j][k]!r} * but{k} + {r.background[i][j]!r} * every)")
                im.append(f"(b{i}_{k}r * b{j}_{k}i + b{i}_{k}i * b{j}_{k}r) * ({r.couplings[i][k] * r.couplings[j][k]!r} * but{k} + {r.background[i][j]!r} * every)")
            cells |= {f"k{i}_{j}r": f"adler * ({' + '.join(re)})", f"k{i}_{j}i": f"adler * ({' + '.join(im)})"}
        p = [(complex(production[k]) * r.couplings[i][k], k) for k in range(m)]
        cells |= {f"p{i}r": " + ".join(f"but{k} * ({z.real!r} * b{i}_{k}r - {z.imag!r} * b{i}_{k}i)" for z, k in p), f"p{i}i": " + ".join(f"but{k} * ({z.real!r} * b{i}_{k}i + {z.imag!r} * b{i}_{k}r)" for z, k in p)}
        s.add(**cells)
    s.add(**{f"a{i}_{j}r": f"k{i}_{j}r * c{j}_re - k{i}_{j}i * c{j}_im" + (" + every" if i == j else "") for i in range(n) for j in range(n)}, **{f"a{i}_{j}i": f"k{i}_{j}r * c{j}_im + k{i}_{j}i * c{j}_re" for i in range(n) for j in range(n)})
    s.solve([[(f"a{i}_{j}r", f"a{i}_{j}i") for j in range(n)] for i in range(n)], [(f"p{i}r", f"p{i}i") for i in range(n)], "f")
    sums = ", ".join(f"round(sum(w * (f{i}_re * f{i}_re + f{i}_im * f{i}_im)), 3) AS channel_{i}" for i in range(n))
    return s.select(f"{sums} FROM _")


def _bottom(l: int, z: str) -> str:
    out = "1.0"
    for c in sp.BARRIER[l][1:]:
        out = f"({out} * {z} + {float(c)!r})"
    return out


PRODUCTION = [1.0, 0.5, complex(math.cos(0.3), math.sin(0.3)), 0.2, 0.1]


def _coupled(name: str, r: ls.Resonances):
    production = PRODUCTION[: len(r.poles)]

    def run(spark, sf_dir):
        f = r.amplitude(S, production)
        sums = weighted_sums(items(spark, sf_dir), [f[k].norm_sqr() for k in range(len(r.channels))])
        return one(spark, **{f"channel_{k}": round(s.real, 3) for k, s in enumerate(sums)})

    run.__name__ = name
    run.__doc__ = "The sums over events of a coupled-channel amplitude's intensities."
    return query(_coupled_sql(r, production))(run)


k_matrix_five_channels = _coupled("k_matrix_five_channels", ls.F0)
for _name, _r in (("f2", ls.F2), ("a0", ls.A0), ("a2", ls.A2), ("rho", ls.RHO), ("pi1", ls.PI1)):
    _coupled(f"coupled_channels_{_name}", _r)


# -- quantum numbers --------------------------------------------------------------------------------------------------------

# Some particles' figures, as reviews list them.
_SOME = [
    ("gamma", 0.0, 2, None, 22), ("Z0", 91.188, 2, None, 23), ("H", 125.2, 0, None, 25), ("tau-", 1.77693, 1, -1, 15), ("nubar_mu", None, 1, 0, -14), ("K_S0", 0.497611, 0, None, 310),
    ("D_s+", 1.96835, 0, 1, 431), ("B_s0_bar", 5.36693, 0, 0, -531), ("p_bar", 0.93827208816, 1, -1, -2212), ("Sigma-_bar", 1.18937, 1, -1, -3222), ("Omega+_bar", 1.67245, 3, 1, -3334),
]


@query(f"SELECT name, mass, CAST(twice_spin AS INTEGER) AS twice_spin, CAST(charge AS INTEGER) AS charge, CAST(pdg AS INTEGER) AS pdg, 64 AS known, 0 AS charges, 0 AS baryons FROM {values(*_SOME)} v(name, mass, twice_spin, charge, pdg)")
def particles(spark, sf_dir):
    """Figures of some of the 64 known particles; the additive numbers of all cancel."""
    p = qn.PARTICLES
    total = lambda k: sum(getattr(x, k) or 0 for x in p.values() if not x.self_conjugate)
    rows = [(n, p[n].mass, int(2 * p[n].spin), p[n].charge, dict(p[n].ids)["pdg"], len(p), total("charge"), total("baryon_number")) for n, *_ in _SOME]
    return table(spark, "name string, mass double, twice_spin int, charge int, pdg int, known int, charges int, baryons int", rows)


_RHO = qn.PARTICLES["rho+"].patched(strangeness=0, charm=0, bottomness=0, topness=0)
#: Decays whose rules' outcomes are known: (name, parent, a, b, L, S).
DECAYS = [
    ("rho to pi pi", _RHO, qn.PARTICLES["pi+"], qn.PARTICLES["pi0"], 1, 0),
    ("K to K K", qn.PARTICLES["K0"], qn.PARTICLES["K+"], qn.PARTICLES["K+"], 0, 0),
    ("Lambda to p pi", qn.PARTICLES["Lambda0"], qn.PARTICLES["p"], qn.PARTICLES["pi-"], 0, 0.5),
    ("psi to p p", qn.PARTICLES["J/psi"], qn.PARTICLES["p"], qn.PARTICLES["p_bar"], 0, 1),
    ("mu to e nu", qn.PARTICLES["mu-"], qn.PARTICLES["e-"], qn.PARTICLES["nu_mu"], 0, 0.5),
]
_OUTCOMES = {
    # pi+ pi0 with L = 1: all holds; different species, so that no exchange is looked at
    "rho to pi pi": {"parity": "pass", "isospin": "pass", "charge": "pass", "strangeness": "pass", "baryon_number": "pass", "identical_particles": "pass", "c_parity": "unknown", "g_parity": "unknown", "lepton_number": "pass"},
    "K to K K": {"parity": "fail", "isospin": "fail", "charge": "fail", "strangeness": "fail", "baryon_number": "pass", "identical_particles": "pass", "c_parity": "unknown", "g_parity": "unknown", "lepton_number": "pass"},
    # a weak decay: strangeness and isospin change
    "Lambda to p pi": {"parity": "fail", "isospin": "fail", "charge": "pass", "strangeness": "fail", "baryon_number": "pass", "identical_particles": "pass", "c_parity": "unknown", "g_parity": "unknown", "lepton_number": "pass"},
    # C of a particle and its antiparticle is (-1)^(L + S)
    "psi to p p": {"parity": "fail", "isospin": "pass", "charge": "unknown", "strangeness": "unknown", "baryon_number": "pass", "identical_particles": "pass", "c_parity": "pass", "g_parity": "unknown", "lepton_number": "pass"},
    "mu to e nu": {"parity": "unknown", "isospin": "pass", "charge": "pass", "strangeness": "pass", "baryon_number": "pass", "identical_particles": "pass", "c_parity": "unknown", "g_parity": "unknown", "lepton_number": "fail"},
}


@query(f"SELECT * FROM {values(*[(d, r, o) for d, x in _OUTCOMES.items() for r, o in x.items()])} v(decay, rule, outcome)")
def rule_outcomes(spark, sf_dir):
    out = []
    for name, parent, a, b, l, s in DECAYS:
        rules = qn.RuleSet().diagnose(*_OUTCOMES[name])
        out += [(name, c.rule, c.outcome) for c in rules.evaluate(parent, a, b, l, s).checks]
    return table(spark, "decay string, rule string, outcome string", out)


@query(f"SELECT * FROM {values(('rho to pi pi', 'strong', True), ('K to K K', 'strong', False), ('Lambda to p pi', 'strong', False), ('Lambda to p pi', 'weak', True), ('psi to p p', 'strong', False), ('psi to p p', 'angular', True), ('mu to e nu', 'weak', False), ('rho to pi pi', 'electromagnetic', True), ('rho to pi pi', 'strict', False))} v(decay, rules, allowed)")
def rule_sets(spark, sf_dir):
    """Sets of rules; a strict policy rejects what is unknown."""
    sets = {"strong": qn.RuleSet.strong(), "weak": qn.RuleSet.weak(), "electromagnetic": qn.RuleSet.electromagnetic(), "angular": qn.RuleSet.angular(), "strict": qn.RuleSet().enforce_strict("g_parity")}
    decays = {d[0]: d[1:] for d in DECAYS}
    chosen = [("rho to pi pi", "strong"), ("K to K K", "strong"), ("Lambda to p pi", "strong"), ("Lambda to p pi", "weak"), ("psi to p p", "strong"), ("psi to p p", "angular"), ("mu to e nu", "weak"), ("rho to pi pi", "electromagnetic"), ("rho to pi pi", "strict")]
    return table(spark, "decay string, rules string, allowed boolean", [(d, r, sets[r].evaluate(*decays[d]).is_allowed) for d, r in chosen])


_WAVES = [("J/psi", "p", "p_bar", "^3S_1", False), ("J/psi", "p", "p_bar", "^3D_1", False), ("J/psi", "p", "p_bar", "^1P_1", True), ("J/psi", "p", "p_bar", "^3P_1", True), ("rho0", "pi+", "pi-", "^1P_1", True), ("Lambda0", "p", "pi-", "^2P_1/2", True), ("Lambda0", "p", "pi-", "^2S_1/2", False)]


@query(f"SELECT * FROM {values(*_WAVES)} v(parent, a, b, wave, allowed)")
def partial_waves(spark, sf_dir):
    """All waves of two-body decays up to L = 3, and those that parity allows (antiprotons are listed with parity +1)."""
    rules = qn.SelectionRules(qn.RuleSet().enforce("parity"), 3)
    rows = []
    for names in (("J/psi", "p", "p_bar"), ("rho0", "pi+", "pi-"), ("Lambda0", "p", "pi-")):
        rows += [(*names, w.wave.label, w.report.is_allowed) for w in rules.scan(*[qn.PARTICLES[n] for n in names])]
    return table(spark, "parent string, a string, b string, wave string, allowed boolean", rows)


@query("SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(j AS INTEGER) AS j, CAST(j + 1 AS INTEGER) AS states FROM (SELECT r.range AS a, s.range AS b, t.range AS j FROM range(5) r, range(5) s, range(9) t) WHERE j BETWEEN abs(a - b) AND a + b AND (a + b + j) % 2 = 0")
def coupled_momenta(spark, sf_dir):
    """Totals of two angular momenta, all doubled, and the number of their projections."""
    rows = [(a, b, int(2 * j), len(qn.projections(j))) for a in range(5) for b in range(5) for j in qn.coupled(a / 2, b / 2)]
    return table(spark, "a int, b int, j int, states int", rows)


# -- histograms ---------------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT CASE WHEN n_nationkey < 3 THEN -1 WHEN n_nationkey >= 23 THEN 4 ELSE (n_nationkey - 3) // 5 END AS bin, n_regionkey + 0.5 AS w FROM nation),
s AS (SELECT bin, sum(w) AS c, sqrt(sum(w * w)) AS e FROM b GROUP BY bin), t AS (SELECT sum(c) AS every, sum(CASE WHEN bin BETWEEN 0 AND 3 THEN c END) AS inside FROM s)
SELECT CAST(bin AS INTEGER) AS bin, round(c, 9) AS counts, round(e, 9) AS errors, round(c / inside, 9) AS share, round(c / every, 9) AS share_of_all, round(c / inside / 5, 9) AS density, 5.5 + 5 * bin AS center, round(inside, 9) AS inside, round(every, 9) AS every FROM s, t WHERE bin BETWEEN 0 AND 3""")
def histogram_figures(spark, sf_dir):
    """Filled one by one, from values and from weights; all agree."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    x, w = [float(r[0]) for r in rows], [r[1] + 0.5 for r in rows]
    h, g = Histogram.empty(4, 3.0, 23.0), Histogram.from_values(x, 4, 3.0, 23.0, w)
    for a, b in zip(x, w, strict=True):
        h.fill(a, b)
    k = Histogram.empty_with_edges(h.bin_edges)
    k.set_counts(g.counts)
    k.set_errors(g.errors)
    k.underflow, k.overflow = g.underflow, g.overflow
    assert all(np.allclose(a.counts, h.counts) and np.allclose(a.errors, h.errors) for a in (g, k)) and [h.bin_index(v) for v in (2, 3, 22, 23)] == [None, 0, 3, None]
    n, m, d = k.normalized(), k.normalized(True), k.density()
    r9 = lambda v: round(float(v), 9)
    out = [(i, r9(k.counts[i]), r9(k.errors[i]), r9(n.counts[i]), r9(m.counts[i]), r9(d[i]), k.bin_center(i), r9(k.total_weight()), r9(k.total_weight(True))) for i in range(k.bins)]
    return table(spark, "bin int, counts double, errors double, share double, share_of_all double, density double, center double, inside double, every double", out)


@query("""WITH u AS (SELECT k, (k + 0.5) / 100 AS u, ((37 * k) % 100 + 0.5) / 100 AS v FROM (SELECT range AS k FROM range(100))) SELECT CAST(k AS INTEGER) AS k, round(CASE WHEN u < 0.1 THEN v WHEN u < 0.4 THEN 1 + 2 * v ELSE 3 + v END, 9) AS x FROM u""")
def histogram_draws(spark, sf_dir):
    """Values of a histogram's distribution: one number picks the bin, another the place in it."""
    k = np.arange(100)
    x = Histogram([1.0, 3.0, 6.0], [0.0, 1.0, 3.0, 4.0]).sample((k + 0.5) / 100, ((37 * k) % 100 + 0.5) / 100)
    return table(spark, "k int, x double", [(int(i), round(float(v), 9)) for i, v in zip(k, x, strict=True)])


# -- likelihoods, projections, cross sections ------------------------------------------------------------------------------


def _click_model() -> Expr:
    return (1.0 + parameter("a", 0.3) * VALUE / 100.0) ** 2


_CLICK_I = "power(1 + 0.3 * value / 100, 2)"


@query(_uniform_sql(7) + f""", s AS (SELECT 4 * sum((1 + event_id % 3) * ln({_CLICK_I})) AS l, 4 * sum((1 + event_id % 3) * 2 * (value / 100) / (1 + 0.3 * value / 100)) AS g FROM u WHERE u < 0.25),
t AS (SELECT sum(1 + event_id % 3) AS w, sum((1 + event_id % 3) * {_CLICK_I}) AS n, sum((1 + event_id % 3) * 2 * (value / 100) * (1 + 0.3 * value / 100)) AS dn FROM u) SELECT round(w * ln(n) - l, 2) AS nll, round(w * dn / n - g, 2) AS d_a FROM s, t""")
def stochastic_nll(spark, sf_dir):
    """On a quarter of the data, scaled up."""
    ds = clicks(spark, sf_dir)
    v, g = Likelihood([NLL(_click_model(), ds, ds)]).stochastic_value_and_gradient([0.3], 0.25, 7)
    return one(spark, nll=round(v, 2), d_a=round(float(g[0]), 2))


@query(_uniform_sql(11) + f""", p AS (SELECT value, (1 + event_id % 3) * ({_poisson_sql()}) AS w, 1 + event_id % 3 AS w0 FROM u)
SELECT round(sum(w) * ln(sum(w0 * {_CLICK_I})) - sum(w * ln({_CLICK_I})), 2) AS nll FROM p""")
def bootstrapped_nll(spark, sf_dir):
    """The likelihood of a replica of the data; the normalisation is that of the sample itself."""
    ds = clicks(spark, sf_dir)
    return one(spark, nll=round(Likelihood([NLL(_click_model(), ds, ds)]).bootstrap(11).nll([0.3]), 2))


class _Pull(CustomTerm):
    """A user's term without a gradient of its own."""

    name = "pull"

    def parameters(self):
        return parameter("re", 0.7).parameters()

    def nll(self, values):
        return 5.0 * (values["re"] - 0.2) ** 4


@query(NLL_SQL + "SELECT round(ds.w * ln(ns.n) - ds.l + 5 * power(0.5, 4), 2) AS nll, round(ds.w * ns.gr / ns.n - ds.gr + 20 * power(0.5, 3), 3) AS d_re, round(ds.w * ns.gi / ns.n - ds.gi, 3) AS d_im FROM ds, ns")
def custom_term(spark, sf_dir):
    term = nll_term(spark, sf_dir)
    pull = _Pull()
    v, g = term.nll_with_gradient(POINT, ["re", "im"])
    a, b = pull.nll_with_gradient(POINT, ["re", "im"])
    like = Likelihood([term, NLL(Expr.of(1.0) + 0.0 * parameter("re", 0.7, bounds=(-3, 3)) * DISCOUNT + 0.0, items(spark, sf_dir, "false"), items(spark, sf_dir, MC))])
    assert like.parameter_names() == ["re", "im"]
    return one(spark, nll=round(v + a, 2), d_re=round(float(g[0] + b[0]), 3), d_im=round(float(g[1] + b[1]), 3))


@query(f"SELECT count(*) AS events, round(sum({I_SQL}), 3) AS total, round(max({I_SQL}), 8) AS most FROM lineitem")
def projection_intensities(spark, sf_dir):
    frame = Projection(nll_term(spark, sf_dir), items(spark, sf_dir)).intensities(POINT)
    return frame.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("intensity"), 3).alias("total"), F.round(F.max("intensity"), 8).alias("most"))


@query(f"SELECT round(sum(l_quantity * {I_SQL}) / 12.5, 4) AS fitted, round(sum(l_quantity * {SLOPE_SQL}) / 12.5, 4) AS fitted_part FROM lineitem")
def fitted_cross_section(spark, sf_dir):
    like = Likelihood([nll_term(spark, sf_dir, ExtendedNLL)])
    p = [like.projection("extended_nll", items(spark, sf_dir), tags).fitted_cross_section(POINT, 12.5) for tags in ((), ("slope",))]
    return one(spark, fitted=round(p[0], 4), fitted_part=round(p[1], 4))


_DRAWS = [(0, 0.7, -0.4), (1, 0.1, 0.2), (2, -0.5, 0.3)]
_I_DRAW = "(power(1 + re * l_discount * 10, 2) + power(im * l_discount * 10, 2) + 0.1)"
_SLOPE_DRAW = "(power(re * l_discount * 10, 2) + power(im * l_discount * 10, 2) + 0.1)"
_T = f"WITH t AS (SELECT CAST(draw AS INTEGER) AS draw, re, im FROM {values(*_DRAWS)} v(draw, re, im)), w AS (SELECT sum(l_quantity) AS w FROM lineitem WHERE {DATA}),\n"
_TOTALS = f"""g AS (SELECT draw, sum(l_quantity * {_I_DRAW}) AS g, sum(l_quantity * {_SLOPE_DRAW}) AS gs, sum(CASE WHEN {MC} THEN l_quantity * {_I_DRAW} ELSE 0 END) AS a, sum(CASE WHEN {MC} THEN l_quantity * {_SLOPE_DRAW} ELSE 0 END) AS s FROM lineitem, t GROUP BY draw)\n"""


def _section(spark, sf_dir, luminosity: float, kind=NLL) -> CrossSection:
    return CrossSection(nll_term(spark, sf_dir, kind), items(spark, sf_dir), luminosity, POINT, Ensemble(["re", "im"], [d[1:] for d in _DRAWS[1:]]))


@query(_T + _TOTALS.rstrip() + " SELECT draw, round(a / g, 8) AS acceptance, round(s / gs, 8) AS acceptance_part, round(w * g / a, 3) AS corrected, round(w * g / a / 20, 4) AS observed, round(w * gs / a / 20, 4) AS observed_part, round(g / 20, 4) AS fitted FROM g, w")
def cross_section_totals(spark, sf_dir):
    """Totals with an ensemble of two draws; draw 0 is the central value."""
    x = _section(spark, sf_dir, 20.0)
    fitted = _section(spark, sf_dir, 20.0, ExtendedNLL).fitted_total()
    cols = [(x.acceptance(), 8), (x.acceptance(["slope"]), 8), (x.corrected_yield(), 3), (x.observed_total(), 4), (x.observed_total(["slope"]), 4), (fitted, 4)]
    rows = [(k, *(round(float(e.central if k == 0 else e.draws[k - 1]), d) for e, d in cols)) for k in range(3)]
    return table(spark, "draw int, acceptance double, acceptance_part double, corrected double, observed double, observed_part double, fitted double", rows)


@query(_T + f"""e AS (SELECT draw, {XS_BIN} AS bin, l_linestatus AS s, l_quantity AS w, {_I_DRAW} AS i, {_SLOPE_DRAW} AS p FROM lineitem, t),
b AS (SELECT draw, bin, sum(CASE WHEN s = 'O' THEN w ELSE 0 END) AS d, sum(w * i) AS g, sum(w * p) AS gp, sum(CASE WHEN s = 'F' THEN w * i ELSE 0 END) AS a, CASE bin WHEN 0 THEN 0.025 ELSE 0.03 END AS v FROM e WHERE bin IS NOT NULL GROUP BY draw, bin),
f AS (SELECT draw, sum(CASE WHEN s = 'F' THEN w * i ELSE 0 END) AS a FROM e GROUP BY draw)
SELECT draw, bin, round(b.d * g / b.a / (20 * v), 2) AS data, round(w * g / f.a / (20 * v), 2) AS model, round(w * gp / f.a / (20 * v), 2) AS part FROM b JOIN f USING (draw), w""")
def differential_ensemble(spark, sf_dir):
    """Draws and components of a differential cross section, two passes in all."""
    d = _section(spark, sf_dir, 20.0).differential([Axis(TAX, (0.0, 0.025, 0.055, 0.085))], {"part": ["slope"]})
    parts = (d.data, d.model, d.components["part"])
    rows = [(k, b, *(round(float((e.central if k == 0 else e.draws[k - 1])[b]), 2) for e in parts)) for k in range(3) for b in range(3)]
    return table(spark, "draw int, bin int, data double, model double, part double", rows)


@query(_T + _TOTALS.rstrip() + " SELECT draw, round(2 * w / (a / g * 18 + a / g * 25 * 0.9), 4) AS total FROM g, w WHERE draw = 0")
def pooled_total(spark, sf_dir):
    return table(spark, "draw int, total double", [(0, round(float(combined_total([_section(spark, sf_dir, v) for v in (18.0, 25.0)], [1.0, 0.9]).central), 4))])


_CHAIN = "SELECT event_id // 40 AS step, event_id // 2 % 20 AS walker, event_id % 2 AS p, value FROM events WHERE event_id < (SELECT count(*) FROM events) // 40 * 40"


def _chain(spark, sf_dir):
    """Events as the steps of 20 walkers with two parameters; the events of a step that is not complete are left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = events.where(F.col("event_id") < events.count() // 40 * 40).select(F.expr("event_id div 40").alias("step"), F.expr("event_id div 2 % 20").alias("walker"), F.expr("event_id % 2").alias("p"), "value")
    x, y = (at.where(F.col("p") == k).select("step", "walker", F.col("value").alias(n)) for k, n in enumerate("xy"))
    return x.join(y, ["step", "walker"])


@query(f"""WITH c AS ({_CHAIN}), k AS (SELECT * FROM c WHERE step >= 10 AND (step - 10) % 3 = 0), d AS (SELECT a.value AS x, b.value AS y FROM k a JOIN k b USING (step, walker) WHERE a.p = 0 AND b.p = 1),
e AS (SELECT x + y AS s, x - y AS m, x * y AS p, x / (1 + y) AS q, x, y FROM d)
SELECT count(*) AS draws, round(avg(s), 5) AS total, round(avg(m), 5) AS difference, round(avg(p), 3) AS product, round(stddev_samp(q), 5) AS ratio, round(quantile_cont(s, 0.15865), 5) AS low, round(quantile_cont(s, 0.84135), 5) AS high,
  round(covar_samp(x, y), 4) AS covariance, round(covar_samp(y, y), 4) AS variance, round(quantile_cont(y, 0.15865), 5) AS low_y FROM e""")
def estimate_arithmetic(spark, sf_dir):
    """A chain of walkers as an ensemble; sums, products and ratios of estimates of one source, and their covariance."""
    e = FrameEnsemble.from_chain(["x", "y"], _chain(spark, sf_dir), discard=10, thin=3).resident()
    a, b = e["x"], e["y"]
    (low, high), (low_y, _) = (a + b).interval(), b.interval()
    got = e.summary(total=(a + b).mean(), difference=(a - b).mean(), product=(a * b).mean(), ratio=(a / (b + 1.0)).std(), low=low, high=high, covariance=a.covariance(b), variance=b.covariance(b), low_y=low_y)
    e.streaming()
    digits = {"total": 5, "difference": 5, "product": 3, "ratio": 5, "low": 5, "high": 5, "covariance": 4, "variance": 4, "low_y": 5}
    row = (got["draws"], *(None if got[k] is None else round(got[k], d) for k, d in digits.items()))
    return table(spark, "draws long, " + ", ".join(f"{k} double" for k in digits), [row])


# -- fits -----------------------------------------------------------------------------------------------------------------------


def _scaled(spark, sf_dir, bounds=(0.01, 5.0)) -> Likelihood:
    """A size times a known shape: the best size is the data's weight over the shape's sum."""
    model = parameter("size", 1.0, bounds=bounds) * (1.0 + 10.0 * DISCOUNT)
    return Likelihood([ExtendedNLL(model, items(spark, sf_dir, DATA).resident(), items(spark, sf_dir, MC))])


_BEST = f"""WITH d AS (SELECT sum(l_quantity) AS w, sum(l_quantity * ln(1 + 10 * l_discount)) AS l FROM lineitem WHERE {DATA}), n AS (SELECT sum(l_quantity * (1 + 10 * l_discount)) AS n FROM lineitem WHERE {MC}),
x AS (SELECT method, CASE WHEN method = 'at a bound' THEN 2.0 ELSE w / n END AS p, w, l, n FROM d, n, {values(('lbfgsb',), ('nelder_mead',), ('restarts',), ('at a bound',))} v(method))
"""


@query(_BEST + "SELECT method, round(p, 3) AS size, round((p * n - w * ln(p) - l) / w, 6) AS value FROM x")
def fit_parameters(spark, sf_dir):
    """The best point of a likelihood with a known one, by each method, from random starts, and against a bound."""
    like = _scaled(spark, sf_dir)
    data = like.terms[0].data
    w = data.sum_weights()
    found = {"lbfgsb": fit(like), "nelder_mead": fit(like, method="nelder_mead"), "restarts": fit_restarts(like, 2, 5)[0]}
    other = Likelihood([ExtendedNLL(parameter("size", 3.0, bounds=(2.0, 5.0)) * (1.0 + 10.0 * DISCOUNT), data, like.terms[0].accepted)])
    found["at a bound"] = fit(other)
    data.streaming()
    return table(spark, "method string, size double, value double", [(k, round(float(r.x[0]), 3), round(r.value / w, 6)) for k, r in found.items()])


_REPLICAS = " UNION ALL ".join(f"SELECT * FROM ({_uniform_sql(21 + k)} SELECT {k} AS replica, sum((1 + event_id % 3) * ({_poisson_sql()})) / sum((1 + event_id % 3) * (1 + value / 100)) AS size FROM u)" for k in range(3))


@query(f"SELECT CAST(replica AS INTEGER) AS replica, round(size, 4) AS size FROM ({_REPLICAS})")
def replica_fits(spark, sf_dir):
    """The best points of three replicas of the data."""
    ds = clicks(spark, sf_dir)
    model = parameter("size", 1.0, bounds=(0.01, 5.0)) * (1.0 + VALUE / 100.0)
    e = bootstrap_fit(Likelihood([ExtendedNLL(model, ds, ds)]), 3, 21)
    return table(spark, "replica int, size double", [(k, round(float(d[0]), 4)) for k, d in enumerate(e.draws)])


# -- generation -------------------------------------------------------------------------------------------------------------------

_AB = [f"{p}_{c}" for p in "ab" for c in ("e", "px", "py", "pz")]


def _two_body(events: int, seed: int) -> Steps:
    s = Steps(f"SELECT range AS event_id, 2.0 AS p_e, 0.0 AS p_px, 0.0 AS p_py, 0.0 AS p_pz FROM range({events})")
    return s.stream("v", "event_id", seed, gen.PRODUCTION, gen.VERTEX_OBJECT).decay("a", "b", "p", "0.2", "0.4", "v")


def _momenta(names, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


@query(_two_body(16_384, 12).select(f"event_id, {_momenta(_AB)}, round(a_w, 9) AS weight FROM _"))
def generate_weighted(spark, sf_dir):
    """16,384 weighted decays, the same whatever the partitions."""
    frame = gen.two_body(2.0, 0.2, 0.4).weighted(spark, 16_384, 12).frame
    return frame.select(F.col(ID).alias("event_id"), *[F.round(c, 6).alias(c) for c in _AB], F.round("weight", 9).alias("weight"))


def _accepted(seed: int, events: int, keep: str) -> str:
    s = _two_body(4 * events, seed).stream("acc", "event_id", seed, gen.ACCEPTANCE, 0).uniform("u", "acc", 0)
    kept = s.select(f"*, {keep} AS keep FROM _")
    return f"SELECT n - 1 AS event_id, {_momenta(_AB)}, CAST(1 AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ({kept}) WHERE keep) WHERE n <= {events}"


@query(_accepted(12, 4096, "TRUE"))
def generate_unweighted(spark, sf_dir):
    """Plain phase space under its proven envelope: every proposal counts."""
    g = gen.two_body(2.0, 0.2, 0.4)
    frame = g.unweighted(spark, 4096, 12, envelope=g.phase_space_envelope())[0].frame
    return frame.select(F.col(ID).alias("event_id"), *[F.round(c, 6).alias(c) for c in _AB], "weight")


@query(_accepted(5, 2048, "u * 0.08 <= a_w * (1 + 0.9 * a_pz / 0.9490521589)"))
def generate_with_model(spark, sf_dir):
    """The first 2048 proposals that a model under a given envelope accepts."""
    model = 1.0 + 0.9 * Vec4.event("a").pz / 0.9490521589
    g = gen.two_body(2.0, 0.2, 0.4)
    frame = g.unweighted(spark, 2048, 5, model, envelope=0.08)[0].frame
    return frame.select(F.col(ID).alias("event_id"), *[F.round(c, 6).alias(c) for c in _AB], "weight")


PROTON, KAON = 0.93827208816, 0.497611


def closure_generator() -> gen.Generator:
    """beam + target to X + recoil by t-exchange, X to two kaons."""
    ch = Channel.of([Edge("beam"), Edge("target"), Edge("x"), Edge("recoil"), Edge("k1"), Edge("k2")], [Vertex("production", ("beam", "target"), ("x", "recoil")), Vertex("decay", ("x",), ("k1", "k2"))])
    return gen.Generator(
        ch,
        {"beam": gen.InitialMomentum.along(gen.ScalarSource.uniform(8.0, 9.0)), "target": gen.InitialMomentum(momentum=(0.0, 0.0, 0.0))},
        {"beam": 0.0, "target": PROTON, "x": gen.mass(2 * KAON, 2.0), "recoil": PROTON, "k1": KAON, "k2": KAON},
        {"production": gen.VertexProposal.t_exchange(("beam", "x"), 4.0, 0.2)},
    )


_CLOSURE = [f"{p}_{c}" for p in ("x", "recoil", "k1", "k2") for c in ("e", "px", "py", "pz")]


def _closure_sql(events: int, seed: int) -> str:
    mp, mk = repr(PROTON), repr(KAON)
    s = Steps(f"SELECT range AS event_id FROM range({events})")
    s.stream("r0", "event_id", seed, gen.PRODUCTION, 0).uniform("u0", "r0", 0)
    s.stream("r1", "event_id", seed, gen.PRODUCTION, gen.MASS_OBJECT + 2).uniform("u1", "r1", 0)
    s.stream("r2", "event_id", seed, gen.PRODUCTION, gen.VERTEX_OBJECT).uniform("u2", "r2", 0).uniform("u3", "r2", 1).uniform("u4", "r2", 2)
    s.stream("r3", "event_id", seed, gen.PRODUCTION, gen.VERTEX_OBJECT + 1)
    s.add(beam="8 + u0", mx=f"{2 * KAON!r} + u1 * (2.0 - {2 * KAON!r})")
    s.add(te=f"beam + {mp}").add(rs="sqrt(te * te - beam * beam)", bz="beam / te")
    s.add(p_in=f"(rs * rs - {PROTON**2!r}) / (2 * rs)", p_out=f"sqrt((rs * rs - pow(mx + {mp}, 2)) * (rs * rs - pow(mx - {mp}, 2))) / (2 * rs)")
    s.add(centre="mx * mx - 2 * p_in * sqrt(mx * mx + p_out * p_out)", span="2 * p_in * p_out")
    s.add(low="centre - span", high="centre + span")
    s.add(t="CASE WHEN u2 < 0.8 THEN low + ln(1 + u3 * (exp(4 * (high - low)) - 1)) / 4 ELSE low + u3 * (high - low) END")
    s.add(density="0.8 * 4 * exp(4 * (t - low)) / (exp(4 * (high - low)) - 1) + 0.2 / (high - low)", c="least(greatest((t - centre) / span, -1), 1)")
    s.add(sn="sqrt(greatest(1 - c * c, 0))", phi="2 * pi() * u4", w="1 / (16 * pi() * rs * p_in * density)")
    for out, m, sign in (("x", "mx", ""), ("recoil", mp, "-")):
        s.add(**{f"c{out}_e": f"sqrt(p_out * p_out + {m} * {m})", f"c{out}_px": f"{sign}(sn * sin(phi)) * p_out", f"c{out}_py": f"{sign}(-sn * cos(phi)) * p_out", f"c{out}_pz": f"{sign}(c) * p_out"})
        s.boost(out, f"c{out}", "0.0", "0.0", "bz")
    s.decay("k1", "k2", "x", mk, mk, "r3")
    return s.select(f"event_id, {_momenta(_CLOSURE, 4)}, round(w * k1_w * (2.0 - {2 * KAON!r}), 7) AS weight FROM _")


@query(_closure_sql(8192, 3))
def generate_closure_channel(spark, sf_dir):
    """Production by t-exchange and a decay: momenta and weights."""
    frame = closure_generator().weighted(spark, 8192, 3).frame
    return frame.select(F.col(ID).alias("event_id"), *[F.round(c, 4).alias(c) for c in _CLOSURE], F.round("weight", 7).alias("weight"))


def _scalars_sql(events: int, seed: int) -> str:
    s = _two_body(events, seed)
    for k in range(2):
        s.stream(f"q{k}", "event_id", seed, gen.PRODUCTION, gen.SCALAR_OBJECT + k).uniform(f"w{k}", f"q{k}", 0)
    # a histogram of weights 1 and 3 on [0, 1) and [1, 3): its density is 1/4 and 3/8
    return s.select("event_id, round(-2 + 5 * w0, 9) AS flat, round(CASE WHEN w1 < 0.25 THEN w1 / 0.25 ELSE 1 + (w1 - 0.25) / 0.375 END, 9) AS shaped, round(a_w * 5 * CASE WHEN w1 < 0.25 THEN 4.0 ELSE 8.0 / 3 END, 9) AS weight FROM _")


@query(_scalars_sql(4096, 9))
def generate_scalars(spark, sf_dir):
    """Columns beside the momenta: uniform, and from a histogram."""
    g = gen.two_body(2.0, 0.2, 0.4).with_scalar("flat", gen.ScalarSource.uniform(-2.0, 3.0)).with_scalar("shaped", gen.ScalarSource.histogram(Histogram([1.0, 3.0], [0.0, 1.0, 3.0])))
    frame = g.weighted(spark, 4096, 9).frame
    return frame.select(F.col(ID).alias("event_id"), *[F.round(c, 9).alias(c) for c in ("flat", "shaped", "weight")])


@query("SELECT 16384 AS requested, 16384 AS produced, 0 AS rejected, round(w, 12) AS low, round(w, 12) AS high, round(16384 * w, 7) AS total, round(w, 9) AS envelope, round(w, 9) AS pilot FROM (SELECT sqrt((4 - 0.36) * (4 - 0.04)) / 4 / (8 * pi()) AS w)")
def generation_report(spark, sf_dir):
    """Weights of plain phase space are all alike, and the envelope is that weight."""
    g = gen.two_body(2.0, 0.2, 0.4)
    r = g.report(g.weighted(spark, 16_384, 12), 12)
    row = (r.requested, r.produced, r.rejected, round(r.minimum_weight, 12), round(r.maximum_weight, 12), round(r.sum_weights, 7), round(g.phase_space_envelope(), 9), round(g.pilot(spark, 1000, 3), 9))
    return table(spark, "requested int, produced int, rejected int, low double, high double, total double, envelope double, pilot double", [row])
