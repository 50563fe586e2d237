import math

import duckdb
import numpy as np
import pytest
from brindle.operators.cross_section import Ensemble, Estimate
from brindle.operators.draws import FEW, FrameEnsemble, doubles, keys, quantiles
from brindle.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

QUERY = "estimate_arithmetic"


def test_keys_are_in_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2.0), 1e300, np.inf, np.nan])
    k = keys(x)
    assert (k[1:] > k[:-1]).all() and np.array_equal(doubles(k), x, equal_nan=True)
    assert keys(np.array([-0.0])) == keys(np.array([0.0])) and keys(np.array([-np.nan])) == k[-1]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    n = 3 * FEW
    sets = {
        "wide": rng.standard_normal(n) * 10.0 ** rng.integers(-300, 300, n),
        "close": 1.0 + rng.integers(0, 9, n) * 2.0**-52,
        "alike": np.where(np.arange(n) < n // 3, -2.5, 7.0),
        "near": 100.0 + rng.random(n) * 1e-9,
        "ends": np.where(np.arange(n) % 3 == 0, -np.inf, np.where(np.arange(n) % 3 == 1, 0.0, np.nan)),
    }
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(*sets.values(), strict=True)], ", ".join(f"{k} double" for k in sets)).repartition(5)
    shares = (0.0, 0.15865, 0.5, 0.84135, 1.0)
    got = quantiles(frame, [(F.col(k), p) for k in sets for p in shares])
    want = [float(np.sort(x)[int(p * (n - 1))]) if k == "ends" else float(np.quantile(x, p)) for k, x in sets.items() for p in shares]
    assert got == pytest.approx(want, rel=1e-15, abs=0, nan_ok=True)
    some = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    assert quantiles(some, [(x, 0.5), (y, 0.5), (x, 1.0), (x, 0.25)]) == [2.5, None, 4.0, 1.75] and quantiles(some, []) == []


def test_draws_in_a_frame_are_those_in_an_array(spark):
    chain = np.random.default_rng(5).normal(size=(31, 4, 2))
    rows = [(s, w, *map(float, chain[s, w])) for s in range(31) for w in range(4)]
    table = FrameEnsemble.from_chain(["x", "y"], spark.createDataFrame(rows, "step int, walker int, x double, y double"), discard=4, thin=5)
    plain = Ensemble.from_chain(["x", "y"], chain, discard=4, thin=5)
    a, b = table["x"], table["y"]
    p, q = (Estimate(1.0, plain.draws[:, k], plain.source) for k in (0, 1))
    low, high = (a - b * 2).interval(0.5)
    got = table.resident().summary(mean=(a + b).mean(), std=(a / b).std(), low=low, high=high, median=(a * b).median(), c=a.covariance(b))
    table.streaming()
    cov = np.cov(plain.draws, rowvar=False)[0, 1]
    want = {"draws": len(plain), "mean": (p + q).mean(), "std": (p / q).std(), "median": (p * q).median(), "c": cov} | dict(zip(("low", "high"), (p - q * 2).interval(0.5), strict=True))
    assert got == pytest.approx(want, rel=1e-12)
    one = FrameEnsemble(["x"], spark.createDataFrame([(1.0,), (None,)], "x double"))
    assert one.summary(over=(one["x"] / 0).mean(), std=one["x"].std()) == {"draws": 2, "over": math.inf, "std": None}
    with pytest.raises(ValueError):
        a + one["x"]
    with pytest.raises(ValueError):
        a.quantile(1.5)
    with pytest.raises(KeyError):
        table["z"]


def _sql(path):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    cur = con.execute(ORACLE_SQL[QUERY])
    return dict(zip([x[0] for x in cur.description], cur.fetchone(), strict=True))


@pytest.mark.parametrize("rows", [
    "select * from e where event_id < 390",  # no step is kept
    "select * from e where event_id < 0",
    "select * from e where event_id % 7 <> 3 order by hash(event_id)",  # gaps, in no order
    "select * from e union all select * from e where event_id % 5 = 0",  # ids that repeat
    "select event_id - 40 as event_id, value from e union all select null, 1.0 from range(50)",
    "select event_id, case when event_id % 11 = 0 then null else value end as value from e",
])
def test_odd_chains_match_sql(spark, tmp_path, rows):
    con = duckdb.connect()
    con.execute("create view e as select event_id, value from '/root/testdata/sf0.001/events.parquet'")
    con.execute(f"copy ({rows}) to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES[QUERY](spark, str(tmp_path)).first().asDict()
    want = _sql(tmp_path)
    assert got.keys() == want.keys() and all(got[k] == (want[k] and pytest.approx(want[k], abs=1e-4, rel=1e-6)) for k in want), (got, want)


def test_the_chain_stays_out_of_the_driver(spark, monkeypatch):
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (seen.append(r := collect(self)), r)[1])
    for other in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, other, None)
    got = QUERIES[QUERY](spark, "/root/testdata/sf0.1").first().asDict()
    assert sum(map(len, seen)) < 4 * FEW < got["draws"] and got == pytest.approx(_sql("/root/testdata/sf0.1"), abs=1e-4)
