import math
from fractions import Fraction

import numpy as np
import pytest
from brindle.dataset import ID, Dataset
from brindle.operators.accurate import joined, parts
from brindle.operators.binning import Bins
from brindle.operators.reduce import GROUP, LOG, many, reduce
from brindle.plans.expr import parameter, scalar
from brindle.queries import ORACLE_SQL, QUERIES
from brindle.schema import EventSchema, SchemaError
from brindle.sources.contract import EventSource, FragmentedSource, part
from brindle.sources.memory import BatchSource, MemorySource
from pyspark.sql import functions as F


def test_sums_are_rounded_once(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(4001) * 10.0 ** rng.integers(-200, 200, 4001)
    x = np.concatenate([x, -x[:4000], [1e16, 1.0, -1e16, 5e-324, 0.0, -0.0]])
    rng.shuffle(x)
    want = float(sum(map(Fraction, x.tolist())))
    assert joined(parts(x)) == want == math.fsum(x)
    assert joined([r for k in range(0, len(x), 7) for r in parts(x[k : k + 7])]) == want
    assert math.isnan(joined(parts(np.array([1.0, np.nan])))) and joined(parts(np.array([np.inf, 1.0]))) == np.inf
    assert math.isnan(joined(parts(np.array([np.inf, -np.inf])))) and joined([]) == 0.0
    ds = MemorySource(scalars={"x": x}).load(spark)
    for n in (1, 5):
        assert Dataset(ds.frame.repartition(n), ds.schema).weighted_sum(scalar("x"), accurate=True) == want


def test_even_bins_by_arithmetic(spark):
    for n, low, high in ((40, 0.0, 500.0), (9, -1.0, 0.1), (1000, 0.1, 0.7), (17, 1e-9, 3e-9)):
        bins = Bins.uniform(n, low, high)
        x = sorted({*bins.edges, *np.nextafter(bins.edges, -np.inf), *np.nextafter(bins.edges, np.inf), math.nan, math.inf})
        frame = spark.createDataFrame([(float(v),) for v in x], "x double")
        for closed in (False, True):
            got = [-1 if r[0] is None else r[0] for r in frame.select(bins.index(F.col("x"), closed)).collect()]
            assert got == bins.find(np.array(x), closed).tolist(), (n, closed)


def test_many_points_are_columns_of_one_pass(spark):
    ds = MemorySource(scalars={"x": np.linspace(0.1, 3, 50)}, weights=np.arange(1.0, 51)).load(spark)
    model = (parameter("a", 1.0) + parameter("b", 0.5) * scalar("x")) ** 2 + 0.1
    draws = np.random.default_rng(2).normal(size=(GROUP + 3, 2))
    for transform in (LOG, "real"):
        got = many(ds, model, draws, ["a", "b"], transform)
        assert got == pytest.approx([reduce(ds, model, transform, {"a": a, "b": b})[0] for a, b in draws], rel=1e-12)
    assert many(ds, model, [], ["a", "b"]).tolist() == []


def test_batches_are_read_by_tasks(spark):
    schema = EventSchema((), ("x",), False)

    def rows(rank, ranks):
        if rank != 2:
            yield {"scalars": {"x": np.arange(3.0) + 10 * rank}}

    ds = BatchSource(rows, schema, 4).load(spark)
    assert [r.x for r in ds.with_ids().frame.orderBy(ID).collect()] == [0, 1, 2, 10, 11, 12, 30, 31, 32]
    assert ds.num_events() == 9 and ds.with_ids().frame.agg(F.max(ID)).first()[0] == 8
    assert Dataset.from_batches(spark, [], schema).num_events() == 0
    assert Dataset.from_batches(spark, [{"scalars": {"x": [1.0]}}, {"scalars": {"x": [2.0, 3.0]}}], schema).slice(1, 3).weighted_sum(scalar("x")) == 5
    with pytest.raises(SchemaError):
        Dataset.from_batches(spark, [{"scalars": {"y": [1.0]}}], schema)
    with pytest.raises(Exception, match="not"):
        Dataset.from_batches(spark, lambda: [{"scalars": {"x": [1.0]}, "weights": [1.0]}], schema).num_events()


def test_fragments_share_out_a_source(spark):
    source = MemorySource(scalars={"x": np.arange(10.0)})
    batches = BatchSource(lambda: [], EventSchema((), ("x",), False))
    assert isinstance(source, FragmentedSource) and not isinstance(batches, FragmentedSource) and isinstance(batches, EventSource)
    assert [[r.x for r in source.fragment(spark, i, 3).with_ids().frame.orderBy(ID).collect()] for i in range(3)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]
    with pytest.raises(ValueError):
        part(source.load(spark), 3, 3)


def test_more_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("lineitem", "events", "embeddings", "nation"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    names = ("parquet_round_trip", "batch_source", "ordered_traversals", "histogram_figures", "k_matrix_five_channels", "cross_section_totals", "estimate_arithmetic", "replica_fits", "generate_with_model", "generate_closure_channel", "coupling_coefficients", "rule_outcomes")
    for k in names:
        frame = QUERIES[k](spark, d)
        cols = sorted(frame.columns)
        got = sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)
        cur = con.execute(ORACLE_SQL[k])
        at = [x[0] for x in cur.description]
        assert sorted(at) == cols, k
        want = sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
        assert len(got) == len(want), k
        for a, b in zip(sorted(got), sorted(want), strict=True):
            assert all(x == y or x == pytest.approx(float(y), abs=1e-4, rel=1e-6) for x, y in zip(a, b, strict=True)), (k, a, b)
