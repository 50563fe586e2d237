import math

import numpy as np
import pytest
from brindle.dataset import ID, Dataset, concat
from brindle.operators.binning import Bins
from brindle.operators.histogram import Histogram
from brindle.operators.predicate import between
from brindle.operators.sampling import poisson1_np, uniform01_np
from brindle.plans.expr import parameter, scalar
from brindle.schema import EventSchema, SchemaError
from brindle.sources.memory import BatchBuilder, BatchSource, MemorySink
from brindle.sources.parquet import read_parquet
from brindle.sources.root import read_root
from pyspark.sql import functions as F
from pyspark.sql import types as T


def weighted(spark, n=5):
    i = np.arange(n, dtype=float)
    return Dataset.from_arrays(spark, {"p": np.column_stack([i + 0.3, i, i + 0.1, i + 0.2])}, {"x": i}, 10 + i)


def points(spark):
    return Dataset.from_arrays(spark, None, {"x": [-1.0, 0.0, 1.0, 2.0]}, [0.5, 1.0, 1.5, 2.0])


X = scalar("x")


def test_stats_and_filter(spark):
    ds = weighted(spark)
    assert ds.stats() == (5, 60.0)
    kept = ds.filter(F.col("x") % 2 == 0)
    assert [r[ID] for r in kept.frame.orderBy(ID).collect()] == [0, 2, 4]
    assert kept.weights().tolist() == [10, 12, 14]
    assert kept.weighted_sum(X) == 80.0
    assert ds.filter(lambda b: b.x > 3).num_events() == 1


def test_unit_weights(spark):
    ds = Dataset.from_arrays(spark, None, {"x": [1.0, 2.0]})
    assert ds.sum_weights() == 2.0 and ds.weights().tolist() == [1.0, 1.0]


def test_select_between_and_nan(spark):
    ds = points(spark)
    count = lambda p: ds.select(p).num_events()
    assert count(between(X, 0, 1)) == 2
    assert count(between(X, -1, 1, "neither")) == 1
    assert ds.select(between(X, 0, 2, "left")).sum_weights() == 2.5
    nan = X / X  # NaN at 0
    assert count(nan != 5.0) == 3 and count(~(nan < 5.0)) == 1 and count((nan < 5.0) | (X == 0.0)) == 4
    with pytest.raises(TypeError):
        bool(X < 1.0)


def test_ids_restart_after_select(spark):
    ds = points(spark).select(X >= 0.0).with_ids()
    assert sorted(r[ID] for r in ds.frame.collect()) == [0, 1, 2]
    assert ds.slice(1, 3).evaluate_real(X).tolist() == [1.0, 2.0]


def test_bin_by_keeps_the_last_edge(spark):
    b = points(spark).bin_by(X, Bins.uniform(2, 0, 2))
    assert [sorted(d.evaluate_real(X).tolist()) for d in b] == [[0.0], [1.0, 2.0]]
    assert points(spark).bin_by(X, Bins((5, 6, 7)))[1].num_events() == 0


def test_sampling_does_not_depend_on_partitions(spark):
    n = 400
    ids = np.arange(n)
    for parts in (1, 7):
        ds = Dataset.from_arrays(spark, None, {"x": ids.astype(float)})
        ds.frame = ds.frame.repartition(parts)
        u = uniform01_np(3, ids)
        assert ds.subsample(0.3, 3).evaluate_real(X).tolist() == ids[u < 0.3].tolist()
        assert ds.bootstrap(3).weights().tolist() == poisson1_np(u).tolist()
    # the same seed gives the same numbers: a small enough subsample bootstraps to nothing
    assert ds.subsample(0.36, 5).bootstrap(5).sum_weights() == 0.0
    with pytest.raises(ValueError):
        ds.subsample(1.5)


def test_ordered_visits(spark):
    ds = weighted(spark)
    assert ds.map_events(lambda r: r.x) == [0, 1, 2, 3, 4]
    assert ds.fold_events("", lambda s, r: s + str(int(r.x))) == "01234"
    assert ds.accumulate_events([], lambda s, r: s.append(r.weight)) == [10, 11, 12, 13, 14]
    assert sum(len(b) for b in ds.batches()) == 5
    assert ds.map_batches(lambda b: b[["x"]] * 2, "x double").count() == 5


def test_concat_and_strides(spark):
    ds = weighted(spark)
    both = concat([ds, ds])
    assert both.num_events() == 10 and both.strided(5, 1).evaluate_real(X).tolist() == [1.0, 1.0]
    assert both.rows([0, 9]).evaluate_real(X).tolist() == [0.0, 4.0]
    with pytest.raises(SchemaError):
        concat([ds, points(spark)])


def test_schema_inference():
    fields = [T.StructField(n, T.DoubleType()) for n in ("run_e", "k_e", "k_px", "k_py", "k_pz", "x", "weight")]
    s = EventSchema.infer(T.StructType([*fields, T.StructField("n", T.LongType())]))
    assert s == EventSchema(("k",), ("x", "run_e"), True)
    assert s.columns() == ["k_e", "k_px", "k_py", "k_pz", "x", "run_e", "weight"]
    with pytest.raises(SchemaError):
        EventSchema.infer(T.StructType(fields), incomplete_as_scalars=False)
    with pytest.raises(SchemaError):
        EventSchema.infer(T.StructType(fields[:1]), require_weight=True)


def test_parquet_round_trip(spark, tmp_path):
    for k, ds in enumerate((weighted(spark), weighted(spark, 3))):
        ds.write_to(str(tmp_path / f"part{k}"), single=True)
    got = read_parquet(spark, str(tmp_path / "part*"))
    assert got.schema == EventSchema(("p",), ("x",), True)
    assert got.evaluate_real(X).tolist() == [0, 1, 2, 3, 4, 0, 1, 2]
    assert sorted(r[ID] for r in got.frame.select(ID).collect()) == list(range(8))
    Dataset.from_arrays(spark, None, {"x": [1.5]}).write_to(str(tmp_path / "f32"), precision="f32")
    assert read_parquet(spark, str(tmp_path / "f32")).sum_weights() == 1.0
    with pytest.raises(FileNotFoundError):
        read_parquet(spark, str(tmp_path / "none*"))


def test_nulls(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.createDataFrame([(1.0,), (None,)], "x double").write.parquet(path)
    assert math.isnan(read_parquet(spark, path, nulls="nan").evaluate_real(X)[-1]) or math.isnan(read_parquet(spark, path, nulls="nan").evaluate_real(X)[0])
    with pytest.raises(Exception, match="null in column x"):
        read_parquet(spark, path).weighted_sum(X)


def test_batches_and_builders(spark):
    schema = EventSchema((), ("run",), True)
    make = lambda: [{"scalars": {"run": [1.0, 2.0]}, "weights": [0.5, 1.5]}, {"scalars": {"run": [3.0]}, "weights": [2.0]}]
    ds = BatchSource(make, schema).load(spark)
    assert ds.stats() == (3, 4.0) and ds.evaluate_real(scalar("run")).tolist() == [1, 2, 3]
    b = BatchBuilder(schema)
    b.push({"run": 1.0}, 2.0)
    with pytest.raises(ValueError):
        b.push({"run": 1.0})
    sink = MemorySink()
    sink.write(b.finish(spark))
    assert sink.dataset.sum_weights() == 2.0
    assert Dataset.from_batches(spark, [], schema).stats() == (0, 0.0)


def test_root_needs_a_library(spark):
    with pytest.raises(NotImplementedError):
        read_root(spark, "x.root")


def test_queries_need_bound_parameters(spark):
    with pytest.raises(ValueError, match="free"):
        points(spark).evaluate(parameter("a", 1.0) * X)
    with pytest.raises(ValueError, match="real"):
        points(spark).evaluate_real((X * 1j))
    assert points(spark).evaluate(parameter("a", 2.0, fixed=True) * X).real.tolist() == [-2, 0, 2, 4]


def test_histogram_of_dataset(spark):
    h = Histogram.of_dataset(points(spark), X, (0.0, 1.0, 2.0))
    assert h.counts.tolist() == [1.0, 1.5] and (h.underflow, h.overflow) == (0.5, 2.0)
    assert h.errors.tolist() == [1.0, 1.5]
    other = Histogram.from_values_with_edges([-1, 0, 1, 2], (0, 1, 2), [0.5, 1, 1.5, 2])
    assert other.to_json() == h.to_json()
    other.fill(0.5, 2.0)
    assert other.counts[0] == 3.0 and other.errors[0] == math.hypot(1, 2)
    with pytest.raises(ValueError):
        other.fill(math.nan)
    assert Histogram([4, 9], [0, 1, 4], 0.5, 1.25).errors.tolist() == [2, 3]
    assert h.density().tolist() == [0.4, 0.6] and h.normalized(flow=True).counts.tolist() == [0.2, 0.3]
    with pytest.raises(ValueError):
        Histogram.of_dataset(points(spark), X / X, (0.0, 1.0))


def test_streaming(spark, tmp_path):
    from brindle.streaming.events import evaluate_stream, read_stream, select_stream

    ds = points(spark)
    ds.write_to(str(tmp_path / "in"))
    s = read_stream(spark, str(tmp_path / "in"), ds.schema)
    out = evaluate_stream(select_stream(s, X >= 0.0), "y", X * 2.0)
    q = out.writeStream.format("memory").queryName("events_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.y for r in spark.sql("select y from events_out").collect()) == [0.0, 2.0, 4.0]
