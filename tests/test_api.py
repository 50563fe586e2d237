import numpy as np
import pytest
from brindle import api
from brindle.functions.quantum import PARTICLES
from brindle.operators.generate import MassProposal, VertexProposal, two_body
from brindle.operators.reduce import LOG, reduce
from brindle.plans.expr import complex_, parameter, scalar
from brindle.session import Execution, MemoryBudget, capabilities

X = scalar("x")


@pytest.fixture(scope="module")
def ds(spark):
    return api.Dataset.from_arrays(spark, None, {"x": np.linspace(-1, 1, 50)}, np.ones(50) * 0.5)


def test_model(ds):
    m = api.Model(((parameter("a", 0.5, bounds=(0, 1)) * complex_(X.cos(), X.sin()) + 1.0).tagged("all")).norm_sqr())
    v, g = m.value_and_gradient(ds, [0.5])
    assert g[0] == pytest.approx((m.value_and_gradient(ds, [0.5001])[0] - m.value_and_gradient(ds, [0.4999])[0]) / 2e-4, rel=1e-5)
    rows = m.evaluate_with_gradient(ds, [0.5]).collect()
    assert sum(r.value * 0.5 for r in rows) == pytest.approx(v) and sum(r.d_a * 0.5 for r in rows) == pytest.approx(g[0])
    assert m.parameter_names() == ["a"] and m.fix(a=0.2).parameter_names() == [] and m.fix(a=0.2).free("a").parameter_names() == ["a"]
    assert m.projection("none").value_and_gradient(ds)[0] == 0 and 0 <= m.sample_parameters(3)[0] <= 1
    assert "a" in m.equation() and m.latex() and m.tree() and m.dot() and m.svg()
    kept, fast = m.cached(ds)
    for t in ("real", LOG):
        assert reduce(kept, fast.expr, t, {"a": 0.7})[0] == pytest.approx(reduce(ds, m.expr, t, {"a": 0.7})[0], rel=1e-12)
    assert any(c.startswith("cache_") for c in kept.frame.columns)
    with pytest.raises(ValueError):
        api.Model(api.vector([X, 1.0]))


def test_json_round_trips():
    for x in (PARTICLES["K+"], MassProposal(0.1, 2.0), VertexProposal.t_exchange(("a", "b"), 4.0, 0.2), api.Histogram([4, 9], [0, 1, 4], 0.5, 1.25, [2, 3]), api.RuleSet.strong(), api.EventSchema(("p",), ("x",), True), api.Parameter("mass", 1.25, bounds=(0, 2), scale=0.1, unit="GeV"), api.Bins((0, 1, 4))):
        again = api.from_json(api.to_json(x))
        assert api.to_json(again) == api.to_json(x)
    e = (parameter("mass", 1.25) + 2.0) * X
    assert api.from_json(api.to_json(e)).to_json() == e.to_json()
    with pytest.raises(ValueError):
        api.from_json('{"$": "Nothing"}')


def test_session(spark):
    assert capabilities()["backend"] == "spark" and MemoryBudget.bytes(800).rows(10) == 10
    assert 0 < MemoryBudget.percent_available(50).resolve() <= MemoryBudget.percent_total(100).resolve()
    with pytest.raises(ValueError):
        Execution(precision="f32")
    with pytest.raises(ValueError):
        MemoryBudget.percent_total(0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert Execution(shuffle_partitions=3).apply(spark).conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_adapted_generator_keeps_the_integral(spark):
    g = two_body(2.0, 0.2, 0.4)
    from brindle.functions.channel import Channel, Edge, Vertex
    from brindle.operators.generate import Generator, InitialMomentum, mass

    ch = Channel.of([Edge("p"), Edge("x"), Edge("c"), Edge("a"), Edge("b")], [Vertex("v", ("p",), ("x", "c")), Vertex("d", ("x",), ("a", "b"))])
    g = Generator(ch, {"p": InitialMomentum(momentum=(0, 0, 0))}, {"p": 3.0, "x": mass(0.5, 2.5), "c": 0.3, "a": 0.2, "b": 0.2})
    m = 1.0 / ((api.Vec4.event("x").m2() - 2.0) ** 2 + 0.01)
    new = g.adapted(spark, 2000, 5, m)
    assert new.masses["x"].learned is not None
    a, b = (h.weighted(spark, 6000, 8, m).frame.agg({"weight": "avg"}).first()[0] for h in (g, new))
    assert a == pytest.approx(b, rel=0.15)
    assert all(k in api.__all__ for k in ("Dataset", "Model", "NLL", "CrossSection", "Generator", "read_parquet", "kopf_f0"))
    top = g.weighted(spark, 4000, 9).frame.agg({"weight": "max"}).first()[0]
    assert top <= g.phase_space_envelope()
