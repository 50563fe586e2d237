import math

import numpy as np
import pytest
from brindle.dataset import Dataset
from brindle.functions import quantum as qn
from brindle.functions.channel import ChannelError
from brindle.operators import generate as gen
from brindle.operators.cross_section import Axis, CrossSection, Ensemble, Estimate, combine, combined_total
from brindle.operators.fit import bootstrap_fit, fit, fit_restarts, fit_stochastic, sample, walker_positions
from brindle.operators.likelihood import NLL, CustomTerm, ExtendedNLL, LassoPenalty, Likelihood, Normalization, RidgePenalty, merge
from brindle.plans.expr import Parameter, complex_, parameter, scalar
from brindle.queries import ORACLE_SQL, QUERIES
from brindle.queries_more import closure_generator

X = scalar("x")


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    mc = rng.uniform(-1, 1, 4000)
    u = rng.uniform(-1, 1, 20000)
    keep = u[rng.random(20000) * 2.5 < (1 + 0.6 * u) ** 2 + 0.04 * u**2][:3000]
    make = lambda v: Dataset.from_arrays(spark, None, {"x": v}).resident()
    return make(keep), make(mc), make(rng.uniform(-1, 1, 2000))


def model(bounds=(-2, 2)):
    c = complex_(parameter("re", 0.3, bounds=bounds), parameter("im", 0.2, bounds=(0, 2)))
    return (complex_(1.0, 0.0).tagged("flat") + (c * X).tagged("slope")).norm_sqr() + 0.01


def test_likelihood_gradients_and_strategies(samples):
    data, mc, _ = samples
    for kind in (NLL, ExtendedNLL):
        like = Likelihood([kind(model(), data, mc)])
        x = np.array([0.5, 0.3])
        v, g = like.value_and_gradient(x)
        for i in range(2):
            h = np.eye(2)[i] * 1e-5
            assert g[i] == pytest.approx((like.nll(x + h) - like.nll(x - h)) / 2e-5, rel=1e-5)
        general = Likelihood([kind(model(), data, mc, normalization="general")])
        assert general.nll(x) == pytest.approx(v, rel=1e-12)
        assert like.nll_many([x, [0.1, 0.4]])[0] == pytest.approx(v, rel=1e-12)
        assert like.diagnostics()[0]["strategy"] == "statistics" and general.diagnostics()[0]["strategy"] == "general"
    n = Normalization(mc, model(), "verify")
    assert n.value({"re": 0.5, "im": 0.3})[0] > 0


def test_fit_recovers_the_truth(samples):
    data, mc, _ = samples
    like = Likelihood([NLL(model(), data, mc)])
    r = fit(like)
    assert r.converged and r.x[0] == pytest.approx(0.6, abs=0.1)
    other = fit(like, method="nelder_mead", limit=150)
    assert other.value == pytest.approx(r.value, abs=0.05)
    assert fit_restarts(like, 2, seed=1)[0].value == pytest.approx(r.value, abs=0.05)
    s = fit_stochastic(like, fraction=0.5, steps=25, rate=0.05)
    assert s.x[0] == pytest.approx(0.6, abs=0.3)


def test_bounds_hold(samples):
    data, mc, _ = samples
    r = fit(Likelihood([NLL(model((-2, 0.4)), data, mc)]))
    assert r.x[0] == pytest.approx(0.4)


def test_penalties_and_custom_terms(samples):
    class Pull(CustomTerm):
        def parameters(self):
            return [Parameter("re")]

        def nll(self, values):
            return (values["re"] - 1) ** 2 * 50

    like = Likelihood([Pull(), RidgePenalty(["re"], 2.0), LassoPenalty(["re"], 0.5)])
    v, g = like.value_and_gradient([0.5])
    assert v == pytest.approx(12.5 + 0.5 + 0.25) and g[0] == pytest.approx(-50 + 2 + 0.5, rel=1e-6)
    with pytest.raises(ValueError):
        merge([[Parameter("a", 1.0)], [Parameter("a", 2.0)]])


def test_stochastic_and_bootstrap(samples):
    data, mc, _ = samples
    like = Likelihood([NLL(model(), data, mc)])
    assert like.stochastic_value_and_gradient([0.5, 0.3], 1.0, 3)[0] == pytest.approx(like.nll([0.5, 0.3]), rel=1e-12)
    again = like.bootstrap(5)
    assert again.terms[0].data.sum_weights() == like.bootstrap(5).terms[0].data.sum_weights() != data.sum_weights()
    e = bootstrap_fit(like, 2, seed=4, limit=15)
    assert e.draws.shape == (2, 2)


def test_sampling_walkers(samples):
    data, mc, _ = samples
    like = Likelihood([NLL(model(), data, mc)])
    w = walker_positions(like, 6, 1, around=[0.6, 0.2], spread=0.02)
    chain = sample(like, w, 4, seed=2)
    assert chain.shape == (4, 6, 2) and np.isfinite(chain).all()
    e = Ensemble.from_chain(["re", "im"], chain, discard=2)
    assert len(e) == 12
    with pytest.raises(ValueError):
        sample(like, w[:3], 1)


def test_projection_and_cross_section(samples):
    data, mc, g = samples
    values = {"re": 0.6, "im": 0.2}
    like = Likelihood([ExtendedNLL(model(), data, mc)])
    p = like.projection("extended_nll", g)
    assert p.weights(values).agg({"weight": "sum"}).first()[0] == pytest.approx(p.acceptance_corrected_yield(values))
    assert like.projection("extended_nll", g, ("slope",)).generated_integral(values) < p.generated_integral(values)
    with pytest.raises(ValueError):
        Likelihood([NLL(model(), data, mc)]).projection("nll", g).fitted_cross_section(values, 1.0)
    e = Ensemble(["re", "im"], [[0.6, 0.2], [0.5, 0.3], [0.7, 0.1]])
    x = CrossSection(like.terms[0], g, 10.0, values, e)
    total = x.observed_total()
    assert total.central == pytest.approx(p.observed_cross_section(values, 10.0)) and total.draws[0] == pytest.approx(total.central)
    d = x.differential([Axis(X, (-1, 0, 1.5))], {"slope": ["slope"]})
    assert d.shape == (2,) and d.data.draws.shape == (3, 2) and d.components["slope"].central.shape == (2,)
    assert (d.model.central * np.array([1, 1.5])).sum() == pytest.approx(total.central)
    assert d.model.covariance().shape == (2, 2)
    pooled = combine([x, x], [Axis(X, (-1, 0, 1.5))])
    assert pooled == pytest.approx(d.data.central)
    assert combined_total([x, x]).central == pytest.approx(total.central)
    assert np.isnan(x.differential([Axis(X, (5.0, 6.0))]).data.central).all()


def test_estimates():
    a = Estimate(2.0, [1.0, 2.0, 3.0, 4.0], 1)
    assert a.std() == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and a.quantile(0.5) == 2.5
    assert (a + a).draws.tolist() == [2, 4, 6, 8] and (a - a).std() == 0
    b = Estimate(1.0, [1.0, 2.0, 3.0, 4.0], 2)
    assert len((a * b).draws) == 4 and (a * b).central == 2.0
    assert (a / 2).central == 1.0


def test_generation_is_repeatable(spark):
    g = gen.two_body(2.0, 0.2, 0.4)
    one = g.weighted(spark, 500, 9).frame.orderBy("_event_id").toPandas()
    frame = g.weighted(spark, 500, 9)
    assert one.equals(frame.frame.repartition(7).orderBy("_event_id").toPandas())
    p = one.weight.iloc[0]
    momentum = math.sqrt((4 - 0.36) * (4 - 0.04)) / 4
    assert p == pytest.approx(momentum / (8 * math.pi)) and p <= g.phase_space_envelope()
    for c in ("e", "px", "py", "pz"):
        assert (one[f"a_{c}"] + one[f"b_{c}"]).to_numpy() == pytest.approx(one[f"parent_{c}"].to_numpy(), abs=1e-12)


def test_unweighted_takes_the_first_accepted(spark):
    g = gen.two_body(2.0, 0.2, 0.4)
    tilt = 1.0 + 0.9 * scalar("a_pz") / 1.0
    env = g.phase_space_envelope() * 2.0
    ds, report = g.unweighted(spark, 200, 4, tilt, envelope=env)
    n = 3000
    cols = g.propose(np.arange(n), 4)
    w = cols["weight"] * (1 + 0.9 * cols["a_pz"])
    want = np.flatnonzero(gen.acceptance_np(4, np.arange(n)) * env <= w)[:200]
    assert sorted(r.a_pz for r in ds.frame.collect()) == pytest.approx(sorted(cols["a_pz"][want]))
    assert ds.sum_weights() == 200 and 0 < report.acceptance_rate < 1
    with pytest.raises(gen.EnvelopeOverflow):
        g.unweighted(spark, 50, 4, tilt, envelope=env / 100)
    grown, r = g.unweighted(spark, 50, 4, tilt, envelope=env / 4, overflow="grow")
    assert grown.num_events() == 50 and r.updates >= 1
    with pytest.raises(RuntimeError):
        g.unweighted(spark, 5000, 4, tilt, envelope=env * 50, max_proposals=1000)


def test_t_exchange_and_adaptation(spark):
    frame = closure_generator().weighted(spark, 8192, 3).frame.toPandas()
    for c in ("e", "px", "py", "pz"):
        assert (frame[f"beam_{c}"] + frame[f"target_{c}"]).to_numpy() == pytest.approx((frame[f"x_{c}"] + frame[f"recoil_{c}"]).to_numpy(), abs=1e-9)
        assert (frame[f"k1_{c}"] + frame[f"k2_{c}"]).to_numpy() == pytest.approx(frame[f"x_{c}"].to_numpy(), abs=1e-9)
    t = sum((1 if c == "e" else -1) * (frame[f"beam_{c}"] - frame[f"x_{c}"]) ** 2 for c in ("e", "px", "py", "pz"))
    assert (t < 1e-9).all() and np.average(np.abs(t), weights=frame.weight) > np.abs(t).mean()
    with pytest.raises(ChannelError):
        gen.Generator(gen.two_body(2.0, 0.2, 0.4).channel, {}, {})
    d = gen.PiecewiseDensity((0.0, 1.0, 3.0), (1.0, 3.0))
    x = d.sample(0.5, 2.0, np.linspace(0.001, 0.999, 400))
    assert x.min() >= 0.5 and x.max() <= 2.0 and np.mean(1 / d.density(0.5, 2.0, x)) == pytest.approx(1.5, rel=0.02)


def test_quantum_rules():
    p = qn.PARTICLES
    waves = qn.SelectionRules(qn.RuleSet.strong(), 4).allowed_partial_waves(p["rho0"], p["pi+"], p["pi-"])
    assert [(w.wave.l, w.wave.s) for w in waves] == [(1, 0)]
    assert waves[0].c_parity == -1 and waves[0].wave.label == "^1P_1"
    # two identical spinless bosons couple with even L only
    same = qn.SelectionRules(qn.RuleSet.strong(), 4).allowed_partial_waves(p["rho0"], p["pi0"], p["pi0"])
    assert same == []
    r = qn.RuleSet.strong().evaluate(p["phi"].patched(charge=0, strangeness=0), p["K+"], p["K+"], 1, 0)
    assert not r.is_allowed and {c.rule for c in r.failures()} >= {"charge", "strangeness"}
    unknown = qn.Particle(spin=0)
    assert qn.RuleSet.strong().evaluate(unknown, unknown, unknown, 0, 0).is_allowed
    assert not qn.RuleSet().enforce_strict("parity").evaluate(unknown, unknown, unknown, 0, 0).is_allowed
    exotic = qn.Particle.jpc(1, -1, 1)
    assert qn.RuleSet().enforce("meson_jpc").evaluate(exotic, unknown, unknown, 0, 0).is_allowed is False
    assert qn.coupled(0.5, 1) == [qn.half(0.5), qn.half(1.5)] and qn.multiplicity(1.5) == 4
    with pytest.raises(ValueError):
        qn.PartialWave(qn.half(0), 1, qn.half(0))
    with pytest.raises(ValueError):
        qn.Particle(spin=0.5, statistics=qn.BOSON)
    assert len(qn.RULES) == 17


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for k in ("weighted_sum", "predicate_nan", "bin_by_last_edge", "subsample", "decay_angles", "nll", "differential_cross_section"):
        frame = QUERIES[k](spark, d)
        cols = sorted(frame.columns)
        got = sorted(tuple(r[c] for c in cols) for r in frame.collect())
        cur = con.execute(ORACLE_SQL[k])
        names = [x[0] for x in cur.description]
        want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert list(a) == pytest.approx(list(b), abs=1e-5), k
