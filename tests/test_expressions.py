import math

import numpy as np
import pytest
from brindle.dataset import Dataset
from brindle.functions import lineshape as ls
from brindle.functions import special as sp
from brindle.functions.channel import Channel, ChannelError, Edge, Vertex
from brindle.functions.vectors import RealVec3, RealVec4, Vec3, Vec4
from brindle.operators.reduce import LOG, NotPositive, reduce, weighted_sums
from brindle.plans import render
from brindle.plans.evaluate import SingularMatrix, evaluate
from brindle.plans.expr import Expr, ShapeError, acos, atan2, cis, complex_, dot, matmul, matrix, matvec, parameter, scalar, solve, vector
from brindle.plans.lower import Lowered
from brindle.plans.rewrite import derivative, simplify
from brindle.plans.separate import NotSeparable, contract, separate, split

X, Y = scalar("x"), scalar("y")
RNG = np.random.default_rng(5)
COLS = {"x": np.concatenate([RNG.normal(size=40), [0.0, 1.0, -1.0]]), "y": np.concatenate([RNG.normal(size=40), [0.0, 2.0, 0.0]])}


@pytest.fixture(scope="module")
def events(spark):
    return Dataset.from_arrays(spark, None, COLS)


CASES = {
    "mixed": complex_(X, Y) * cis(X) / complex_(2.0 + X * X, Y),
    "sqrt": (X * Y).sqrt() + complex_(X, Y).sqrt(),
    "log": (X * X + 1.0).log() + complex_(X, 1.0 + Y * Y).log(),
    "waves": complex_(X, Y).sin() * complex_(X, -Y).cos() + complex_(X, Y).exp(),
    "powers": complex_(X, Y + 3.0) ** -3 + complex_(X, Y) ** 4 + X**0,
    "angles": atan2(Y, X) + acos(X / 10.0),
    "norms": complex_(X, Y).norm_sqr() - (complex_(X, Y).conj() * complex_(X, Y)).real() + complex_(X, Y).imag(),
    "matrices": dot(matvec(matmul(matrix([[X, 1.0], [Y, 2.0]]), matrix([[1.0, Y], [X, 3.0]])), vector([X, 1j])), vector([1.0, Y])),
    "solve2": solve(matrix([[X + 9.0, Y], [1.0, 5.0 + 1j * Y]]), vector([X, 2.0]))[1],
    "solve3": solve(matrix([[X + 9.0, Y, 0.0], [1.0, 5.0 + 1j * Y, X], [0.0, 1.0, 7.0]]), vector([X, 2.0, 1j]))[2],
    "division": 1.0 / X,
}


@pytest.mark.parametrize("name", CASES)
def test_columns_agree_with_numpy(events, name):
    want = evaluate(CASES[name], COLS)
    got = events.evaluate(CASES[name])
    np.testing.assert_allclose(np.nan_to_num(got), np.nan_to_num(want), rtol=1e-9, atol=1e-9)
    assert (np.isnan(got.real) == np.isnan(want.real)).all()


@pytest.mark.parametrize("name", CASES)
def test_simplified_agrees(name):
    np.testing.assert_allclose(np.nan_to_num(evaluate(simplify(CASES[name]), COLS)), np.nan_to_num(evaluate(CASES[name], COLS)), rtol=1e-9, atol=1e-9)


def test_json_and_sharing():
    e = CASES["mixed"].named("amp").tagged("t")
    again = Expr.from_json(e.to_json())
    assert again.to_json() == e.to_json() and again.label == "amp" and again.tags == {"t"}
    twice = ((X + 1.0) * (X + 1.0)).merged()
    assert twice.args[0] is twice.args[1]


def test_shapes_are_checked():
    with pytest.raises(ShapeError):
        matmul(matrix([[1.0, 2.0]]), matrix([[1.0, 2.0]]))
    with pytest.raises(ShapeError):
        vector([1.0, 2.0]) + vector([1.0])
    with pytest.raises(ShapeError):
        vector([1.0]).at(3)


def test_singular_matrix_is_an_error():
    m = solve(matrix([[X, X, 0.0], [X, X, 0.0], [0.0, 0.0, 1.0]]), vector([1.0, 1.0, 1.0]))[0]
    with pytest.raises(SingularMatrix):
        evaluate(m, {"x": np.ones(2)})


def test_tags_project_to_zero():
    a, b = X.tagged("a"), Y.tagged("b")
    e = (a + b).norm_sqr()
    np.testing.assert_allclose(evaluate(e.project("a"), COLS).real, COLS["x"] ** 2)
    np.testing.assert_allclose(evaluate(e.project("a", "b"), COLS).real, (COLS["x"] + COLS["y"]) ** 2)


def test_parameters():
    e = parameter("a", 1.0) * X + parameter("b", 2.0, fixed=True)
    assert [p.name for p in e.parameters() if not p.fixed] == ["a"]
    assert [p.name for p in e.fix(a=3.0).free("b").parameters() if not p.fixed] == ["b"]
    with pytest.raises(ValueError):
        (parameter("a", 1.0) + parameter("a", 2.0)).parameters()
    with pytest.raises(KeyError):
        e.fix(c=1.0)


@pytest.mark.parametrize("name", ["norm", "phase", "chain", "solve"])
def test_derivatives(name):
    a, b = parameter("a", 0.7), parameter("b", -0.3)
    z = complex_(a, b) * X + cis(b * Y)
    e = {"norm": z.norm_sqr(), "phase": atan2(a * X + 3.0, b + 2.0) + z.conj().imag(), "chain": (z.sqrt() / (a + 2.0) + z**3).exp().real() + (a**2 + 1.0).log(), "solve": solve(matrix([[a + 5.0, X, 0.0], [b, 4.0, 1.0], [0.0, a, 6.0]]), vector([1.0, b, X]))[1].norm_sqr()}[name]
    v = {"a": 0.7, "b": -0.3}
    for p in v:
        h = 1e-6
        num = (evaluate(e, COLS, {**v, p: v[p] + h}) - evaluate(e, COLS, {**v, p: v[p] - h})) / (2 * h)
        np.testing.assert_allclose(evaluate(derivative(e, p), COLS, v), num, rtol=1e-5, atol=1e-6)


def test_separation():
    c = complex_(parameter("a", 1.0), parameter("b", 2.0))
    amp = c * X + parameter("d", 0.5) * Y + 1.0
    for e in (amp.norm_sqr(), amp.norm_sqr() * (c * Y + X).norm_sqr(), (amp.norm_sqr()) ** 2):
        terms = separate(simplify(e))
        v = {"a": 0.3, "b": -0.8, "d": 1.7}
        sums = np.array([evaluate(t.basis, COLS).sum() for t in terms])
        assert contract(terms, sums, v).real == pytest.approx(evaluate(e, COLS, v).real.sum(), rel=1e-9)
    mixed = (parameter("a", 1.0) * X).sin()
    with pytest.raises(NotSeparable):
        separate(mixed)
    terms, rest = split(simplify(amp.norm_sqr() + mixed.norm_sqr()))
    assert terms and rest is not None


def test_reductions_columns_and_kernel(events):
    a = parameter("a", 0.7)
    e = (complex_(a, 1.0) * X + Y).norm_sqr() + 0.5
    big = e + 0.0 * solve(matrix([[5.0 + a, 0.0, 1.0], [0.0, 3.0, 0.0], [1.0, 0.0, 2.0]]), vector([1.0, 2.0, X * X]))[0].norm_sqr()
    v = {"a": 0.7}
    for transform in ("real", LOG):
        p, q = (reduce(events, f, transform, v, ["a"]) for f in (e, big))
        assert p[0] == pytest.approx(q[0], rel=1e-9) and p[1] == pytest.approx(q[1], rel=1e-9)
    with pytest.raises(NotPositive):
        reduce(events, X, LOG, v)
    with pytest.raises(NotPositive):
        reduce(events, X / X, "positive", v)
    assert weighted_sums(events, [complex_(X, Y)])[0] == pytest.approx(COLS["x"].sum() + 1j * COLS["y"].sum())


def test_plans_stay_small(events):
    e = ls.relativistic_breit_wigner(2.0 + X * X, 1.3, 0.2, 0.4, 0.2, 3).norm_sqr()
    plan = Lowered(events.frame, [simplify(e)]).frame._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000


def test_special_functions():
    one = {"x": np.array([0.3]), "y": np.array([1.1])}
    val = lambda e: complex(evaluate(Expr.of(e), one)[0])
    total = sum(abs(val(sp.spherical_harmonic(3, m, X, Y))) ** 2 for m in range(-3, 4))
    assert total == pytest.approx(7 / (4 * math.pi))
    for j, mp in ((2, 1), (1.5, -0.5)):
        assert sum(val(sp.WignerD(j, mp, m - j).d(Y)).real ** 2 for m in range(int(2 * j) + 1)) == pytest.approx(1.0)
    assert sp.clebsch_gordan(0.5, 0.5, 0.5, -0.5, 1, 0) == pytest.approx(math.sqrt(0.5))
    assert sp.clebsch_gordan(1, 0, 1, 0, 1, 0) == 0 and sp.clebsch_gordan(1, 1, 1, -1, 0, 0) == pytest.approx(math.sqrt(1 / 3))
    assert sp.wigner_3j(1, 1, 2, 0, 0, 0) == pytest.approx(math.sqrt(2 / 15))
    with pytest.raises(ValueError):
        sp.WignerD(1, 2, 0)
    # every barrier but that of L = 6, whose constant is kept as is, is 1 at q = q_r
    for l in range(9):
        b = val(sp.blatt_weisskopf(sp.Q_R, l)).real
        assert (b == pytest.approx(1.0)) == (l != 6)
    assert val(sp.q(4.0, 0.5, 0.5)).real == pytest.approx(math.sqrt(3.0) / 2)
    assert val(sp.q(4.0, 0.5, 0.5, sp.UNPHYSICAL)).real == pytest.approx(-math.sqrt(3.0) / 2)
    # the loop's imaginary part above threshold is the phase space, up to sign
    assert val(sp.chew_mandelstam(4.0, 0.5, 0.4)).imag == pytest.approx(-val(sp.rho(4.0, 0.5, 0.4)).real)


def test_k_matrix_unitarity_and_shapes():
    s = 1.5 + X * X
    b = ls.blatt_weisskopf_barriers(s, [0.2, 0.3], [0.2, 0.3], [1.1, 1.6], 0)
    assert b.shape == (2, 2)
    k = ls.k_matrix(s, [1.1, 1.6], [[0.5, 0.1], [0.2, 0.4]], b)
    p = ls.p_vector(s, [1.1, 1.6], [1.0, 0.5], [[0.5, 0.1], [0.2, 0.4]], b)
    f = ls.f_vector(s, [1.1, 1.6], k, p, matrix([[sp.chew_mandelstam(s, 0.2, 0.2), 0.0], [0.0, sp.chew_mandelstam(s, 0.3, 0.3)]]))
    v = evaluate(f, COLS)
    assert v.shape == (43, 2) and np.isfinite(v).all()
    for r in (ls.F0, ls.F2, ls.A0, ls.A2, ls.RHO, ls.PI1):
        n = len(r.poles)
        assert np.isfinite(evaluate(r.amplitude(2.0 + X * X, [1.0] * n), COLS)).all()
    n = 2 * 1 + 4 + 1
    moved = ls.PI1.resampled(np.diag([1e-4] * 2 + [0.0] * 4 + [1e-4]), 3)
    assert moved.background == ls.PI1.background and moved.poles != ls.PI1.poles and n == 7
    with pytest.raises(ShapeError):
        ls.p_vector(s, [1.1, 1.6], [1.0], [[0.5, 0.1], [0.2, 0.4]], b)


P = {f"{n}_{c}": v for n, vs in (("a", (3.0, 1.0, 0.5, 2.0)), ("b", (2.5, -0.5, 1.0, 0.2))) for c, v in zip(("e", "px", "py", "pz"), (np.array([x]) for x in vs), strict=True)}


def test_vectors_and_frames():
    a, b = Vec4.event("a"), Vec4.event("b")
    val = lambda e: complex(evaluate(Expr.of(e), P)[0]).real
    ra, rb = RealVec4(3.0, 1.0, 0.5, 2.0), RealVec4(2.5, -0.5, 1.0, 0.2)
    assert val((a + b).m()) == pytest.approx((ra + rb).m())
    rest = (a + b).boost(-(a + b).beta())
    assert val(rest.vec3().mag()) == pytest.approx(0.0, abs=1e-9) and val(rest.e) == pytest.approx((ra + rb).m())
    assert val(a.boost(Vec3.zero()).e) == 3.0
    moved, real = a.boost(b.beta()), ra.boost(rb.beta())
    assert [val(x) for x in (moved.e, moved.px, moved.py, moved.pz)] == pytest.approx([real.e, real.px, real.py, real.pz])
    assert val(a.vec3().cross(b.vec3()).dot(a.vec3())) == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ZeroDivisionError):
        RealVec3(0, 0, 0).unit()
    with pytest.raises(ValueError):
        RealVec4(1, 2, 0, 0).m()
    assert RealVec4(1, 2, 0, 0).signed_m() == pytest.approx(-math.sqrt(3))


def test_channel():
    ch = Channel.of([Edge("p"), Edge("a", "a"), Edge("b", "b")], [Vertex("d", ("p",), ("a", "b"))])
    val = lambda e: complex(evaluate(Expr.of(e), P)[0]).real
    assert val(ch.mass("p")) == pytest.approx((RealVec4(3.0, 1.0, 0.5, 2.0) + RealVec4(2.5, -0.5, 1.0, 0.2)).m())
    v = ch.vertex("d")
    assert val(v.costheta("a", Vec3.z_axis())) == pytest.approx(-val(v.costheta("b", Vec3.z_axis())))
    two = Channel.of([Edge("a", "a"), Edge("b", "b"), Edge("x"), Edge("r")], [Vertex("v", ("a", "b"), ("x", "r"))])
    with pytest.raises(ChannelError):
        two.p4("x")
    with pytest.raises(ChannelError):
        ch.vertex("d").mandelstam("t")
    with pytest.raises(ChannelError):
        Channel.of([Edge("a"), Edge("b")], [Vertex("u", ("a",), ("b",)), Vertex("w", ("b",), ("a",))])
    with pytest.raises(ChannelError):
        Channel.of([Edge("a"), Edge("a")], [])


def test_renderers():
    e = ((X + 2.0) * complex_(X, parameter("w", 1.0)).norm_sqr()).named("I")
    assert render.equation(e) == "(x + 2) * |complex(x, w)|^2"
    assert r"\left|" in render.latex(e) and "param" not in render.equation(e)
    assert render.tree(e).count("\n") == 7 and "digraph" in render.dot(e) and render.svg(e).startswith("<svg")
    assert "tomato" in render.dot(e, [render.Style("tomato", kind="param")])


def val(e):
    return complex(evaluate(Expr.of(e), {}, None, 1)[0])


def test_coupled_channels_at_a_known_point():
    s, p = 1.8889166211166355, [0.1 + 0.2j, 0.3 + 0.4j, 0.5 + 0.6j, 0.7 + 0.8j, 0.9 + 1.0j]
    # Amplitudes of the second channel at s.
    want = {
        ls.kopf_f0: 0.2674945594859746 + 0.728945115184662j,
        ls.kopf_f2: 0.02463134381292893 + 0.3964232300397033j,
        ls.kopf_a0: -0.800275915726 - 0.13593066320582162j,
        ls.kopf_a2: -0.2087815057065276 - 0.10173200171306504j,
        ls.kopf_rho: 0.09449011845747245 + 0.2609094192601879j,
        ls.kopf_pi1: -0.1102837189594736 + 0.263468912197887j,
    }
    poles = {ls.kopf_f0: 5, ls.kopf_f2: 4, ls.kopf_a0: 2, ls.kopf_a2: 2, ls.kopf_rho: 2, ls.kopf_pi1: 1}
    for f, z in want.items():
        assert abs(val(f(s, p[: poles[f]])[1]) - z) < 1e-12, f.__name__


def test_the_loop_function_does_not_hang_on_signed_zeros():
    for a, b in ((0.2, 0.4), (0.547862, 0.95778), (0.3, 0.3)):
        for s in (0.05, 0.9, 1.7, 2.0, 3.0, 9.0):
            z = val(sp.chew_mandelstam(s, a, b))
            r = val(sp.rho(s, a, b))
            assert z.imag == pytest.approx(-r.real if s > (a + b) ** 2 else 0.0, abs=1e-12)
