"""Unbinned likelihoods over datasets: terms, penalties, normalisation by sufficient statistics, projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import ID, Dataset
from ..plans.expr import Expr, Parameter
from ..plans.lower import Lowered
from ..plans.rewrite import derivative, simplify
from ..plans.separate import Term, contract, split
from .reduce import LOG, POSITIVE, REAL, many, reduce, weighted_sums

#: Terms of data use the seed plus their number times this.
SEED_STEP = 0x9E3779B97F4A7C15
AUTO, GENERAL, STATISTICS, VERIFY = "auto", "general", "statistics", "verify"


class Normalization:
    """The sum of weight times intensity over a sample, at any parameter values.

    Separable parts are summed once, in one job, as bases that hold no parameter; then a value costs no job. Other
    parts are summed event by event each time.
    """

    def __init__(self, ds: Dataset, intensity: Expr, mode: str = AUTO, limit: int = 256):
        self.ds, self.mode = ds, mode
        root = simplify(intensity)
        self.terms: list[Term] = []
        self.rest: Expr | None = root
        self.reason = "asked for" if mode == GENERAL else None
        if mode != GENERAL:
            terms, rest = split(root)
            if len(terms) > limit and mode == AUTO:
                self.reason = f"{len(terms)} bases"
            else:
                self.terms, self.rest = terms, rest
        if mode == STATISTICS and self.rest is not None:
            raise ValueError("the intensity is not separable")
        self.root = root
        self._sums: np.ndarray | None = None

    @property
    def strategy(self) -> str:
        return "general" if not self.terms else "statistics" if self.rest is None else "hybrid"

    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = weighted_sums(self.ds, [t.basis for t in self.terms]) if self.terms else np.zeros(0)
        return self._sums

    def value(self, values: Mapping[str, float], names: Sequence[str] = ()) -> tuple[float, np.ndarray]:
        """The sum and its gradient."""
        out, grad = 0.0, np.zeros(len(names))
        if self.terms:
            s = self.sums()
            out += contract(self.terms, s, values).real
            for i, n in enumerate(names):
                live = [(Term(derivative(t.coefficient, n), t.basis), x) for t, x in zip(self.terms, s, strict=True)]
                grad[i] += contract([t for t, _ in live], np.array([x for _, x in live]), values).real
        if self.rest is not None:
            v, g = reduce(self.ds, self.rest, REAL, values, names)
            out, grad = out + v, grad + g
        if self.mode == VERIFY:
            v, _ = reduce(self.ds, self.root, REAL, values)
            if not math.isclose(v, out, rel_tol=1e-9, abs_tol=1e-12):
                raise ArithmeticError(f"statistics give {out}, events {v}")
        return out, grad


class Term_:
    """A summand of a likelihood: parameters, a value, and a gradient (by differences unless a term has its own)."""

    name = "term"

    def parameters(self) -> list[Parameter]:
        return []

    def nll(self, values: Mapping[str, float]) -> float:
        raise NotImplementedError

    def nll_with_gradient(self, values: Mapping[str, float], names: Sequence[str]) -> tuple[float, np.ndarray]:
        spec = {p.name: p for p in self.parameters()}
        grad = np.zeros(len(names))
        here = self.nll(values)
        for i, n in enumerate(names):
            if n not in spec:
                continue
            x, (lo, hi) = values[n], spec[n].bounds
            h = np.cbrt(np.finfo(float).eps) * max(1.0, abs(x))
            up, down = (hi is None or x + h <= hi), (lo is None or x - h >= lo)
            a = self.nll({**values, n: x + h}) if up else here
            b = self.nll({**values, n: x - h}) if down else here
            grad[i] = (a - b) / (h * (up + down)) if up or down else 0.0
        return here, grad

    def bootstrapped(self, seed: int) -> Term_:
        return self


CustomTerm = Term_


@dataclass
class NLL(Term_):
    """W ln N - sum w ln I, with N the accepted sample's sum and W the data's weight."""

    model: Expr
    data: Dataset
    accepted: Dataset
    name: str = "nll"
    normalization: str = AUTO
    extended = False
    _norm: Normalization | None = field(default=None, repr=False)

    def parameters(self) -> list[Parameter]:
        return self.model.parameters()

    def norm(self) -> Normalization:
        if self._norm is None:
            self._norm = Normalization(self.accepted, self.model, self.normalization)
        return self._norm

    def nll(self, values):
        return self.nll_with_gradient(values, ())[0]

    def nll_with_gradient(self, values, names):
        return self._of(self.data, 1.0, values, names)

    def stochastic(self, values, names, fraction: float, seed: int):
        """On a hash sample of the data, scaled up; the normalisation is exact."""
        return self._of(self.data.subsample(fraction, seed), 1.0 / fraction, values, names)

    def _of(self, data: Dataset, scale: float, values, names):
        n, dn = self.norm().value(values, names)
        s, ds = reduce(data, self.model, LOG, values, names)
        if self.extended:
            return n - scale * s, dn - scale * ds
        if not n > 0:
            raise ArithmeticError(f"the normalisation of {self.name} is {n}")
        w = self.data.sum_weights()
        return w * math.log(n) - scale * s, w * dn / n - scale * ds

    def nll_many(self, draws, names: Sequence[str]) -> np.ndarray:
        """At many parameter points: one job for the data, none or one for the normalisation."""
        draws = np.asarray(draws, float)
        logs = many(self.data, self.model, draws, names, LOG)
        norm = self.norm()
        if norm.rest is None:
            n = np.array([norm.value(dict(zip(names, d, strict=True)))[0] for d in draws])
        else:
            n = many(self.accepted, self.model, draws, names, REAL)
        return (n if self.extended else self.data.sum_weights() * np.log(n)) - logs

    def bootstrapped(self, seed: int) -> NLL:
        return type(self)(self.model, self.data.bootstrap(seed), self.accepted, self.name, self.normalization, self._norm)


@dataclass
class ExtendedNLL(NLL):
    """N - sum w ln I: the number of events counts too."""

    name: str = "extended_nll"
    extended = True


@dataclass
class RidgePenalty(Term_):
    """strength * sum of squares."""

    names: Sequence[str]
    strength: float
    name: str = "ridge"

    def parameters(self):
        return [Parameter(n) for n in self.names]

    def nll(self, values):
        return self.strength * sum(values[n] ** 2 for n in self.names)

    def nll_with_gradient(self, values, names):
        return self.nll(values), np.array([2 * self.strength * values[n] if n in self.names else 0.0 for n in names])


@dataclass
class LassoPenalty(Term_):
    """strength * sum of sizes; the slope at 0 is 0."""

    names: Sequence[str]
    strength: float
    name: str = "lasso"

    def parameters(self):
        return [Parameter(n) for n in self.names]

    def nll(self, values):
        return self.strength * sum(abs(values[n]) for n in self.names)

    def nll_with_gradient(self, values, names):
        return self.nll(values), np.array([self.strength * np.sign(values[n]) if n in self.names else 0.0 for n in names])


@dataclass
class Layout:
    """The parameters of a likelihood: free ones in order, fixed ones by value."""

    parameters: list[Parameter]

    def free(self) -> list[Parameter]:
        return [p for p in self.parameters if not p.fixed]

    def names(self) -> list[str]:
        return [p.name for p in self.free()]

    def defaults(self) -> np.ndarray:
        return np.array([p.value if p.value is not None else 0.0 for p in self.free()])

    def values(self, x) -> dict[str, float]:
        out = {p.name: float(p.value) for p in self.parameters if p.fixed}
        return out | dict(zip(self.names(), map(float, x), strict=True))

    def wrap(self, x) -> np.ndarray:
        """Periodic parameters back into their period."""
        out = np.array(x, float)
        for i, p in enumerate(self.free()):
            if p.periodic:
                lo, hi = p.bounds
                out[i] = lo + (out[i] - lo) % (hi - lo)
        return out

    def inside(self, x) -> bool:
        return all((p.periodic or ((p.bounds[0] is None or v >= p.bounds[0]) and (p.bounds[1] is None or v <= p.bounds[1]))) and math.isfinite(v) for p, v in zip(self.free(), x, strict=True))

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        """A random point: uniform between bounds, else normal about the default by the scale."""
        out = []
        for p in self.free():
            lo, hi = p.bounds
            if lo is not None and hi is not None:
                out.append(rng.uniform(lo, hi))
            else:
                v = (p.value or 0.0) + p.scale * rng.standard_normal()
                out.append(max(lo, v) if lo is not None else min(hi, v) if hi is not None else v)
        return np.array(out)


def merge(groups: Sequence[Sequence[Parameter]]) -> Layout:
    """Parameters of several terms by name. A bare name takes the other's specification; else two must agree."""
    out: dict[str, Parameter] = {}
    for p in (p for g in groups for p in g):
        old = out.get(p.name)
        if old is None or old == Parameter(p.name):
            out[p.name] = p
        elif p not in (old, Parameter(p.name)):
            raise ValueError(f"parameter {p.name} is specified in two ways")
    return Layout(list(out.values()))


class Likelihood:
    """A sum of terms over shared parameters."""

    def __init__(self, terms: Sequence[Term_]):
        self.terms = list(terms)
        self.layout = merge([t.parameters() for t in self.terms])
        self.evaluations = {"value": 0, "gradient": 0}

    def parameter_names(self) -> list[str]:
        return self.layout.names()

    def default_parameters(self) -> np.ndarray:
        return self.layout.defaults()

    def sample_parameters(self, seed: int = 0) -> np.ndarray:
        return self.layout.sample(np.random.default_rng(seed))

    def nll(self, x) -> float:
        self.evaluations["value"] += 1
        v = self.layout.values(x)
        return sum(t.nll(v) for t in self.terms)

    value = nll

    def value_and_gradient(self, x) -> tuple[float, np.ndarray]:
        self.evaluations["gradient"] += 1
        v, names = self.layout.values(x), self.parameter_names()
        total, grad = 0.0, np.zeros(len(names))
        for t in self.terms:
            a, g = t.nll_with_gradient(v, names)
            total, grad = total + a, grad + g
        return total, grad

    def stochastic_value_and_gradient(self, x, fraction: float, seed: int) -> tuple[float, np.ndarray]:
        v, names = self.layout.values(x), self.parameter_names()
        total, grad = 0.0, np.zeros(len(names))
        for i, t in enumerate(self.terms):
            own = (seed + i * SEED_STEP) % (1 << 64)
            a, g = t.stochastic(v, names, fraction, own) if isinstance(t, NLL) else t.nll_with_gradient(v, names)
            total, grad = total + a, grad + g
        return total, grad

    def nll_many(self, points) -> np.ndarray:
        """At many points, a job or two per term instead of per point."""
        names = self.parameter_names()
        fixed = {p.name: p.value for p in self.layout.parameters if p.fixed}
        out = np.zeros(len(points))
        for t in self.terms:
            if isinstance(t, NLL):
                own = [p.name for p in t.parameters() if not p.fixed]
                cols = [[fixed.get(n, x[names.index(n)] if n in names else None) for n in own] for x in points]
                out += t.nll_many(cols, own)
            else:
                out += np.array([t.nll(self.layout.values(x)) for x in points])
        return out

    def bootstrap(self, seed: int) -> Likelihood:
        """The same with every data sample replicated."""
        return Likelihood([t.bootstrapped((seed + i * SEED_STEP) % (1 << 64)) for i, t in enumerate(self.terms)])

    def term(self, name: str) -> NLL:
        found = [t for t in self.terms if t.name == name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} terms are called {name}")
        return found[0]

    def projection(self, term: str, generated: Dataset, tags: Sequence[str] = (), corrected: bool = True) -> Projection:
        return Projection(self.term(term), generated, tuple(tags), corrected)

    cross_section_integrals = projection

    def diagnostics(self) -> list[dict]:
        out = []
        for t in self.terms:
            if isinstance(t, NLL):
                n = t.norm()
                out.append({"term": t.name, "strategy": n.strategy, "bases": len(n.terms), "reason": n.reason, "events": t.data.num_events(), "sum_weights": t.data.sum_weights()})
        return out


@dataclass
class Projection:
    """A fitted term over a generated sample: intensities, weights, acceptance, yields and cross sections.

    With tags only the chosen parts of the amplitude count. Acceptance correction scales by the full model's sums.
    """

    term: NLL
    generated: Dataset
    tags: tuple[str, ...] = ()
    corrected: bool = True

    def model(self) -> Expr:
        return self.term.model.project(*self.tags) if self.tags else self.term.model

    def intensities(self, values) -> DataFrame:
        """(_event_id, intensity) of every generated event."""
        low = Lowered(self.generated.frame, [simplify(self.model())], values)
        return low.frame.select(ID, low.pairs()[0].re.alias("intensity"))

    def weights(self, values) -> DataFrame:
        """(_event_id, weight): weight times intensity, scaled to the data if corrected."""
        scale = self.term.data.sum_weights() / self.full_accepted_integral(values) if self.corrected else 1.0
        low = Lowered(self.generated.frame, [simplify(self.model())], values)
        return low.frame.select(ID, (self.generated.weight * low.pairs()[0].re * scale).alias("weight"))

    def accepted_integral(self, values) -> float:
        return reduce(self.term.accepted, self.model(), REAL, values)[0]

    def generated_integral(self, values) -> float:
        return reduce(self.generated, self.model(), REAL, values)[0]

    def full_accepted_integral(self, values) -> float:
        return reduce(self.term.accepted, self.term.model, POSITIVE, values)[0]

    def data_weight_sum(self) -> float:
        return self.term.data.sum_weights()

    def acceptance(self, values) -> float:
        return self.accepted_integral(values) / self.generated_integral(values)

    def acceptance_corrected_yield(self, values) -> float:
        return self.data_weight_sum() * self.generated_integral(values) / self.full_accepted_integral(values)

    def observed_cross_section(self, values, luminosity: float) -> float:
        return self.acceptance_corrected_yield(values) / luminosity

    cross_section = observed_cross_section

    def fitted_cross_section(self, values, luminosity: float) -> float:
        if not self.term.extended:
            raise ValueError("a fitted cross section needs an extended term")
        return self.generated_integral(values) / luminosity


def total(frame: DataFrame, column: str) -> float:
    """The sum of a column, 0 over no rows."""
    return float(frame.agg(F.coalesce(F.sum(column), F.lit(0.0))).first()[0])


Objective = Callable[[np.ndarray], float]
