"""Cross sections with uncertainty ensembles: totals, differential ones, and pooled periods."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from ..dataset import Dataset, query
from ..plans.expr import Expr
from ..plans.lower import Lowered
from ..plans.rewrite import simplify
from .binning import Bins
from .likelihood import NLL, Likelihood
from .reduce import GROUP
from .sampling import splitmix64_np

_source = itertools.count(1)


@dataclass
class Ensemble:
    """Parameter points (draws by parameters); those of one source belong together."""

    names: list[str]
    draws: np.ndarray
    source: int = field(default_factory=lambda: next(_source))

    def __post_init__(self):
        self.draws = np.atleast_2d(np.asarray(self.draws, float))
        if self.draws.shape[1] != len(self.names):
            raise ValueError("one column for each parameter")

    def __len__(self):
        return len(self.draws)

    @classmethod
    def from_chain(cls, names: Sequence[str], chain, discard: int = 0, thin: int = 1) -> Ensemble:
        """A chain (steps, walkers, parameters) without its start, every thin-th step."""
        c = np.asarray(chain, float)[discard::thin]
        return cls(list(names), c.reshape(-1, c.shape[-1]))

    @classmethod
    def bootstrap_fit(cls, likelihood: Likelihood, fit: Callable[[Likelihood], np.ndarray], n: int, seed: int = 0, at_once: int = 8) -> Ensemble:
        """The best point of each of n replicas of the data; `at_once` fits submit their jobs side by side."""
        for t in likelihood.terms:
            if isinstance(t, NLL):
                t.norm()  # one normalisation for all replicas
        with ThreadPoolExecutor(max(1, min(at_once, n))) as pool:
            return cls(likelihood.parameter_names(), list(pool.map(lambda i: fit(likelihood.bootstrap(seed + i)), range(n))))


def _pair(a: Estimate, b: Estimate) -> tuple[np.ndarray, np.ndarray]:
    """Draws in pairs: by index within one source, else by a fixed scramble, so that they are not correlated."""
    n = min(len(a.draws), len(b.draws)) or max(len(a.draws), len(b.draws))
    x = a.draws[:n] if len(a.draws) else np.full(n, a.central)
    y = b.draws if len(b.draws) else np.full(n, b.central)
    if a.source != b.source and len(a.draws) and len(b.draws):
        y = y[np.argsort(splitmix64_np(np.arange(len(y)) + (a.source * 1_000_003 + b.source)), kind="stable")]
    return x, y[:n]


@dataclass
class Estimate:
    """A central value and the values of an ensemble's draws."""

    central: float
    draws: np.ndarray = field(default_factory=lambda: np.zeros(0))
    source: int = 0

    def __post_init__(self):
        self.draws = np.asarray(self.draws, float)

    def mean(self) -> float:
        return float(self.draws.mean())

    def std(self) -> float:
        return float(self.draws.std(ddof=1))

    def quantile(self, p: float) -> float:
        """By linear interpolation between sorted draws."""
        return float(np.quantile(self.draws, p))

    def median(self) -> float:
        return self.quantile(0.5)

    def interval(self, level: float = 0.6827) -> tuple[float, float]:
        return self.quantile((1 - level) / 2), self.quantile((1 + level) / 2)

    def _with(self, o, f) -> Estimate:
        o = o if isinstance(o, Estimate) else Estimate(float(o))
        x, y = _pair(self, o)
        source = self.source if self.source == o.source or not len(o.draws) else next(_source)
        return Estimate(f(self.central, o.central), f(x, y), source)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: np.divide(a, b))


@dataclass
class BinnedEstimate:
    """Central values by bin, and draws (draws by bins)."""

    central: np.ndarray
    draws: np.ndarray
    source: int = 0

    def interval(self, level: float = 0.6827) -> tuple[np.ndarray, np.ndarray]:
        return np.quantile(self.draws, (1 - level) / 2, axis=0), np.quantile(self.draws, (1 + level) / 2, axis=0)

    def covariance(self) -> np.ndarray:
        """Of the bins, row by row of the shape, over the draws (n - 1)."""
        return np.atleast_2d(np.cov(self.draws.reshape(len(self.draws), -1), rowvar=False))


@dataclass
class Axis:
    """A coordinate and its bins, right-open; events outside do not count."""

    expr: Expr
    edges: Sequence[float]

    def bins(self) -> Bins:
        return Bins(tuple(self.edges))


def binned_sums(ds: Dataset, axes: Sequence[Axis], models: Sequence[Expr] = (), values=None) -> np.ndarray:
    """(1 + models, *shape): weights, and weight times each model, by bin: one aggregate keyed by the flat bin."""
    roots = [query(a.expr, real=True) for a in axes]
    low = Lowered(ds.frame, [*roots, *[simplify(m) for m in models]], values)
    pairs = low.pairs()
    shape = tuple(len(a.bins()) for a in axes)
    flat = F.lit(0)
    for a, p in zip(axes, pairs, strict=False):
        flat = flat * len(a.bins()) + a.bins().index(p.re)
    sums = [F.sum(ds.weight).alias("s0")] + [F.sum(ds.weight * p.re).alias(f"s{i}") for i, p in enumerate(pairs[len(axes) :], 1)]
    out = np.zeros((len(sums), math.prod(shape)))
    for r in low.frame.withColumn("__bin", flat).where("__bin is not null").groupBy("__bin").agg(*sums).collect():
        out[:, r["__bin"]] = [r[f"s{i}"] for i in range(len(sums))]
    return out.reshape(len(sums), *shape)


def _fixed(model: Expr, values: dict[str, float]) -> Expr:
    """The model at a parameter point."""
    return model.fix(**{p.name: values[p.name] for p in model.parameters() if p.name in values})


def histogram_nd(ds: Dataset, axes: Sequence[Axis]) -> np.ndarray:
    return binned_sums(ds, axes)[0]


def volumes(axes: Sequence[Axis]) -> np.ndarray:
    out = np.ones(())
    for a in axes:
        out = np.multiply.outer(out, a.bins().widths)
    return out


def ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Top over bottom, NaN where the bottom is not positive."""
    top, bottom = np.broadcast_arrays(top, bottom)
    return np.divide(top, bottom, out=np.full(bottom.shape, np.nan), where=bottom > 0)


@dataclass
class Differential:
    axes: list[Axis]
    data: BinnedEstimate
    model: BinnedEstimate
    components: dict[str, BinnedEstimate]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(a.bins()) for a in self.axes)

    def edges(self, k: int = 0) -> np.ndarray:
        return np.array(self.axes[k].edges)


@dataclass
class CrossSection:
    """A fitted term with its generated sample, luminosity and parameters; an ensemble gives uncertainties."""

    term: NLL
    generated: Dataset
    luminosity: float
    values: dict[str, float]
    ensemble: Ensemble | None = None

    def __post_init__(self):
        if not (self.luminosity > 0 and math.isfinite(self.luminosity)):
            raise ValueError("a luminosity is positive")

    def _points(self) -> list[dict[str, float]]:
        out = [self.values]
        if self.ensemble:
            out += [{**self.values, **dict(zip(self.ensemble.names, map(float, d), strict=True))} for d in self.ensemble.draws]
        return out

    def _integrals(self, ds: Dataset, tags: Sequence[str] = ()) -> np.ndarray:
        """The model's sum at every point: from sufficient statistics where the model is separable, else one job for all."""
        from .likelihood import Normalization
        from .reduce import many

        model = self.term.model.project(*tags) if tags else self.term.model
        norm = Normalization(ds, model)
        points = self._points()
        if norm.rest is None:
            return np.array([norm.value(p)[0] for p in points])
        names = [p.name for p in model.parameters() if not p.fixed]
        return many(ds, model, [[p[n] for n in names] for p in points], names)

    def _estimate(self, v: np.ndarray) -> Estimate:
        return Estimate(float(v[0]), v[1:], self.ensemble.source if self.ensemble else 0)

    def acceptance(self, tags: Sequence[str] = ()) -> Estimate:
        return self._estimate(self._integrals(self.term.accepted, tags) / self._integrals(self.generated, tags))

    def corrected_yield(self, tags: Sequence[str] = ()) -> Estimate:
        return self._estimate(self.term.data.sum_weights() * self._integrals(self.generated, tags) / self._integrals(self.term.accepted))

    def observed_total(self, tags: Sequence[str] = ()) -> Estimate:
        return self.corrected_yield(tags) / self.luminosity

    total = observed_total

    def fitted_total(self, tags: Sequence[str] = ()) -> Estimate:
        if not self.term.extended:
            raise ValueError("a fitted cross section needs an extended term")
        return self._estimate(self._integrals(self.generated, tags) / self.luminosity)

    def differential(self, axes: Sequence[Axis], components: dict[str, Sequence[str]] | None = None) -> Differential:
        """Per unit of the axes. data: counts over acceptance; model: W generated / accepted; components likewise with the
        full accepted sum, so that they add up as the model's parts do."""
        axes, parts = list(axes), dict(components or {})
        vol = volumes(axes)
        data = histogram_nd(self.term.data, axes)
        model = self.term.model
        chosen = [model.project(*t) for t in parts.values()]
        w = self.term.data.sum_weights()
        rows: dict[str, list[np.ndarray]] = {k: [] for k in ("__data", "__model", *parts)}
        full = self._integrals(self.term.accepted)
        points, step = self._points(), max(1, GROUP // (1 + len(parts)))
        for at in range(0, len(points), step):  # a group of draws is one pass over each sample
            group = points[at : at + step]
            gens = binned_sums(self.generated, axes, [_fixed(m, p) for p in group for m in (model, *chosen)])[1:]
            accs = binned_sums(self.term.accepted, axes, [_fixed(model, p) for p in group])[1:]
            for k in range(len(group)):
                gen = gens[k * (1 + len(parts)) : (k + 1) * (1 + len(parts))]
                scale = w / full[at + k] / (self.luminosity * vol)
                rows["__data"].append(ratio(data * gen[0], accs[k]) / (self.luminosity * vol))
                rows["__model"].append(gen[0] * scale)
                for name, g in zip(parts, gen[1:], strict=True):
                    rows[name].append(g * scale)
        source = self.ensemble.source if self.ensemble else 0
        made = {k: BinnedEstimate(v[0], np.array(v[1:]), source) for k, v in rows.items()}
        return Differential(axes, made.pop("__data"), made.pop("__model"), made)


def combine(sections: Sequence[CrossSection], axes: Sequence[Axis], factors: Sequence[float] | None = None) -> np.ndarray:
    """Several periods pooled: the sum of yields over that of exposures (luminosity, factor, acceptance), per volume."""
    factors = [1.0] * len(sections) if factors is None else list(factors)
    top = bottom = 0.0
    for s, f in zip(sections, factors, strict=True):
        gen = binned_sums(s.generated, axes, [s.term.model], s.values)[1]
        acc = binned_sums(s.term.accepted, axes, [s.term.model], s.values)[1]
        top = top + histogram_nd(s.term.data, axes)
        bottom = bottom + s.luminosity * f * np.nan_to_num(ratio(acc, gen))
    return ratio(np.asarray(top), np.asarray(bottom)) / volumes(axes)


def combined_total(sections: Sequence[CrossSection], factors: Sequence[float] | None = None) -> Estimate:
    factors = [1.0] * len(sections) if factors is None else list(factors)
    exposure = None
    for s, f in zip(sections, factors, strict=True):
        e = s.acceptance() * (s.luminosity * f)
        exposure = e if exposure is None else exposure + e
    return Estimate(sum(s.term.data.sum_weights() for s in sections)) / exposure
