"""Fits and sampling on the driver; every evaluation of a likelihood is at most a job or two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .cross_section import Ensemble
from .likelihood import Likelihood

Callback = Callable[[int, np.ndarray, float], bool | None]


@dataclass
class FitResult:
    x: np.ndarray
    value: float
    gradient: np.ndarray
    iterations: int
    converged: bool
    message: str


class _Scaled:
    """Parameters divided by their scales, periodic ones unbounded."""

    def __init__(self, likelihood: Likelihood):
        self.likelihood = likelihood
        free = likelihood.layout.free()
        self.scale = np.array([p.scale for p in free])
        inf = np.inf
        self.lo = np.array([-inf if p.periodic or p.bounds[0] is None else p.bounds[0] for p in free]) / self.scale
        self.hi = np.array([inf if p.periodic or p.bounds[1] is None else p.bounds[1] for p in free]) / self.scale

    def clip(self, z: np.ndarray) -> np.ndarray:
        return np.clip(z, self.lo, self.hi)

    def both(self, z: np.ndarray) -> tuple[float, np.ndarray]:
        try:
            v, g = self.likelihood.value_and_gradient(z * self.scale)
        except ArithmeticError:
            return np.inf, np.zeros(len(z))
        return v, g * self.scale

    def value(self, z: np.ndarray) -> float:
        try:
            return self.likelihood.nll(z * self.scale)
        except ArithmeticError:
            return np.inf


def lbfgsb(f: _Scaled, z: np.ndarray, memory: int = 10, tolerance: float = 1e-7, limit: int = 200, callback: Callback | None = None) -> FitResult:
    """Projected L-BFGS: steps over the free coordinates, those at a bound that the gradient pushes against held."""
    z = f.clip(z)
    v, g = f.both(z)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for k in range(limit):
        held = ((z <= f.lo) & (g > 0)) | ((z >= f.hi) & (g < 0))
        if np.abs(np.where(held, 0, z - f.clip(z - g))).max(initial=0) < tolerance * max(1.0, abs(v)) ** 0.5:
            return FitResult(z * f.scale, v, g / f.scale, k, True, "the gradient is small")
        d = np.where(held, 0, g)
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = s @ d / (y @ s)
            alphas.append(a)
            d = d - a * y
        if s_list:
            d = d * (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            d = d + (a - y @ d / (y @ s)) * s
        d = -np.where(held, 0, d)
        if d @ g >= 0:
            d, s_list, y_list = -np.where(held, 0, g), [], []
        step = 1.0 if s_list else min(1.0, 1.0 / max(np.abs(d).sum(), 1e-300))
        for _ in range(40):
            new = f.clip(z + step * d)
            nv, ng = f.both(new)
            if nv <= v + 1e-4 * (g @ (new - z)):
                break
            step /= 2
        else:
            return FitResult(z * f.scale, v, g / f.scale, k, False, "no step lowers the value")
        s, y = new - z, ng - g
        done = abs(v - nv) <= 1e-12 * max(1.0, abs(v))
        z, v, g = new, nv, ng
        if s @ y > 1e-12 * (y @ y):
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        if callback and callback(k, z * f.scale, v):
            return FitResult(z * f.scale, v, g / f.scale, k + 1, False, "stopped by the callback")
        if done:
            return FitResult(z * f.scale, v, g / f.scale, k + 1, True, "the value no longer changes")
    return FitResult(z * f.scale, v, g / f.scale, limit, False, "too many steps")


def nelder_mead(f: _Scaled, z: np.ndarray, tolerance: float = 1e-8, limit: int = 2000, callback: Callback | None = None) -> FitResult:
    n = len(z)
    points = [f.clip(z)] + [f.clip(z + np.eye(n)[i] * (0.1 * abs(z[i]) or 0.1)) for i in range(n)]
    points = [p if i == 0 or not np.array_equal(p, points[0]) else f.clip(z - np.eye(n)[i - 1] * (0.1 * abs(z[i - 1]) or 0.1)) for i, p in enumerate(points)]
    simplex = sorted(((f.value(p), p) for p in points), key=lambda x: x[0])
    k = 0
    for k in range(limit):
        if abs(simplex[-1][0] - simplex[0][0]) <= tolerance * max(1.0, abs(simplex[0][0])) and max(np.abs(p - simplex[0][1]).max() for _, p in simplex[1:]) < 1e-5:
            break
        centre = np.mean([p for _, p in simplex[:-1]], axis=0)
        worst = simplex[-1]
        at = lambda t, centre=centre, worst=worst: (lambda p: (f.value(p), p))(f.clip(centre + t * (centre - worst[1])))
        r = at(1.0)
        if r[0] < simplex[0][0]:
            e = at(2.0)
            simplex[-1] = e if e[0] < r[0] else r
        elif r[0] < simplex[-2][0]:
            simplex[-1] = r
        else:
            c = at(0.5 if r[0] < worst[0] else -0.5)
            if c[0] < min(r[0], worst[0]):
                simplex[-1] = c
            else:
                best = simplex[0][1]
                simplex = [simplex[0]] + [(f.value(q), q) for q in (f.clip(best + 0.5 * (p - best)) for _, p in simplex[1:])]
        simplex.sort(key=lambda x: x[0])
        if callback and callback(k, simplex[0][1] * f.scale, simplex[0][0]):
            break
    v, p = simplex[0]
    return FitResult(p * f.scale, v, np.full(n, np.nan), k + 1, k + 1 < limit, "the simplex is small" if k + 1 < limit else "too many steps")


def fit(likelihood: Likelihood, start=None, method: str = "lbfgsb", callback: Callback | None = None, **options) -> FitResult:
    """The smallest value from a start (the defaults)."""
    f = _Scaled(likelihood)
    z = (likelihood.default_parameters() if start is None else np.asarray(start, float)) / f.scale
    out = {"lbfgsb": lbfgsb, "nelder_mead": nelder_mead}[method](f, z, callback=callback, **options)
    out.x = likelihood.layout.wrap(out.x)
    return out


def fit_restarts(likelihood: Likelihood, n: int, seed: int = 0, **options) -> list[FitResult]:
    """Fits from n random starts, the best first."""
    rng = np.random.default_rng(seed)
    return sorted((fit(likelihood, likelihood.layout.sample(rng), **options) for _ in range(n)), key=lambda r: r.value)


def fit_stochastic(likelihood: Likelihood, start=None, fraction: float = 0.1, steps: int = 100, rate: float = 0.05, seed: int = 0, callback: Callback | None = None) -> FitResult:
    """Adam on hash samples of the data, a new one each step."""
    f = _Scaled(likelihood)
    z = f.clip((likelihood.default_parameters() if start is None else np.asarray(start, float)) / f.scale)
    m, v = np.zeros(len(z)), np.zeros(len(z))
    value, grad = np.inf, m
    for k in range(1, steps + 1):
        value, grad = likelihood.stochastic_value_and_gradient(z * f.scale, fraction, seed + k)
        g = grad * f.scale
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = f.clip(z - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8))
        if callback and callback(k, z * f.scale, value):
            break
    return FitResult(likelihood.layout.wrap(z * f.scale), value, grad, k, True, "all steps done")


def bootstrap_fit(likelihood: Likelihood, n: int, seed: int = 0, **options) -> Ensemble:
    return Ensemble.bootstrap_fit(likelihood, lambda x: fit(x, **options).x, n, seed)


def walker_positions(likelihood: Likelihood, n: int, seed: int = 0, around=None, spread: float = 1e-2) -> np.ndarray:
    """Starts for an ensemble of walkers: random points, or a cloud about one."""
    rng = np.random.default_rng(seed)
    if around is None:
        return np.array([likelihood.layout.sample(rng) for _ in range(n)])
    scale = np.array([p.scale for p in likelihood.layout.free()])
    return np.asarray(around) + spread * scale * rng.standard_normal((n, len(scale)))


def sample(likelihood: Likelihood, walkers: np.ndarray, steps: int, seed: int = 0, stretch: float = 2.0) -> np.ndarray:
    """Affine-invariant ensemble sampling; half of the walkers move at once, and their likelihoods are one job.

    Returns (steps, walkers, parameters).
    """
    rng = np.random.default_rng(seed)
    x = np.array(walkers, float)
    n, d = x.shape
    if n < 2 * d or n % 2:
        raise ValueError("an even number of walkers, at least twice the parameters")

    def density(points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), -np.inf)
        good = [i for i, p in enumerate(points) if likelihood.layout.inside(p)]
        if good:
            try:
                out[good] = -likelihood.nll_many([points[i] for i in good])
            except ArithmeticError:
                for i in good:
                    try:
                        out[i] = -likelihood.nll(points[i])
                    except ArithmeticError:
                        pass
        return out

    logp = density(x)
    chain = np.zeros((steps, n, d))
    for k in range(steps):
        for half in (np.arange(n // 2), np.arange(n // 2, n)):
            other = np.setdiff1d(np.arange(n), half)
            z = ((stretch - 1) * rng.random(len(half)) + 1) ** 2 / stretch
            partner = x[rng.choice(other, len(half))]
            move = partner + z[:, None] * (x[half] - partner)
            new = density(move)
            take = np.log(rng.random(len(half))) < (d - 1) * np.log(z) + new - logp[half]
            x[half[take]], logp[half[take]] = move[take], new[take]
        chain[k] = x
    return chain
