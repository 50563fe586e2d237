"""Resonance shapes: Breit-Wigner forms, K-matrices with cleared denominators, and fixed parameterisations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

from ..plans.expr import Expr, ShapeError, matmul, matrix_from_flat, solve, vector
from .special import Q_R, blatt_weisskopf, chew_mandelstam, q


def breit_wigner(s, mass, width) -> Expr:
    """1 / (m^2 - s - i m width)."""
    m, w = Expr.of(mass), Expr.of(width)
    return 1.0 / (m**2 - s - 1j * m * w)


def relativistic_breit_wigner(s, mass, width, mass1, mass2, l: int, barriers: bool = True, q_r: float = Q_R) -> Expr:
    """A width that runs with the breakup momentum, by barrier factors or a plain power."""
    s, m = Expr.of(s), Expr.of(mass)
    here, there = q(s, mass1, mass2), q(m**2, mass1, mass2)
    running = Expr.of(width) * (m / s.sqrt())
    if barriers:
        running = running * (here / there) * (blatt_weisskopf(here, l, q_r=q_r) / blatt_weisskopf(there, l, q_r=q_r)) ** 2
    else:
        running = running * (here / there) ** (2 * l + 1)
    return 1.0 / (m**2 - s - 1j * m * running)


relativistic_breit_wigner_custom = relativistic_breit_wigner


def _vector(x) -> Expr:
    e = vector(x) if isinstance(x, (list, tuple, np.ndarray)) else Expr.of(x)
    if len(e.shape) != 1:
        raise ShapeError(f"a vector is needed, not shape {e.shape}")
    return e


def _matrix(x, rows: int, cols: int) -> Expr:
    e = matrix_from_flat(rows, cols, [v for r in x for v in r]) if isinstance(x, (list, tuple, np.ndarray)) else Expr.of(x)
    if e.shape != (rows, cols):
        raise ShapeError(f"shape {(rows, cols)} is needed, not {e.shape}")
    return e


def blatt_weisskopf_barriers(s, channel_mass_1, channel_mass_2, pole_masses, l: int, q_r: float = Q_R) -> Expr:
    """Channels by poles: the barrier at s over that at the pole."""
    a, b, poles = _vector(channel_mass_1), _vector(channel_mass_2), _vector(pole_masses)
    if a.shape != b.shape:
        raise ShapeError("both daughters of every channel need a mass")
    out = []
    for c in range(a.shape[0]):
        top = blatt_weisskopf(q(s, a[c], b[c]), l, q_r=q_r)
        out += [top / blatt_weisskopf(q(poles[k] ** 2, a[c], b[c]), l, q_r=q_r) for k in range(poles.shape[0])]
    return matrix_from_flat(a.shape[0], poles.shape[0], out)


def _products(s, poles: Expr) -> tuple[Expr, list[Expr]]:
    """The product of all m^2 - s, and those that leave one out."""
    gaps = [poles[k] ** 2 - s for k in range(poles.shape[0])]

    def times(items: Sequence[Expr]) -> Expr:
        out = Expr.of(1.0)
        for x in items:
            out = out * x
        return out

    return times(gaps), [times(gaps[:k] + gaps[k + 1 :]) for k in range(len(gaps))]


def k_matrix(s, pole_masses, couplings, barriers, background=None) -> Expr:
    """The K-matrix times the product of all m^2 - s."""
    poles = _vector(pole_masses)
    n = poles.shape[0]
    channels = Expr.of(barriers).shape[0]
    g, b = _matrix(couplings, channels, n), Expr.of(barriers)
    every, but_one = _products(s, poles)
    bg = None if background is None else _matrix(background, channels, channels)
    cells = []
    for i in range(channels):
        for j in range(channels):
            cell = Expr.of(0.0)
            for k in range(n):
                cell = cell + b[i, k] * b[j, k] * g[i, k] * g[j, k] * but_one[k]
            cells.append(cell if bg is None else cell + bg[i, j] * every)
    return matrix_from_flat(channels, channels, cells)


def p_vector(s, pole_masses, production, couplings, barriers, background=None) -> Expr:
    """The production vector times the product of all m^2 - s."""
    poles, beta = _vector(pole_masses), _vector(production)
    if beta.shape != poles.shape:
        raise ShapeError("one production amplitude for each pole")
    b = Expr.of(barriers)
    channels = b.shape[0]
    g = _matrix(couplings, channels, poles.shape[0])
    every, but_one = _products(s, poles)
    bg = None if background is None else _vector(background)
    cells = []
    for i in range(channels):
        cell = Expr.of(0.0)
        for k in range(poles.shape[0]):
            cell = cell + beta[k] * b[i, k] * g[i, k] * but_one[k]
        cells.append(cell if bg is None else cell + bg[i] * every)
    return vector(cells)


def f_vector(s, pole_masses, k, p, phase_space) -> Expr:
    """The channels' amplitudes: solves (product + K C) F = P."""
    poles, k, p, c = _vector(pole_masses), Expr.of(k), _vector(p), Expr.of(phase_space)
    n = p.shape[0]
    if k.shape != (n, n) or c.shape != (n, n):
        raise ShapeError("K and the phase space are square, of the channels' number")
    every, _ = _products(s, poles)
    kc = matmul(k, c)
    cells = [kc[i, j] + every if i == j else kc[i, j] for i in range(n) for j in range(n)]
    return solve(matrix_from_flat(n, n, cells), p)


# Masses in GeV of the pion, the charged and neutral kaon, the eta and the eta'.
PI, K_PLUS, K_ZERO, ETA, ETA_PRIME = 0.1349768, 0.493677, 0.497611, 0.547862, 0.95778


@dataclass(frozen=True)
class Resonances:
    """A fixed coupled-channel parameterisation: couplings by channel and pole, background, masses, barrier order."""

    channels: tuple[str, ...]
    masses: tuple[tuple[float, float], ...]
    poles: tuple[float, ...]
    couplings: tuple[tuple[float, ...], ...]
    background: tuple[tuple[float, ...], ...]
    l: int
    adler: tuple[float, float] | None = None

    def amplitude(self, s, production: Sequence) -> Expr:
        """The vector of channel amplitudes for a production amplitude per pole."""
        s = Expr.of(s)
        n = len(self.channels)
        b = blatt_weisskopf_barriers(s, [m[0] for m in self.masses], [m[1] for m in self.masses], self.poles, self.l)
        bg = []
        for i in range(n):
            for j in range(n):
                cell = Expr.of(0.0)
                for k in range(len(self.poles)):
                    cell = cell + b[i, k] * self.background[i][j] * b[j, k]
                bg.append(cell)
        k = k_matrix(s, self.poles, self.couplings, b, matrix_from_flat(n, n, bg))
        if self.adler:
            k = ((s - self.adler[0]) / self.adler[1]) * k
        p = p_vector(s, self.poles, list(production), self.couplings, b)
        loop = [chew_mandelstam(s, *self.masses[i]) if i == j else Expr.of(0.0) for i in range(n) for j in range(n)]
        return f_vector(s, self.poles, k, p, matrix_from_flat(n, n, loop))

    def resampled(self, covariance, seed: int) -> Resonances:
        """Parameters drawn from a normal distribution about the nominal ones. The covariance is a parameter, in the order
        couplings, background (both column by column), pole masses, Adler zero; rows of zeros stay fixed."""
        g, bg = np.array(self.couplings), np.array(self.background)
        mean = np.concatenate([g.ravel("F"), bg.ravel("F"), self.poles, [self.adler[0]] if self.adler else []])
        cov = np.asarray(covariance, float)
        if cov.shape != (len(mean), len(mean)):
            raise ShapeError(f"a covariance of {len(mean)} parameters is needed")
        live = np.flatnonzero(np.any(cov != 0, axis=1))
        x = mean.copy()
        if len(live):
            x[live] += np.linalg.cholesky(cov[np.ix_(live, live)]) @ np.random.default_rng(seed).standard_normal(len(live))
        a, c = g.size, bg.size
        rows = lambda v, shape: tuple(map(tuple, v.reshape(shape, order="F").tolist()))
        adler = (float(x[-1]), self.adler[1]) if self.adler else None
        return replace(self, couplings=rows(x[:a], g.shape), background=rows(x[a : a + c], bg.shape), poles=tuple(x[a + c : a + c + len(self.poles)].tolist()), adler=adler)


# Published coupled-channel parameters of light mesons.
F0 = Resonances(
    ("pi pi", "4 pi", "K Kbar", "eta eta", "eta eta'"),
    ((PI, PI), (2 * PI, 2 * PI), (K_PLUS, K_ZERO), (ETA, ETA), (ETA, ETA_PRIME)),
    (0.51461, 0.90630, 1.23089, 1.46104, 1.69611),
    (
        (0.74987, 0.06401, -0.23417, 0.01270, -0.14242),
        (-0.01257, 0.00204, -0.01032, 0.26700, 0.22780),
        (0.27536, 0.77413, 0.72283, 0.09214, 0.15981),
        (-0.15102, 0.50999, 0.11934, 0.02742, 0.16272),
        (0.36103, 0.13112, 0.36792, -0.04025, -0.17397),
    ),
    (
        (0.03728, 0.0, -0.01398, -0.02203, 0.01397),
        (0.0, 0.0, 0.0, 0.0, 0.0),
        (-0.01398, 0.0, 0.02349, 0.03101, -0.04003),
        (-0.02203, 0.0, 0.03101, -0.13769, -0.06722),
        (0.01397, 0.0, -0.04003, -0.06722, -0.28401),
    ),
    0,
    (0.0091125, 1.0),
)
F2 = Resonances(
    ("pi pi", "4 pi", "K Kbar", "eta eta"),
    ((PI, PI), (2 * PI, 2 * PI), (K_PLUS, K_ZERO), (ETA, ETA)),
    (1.15299, 1.48359, 1.72923, 1.96700),
    ((0.40033, 0.01820, -0.06709, -0.49924), (0.15479, 0.17300, 0.22941, 0.19295), (-0.08900, 0.32393, -0.43133, 0.27975), (-0.00113, 0.15256, 0.23721, -0.03987)),
    ((-0.04319, 0.0, 0.00984, 0.01028), (0.0, 0.0, 0.0, 0.0), (0.00984, 0.0, -0.07344, 0.05533), (0.01028, 0.0, 0.05533, -0.05183)),
    2,
)
A0 = Resonances(("pi eta", "K Kbar"), ((PI, ETA), (K_PLUS, K_ZERO)), (0.95395, 1.26767), ((0.43215, 0.19000), (-0.28825, 0.43372)), ((0.0, 0.0), (0.0, 0.0)), 0)
A2 = Resonances(
    ("pi eta", "K Kbar", "pi eta'"),
    ((PI, ETA), (K_PLUS, K_ZERO), (PI, ETA_PRIME)),
    (1.30080, 1.75351),
    ((0.30073, 0.68567), (0.21426, 0.12543), (-0.09162, 0.00184)),
    ((-0.40184, 0.00033, -0.08707), (0.00033, -0.21416, -0.06193), (-0.08707, -0.06193, -0.17435)),
    2,
)
RHO = Resonances(
    ("pi pi", "4 pi", "K Kbar"),
    ((PI, PI), (2 * PI, 2 * PI), (K_PLUS, K_ZERO)),
    (0.71093, 1.58660),
    ((0.28023, 0.16318), (0.01806, 0.53879), (0.06501, 0.00495)),
    ((-0.06948, 0.0, 0.07958), (0.0, 0.0, 0.0), (0.07958, 0.0, -0.6)),
    1,
)
PI1 = Resonances(("pi eta", "pi eta'"), ((PI, ETA), (PI, ETA_PRIME)), (1.38552,), ((0.80564,), (1.04595,)), ((1.05, 0.15163), (0.15163, -0.24611)), 1)


def kopf_f0(s, production) -> Expr:
    return F0.amplitude(s, production)


def kopf_f2(s, production) -> Expr:
    return F2.amplitude(s, production)


def kopf_a0(s, production) -> Expr:
    return A0.amplitude(s, production)


def kopf_a2(s, production) -> Expr:
    return A2.amplitude(s, production)


def kopf_rho(s, production) -> Expr:
    return RHO.amplitude(s, production)


def kopf_pi1(s, production) -> Expr:
    return PI1.amplitude(s, production)


def width_to_coupling(mass: float, width: float) -> float:
    """The coupling of a narrow pole with a width."""
    return math.sqrt(mass * width)
