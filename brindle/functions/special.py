"""Special functions of amplitudes, as expressions; angular-momentum coefficients as numbers."""

from __future__ import annotations

import functools
import math
from fractions import Fraction

from ..plans.expr import Expr, cis, complex_

#: The default barrier radius in GeV, and the highest orbital angular momentum with a barrier.
Q_R, MAX_L = 0.1973, 8
PHYSICAL, UNPHYSICAL = "physical", "unphysical"
FULL, TENSOR = "full", "tensor"

# Denominators of the squared barrier factors, from the highest power of z down. The last number for L = 6
# is the reference results' own; 108056025 would make the factor 1 at z = 1, as for every other L.
BARRIER = {
    0: (1,),
    1: (1, 1),
    2: (1, 3, 9),
    3: (1, 6, 45, 225),
    4: (1, 10, 135, 1575, 11025),
    5: (1, 15, 315, 6300, 99225, 893025),
    6: (1, 21, 630, 18900, 496125, 9823275, 18261468225),
    7: (1, 28, 1134, 47250, 1819125, 58939650, 1404728325, 18261468225),
    8: (1, 36, 1890, 103950, 5457375, 255405150, 9833098275, 273922023375, 4108830350625),
}
#: The numerators' factors.
BARRIER_TOP = {0: 1, 1: 2, 2: 13, 3: 277, 4: 12746, 5: 998881, 6: 118394977, 7: 19727003738, 8: 4392846440677}


def legendre(l: int, m: int, x: Expr) -> Expr:
    """The associated Legendre function with the Condon-Shortley phase, m >= 0, by upward recurrence in l."""
    start = Expr.of(float((-1) ** m * math.prod(range(1, 2 * m, 2))))
    if m:
        root = 1.0 - x**2
        start = start * root ** (m // 2)
        if m % 2:
            start = start * root.sqrt()
    if l == m:
        return start
    before, now = start, float(2 * m + 1) * x * start
    for k in range(m + 2, l + 1):
        before, now = now, (float(2 * k - 1) * x * now - float(k + m - 1) * before) / float(k - m)
    return now


def spherical_harmonic(l: int, m: int, costheta, phi) -> Expr:
    """Y_l^m."""
    if l < 0 or abs(m) > l:
        raise ValueError(f"no spherical harmonic with l = {l}, m = {m}")
    x, phi, k = Expr.of(costheta), Expr.of(phi), abs(m)
    size = math.sqrt((2 * l + 1) / (4 * math.pi) * float(Fraction(math.factorial(l - k), math.factorial(l + k))))
    body = legendre(l, k, x) * (-size if m < 0 and k % 2 else size)
    return complex_(body * (float(m) * phi).cos(), body * (float(m) * phi).sin()) if m else body


def q(s, mass1, mass2, sheet: str = PHYSICAL) -> Expr:
    """Breakup momentum; the unphysical sheet has the other sign."""
    s, a, b = Expr.of(s), Expr.of(mass1), Expr.of(mass2)
    out = ((s - (a + b) ** 2) * (s - (a - b) ** 2)).sqrt() / (2.0 * s.sqrt())
    if sheet not in (PHYSICAL, UNPHYSICAL):
        raise ValueError(sheet)
    return out if sheet == PHYSICAL else -out


def rho(s, mass1, mass2, sheet: str = PHYSICAL) -> Expr:
    """Phase space 2 q / sqrt(s)."""
    s = Expr.of(s)
    return 2.0 * q(s, mass1, mass2, sheet) / s.sqrt()


def chew_mandelstam(s, mass1, mass2) -> Expr:
    """The loop function whose cut is the phase space: above threshold its imaginary part is minus rho.

    There the logarithm's argument is real and negative. It is turned by a right angle first, so that the side of the
    cut does not hang on the sign of a zero.
    """
    s, a, b = Expr.of(s), Expr.of(mass1), Expr.of(mass2)
    chi, r = 1.0 - (a + b) ** 2 / s, rho(s, a, b)
    log = (1j * ((chi + r) / (chi - r))).log() - 0.5j * math.pi
    return (r * log - chi * ((b - a) / (a + b)) * (b / a).log()) / math.pi


def blatt_weisskopf(q_, l: int, kind: str = FULL, q_r: float = Q_R) -> Expr:
    """Barrier factor; `tensor` leaves out q^l."""
    if not 0 <= l <= MAX_L:
        raise ValueError(f"barriers go from l = 0 to {MAX_L}")
    if not (q_r > 0 and math.isfinite(q_r)):
        raise ValueError("the radius must be positive and finite")
    p = Expr.of(q_)
    z = p**2 / q_r**2
    bottom = Expr.of(1.0)
    for c in BARRIER[l][1:]:
        bottom = bottom * z + float(c)
    full = (float(BARRIER_TOP[l]) * z**l / bottom).sqrt() if l else Expr.of(1.0)
    return full if kind == FULL else full / p**l if l else full


blatt_weisskopf_custom = blatt_weisskopf


def _twice(x) -> int:
    out = Fraction(x).limit_denominator(2) * 2
    if out.denominator != 1 or abs(float(out) - 2 * float(x)) > 1e-9:
        raise ValueError(f"{x} is no multiple of 1/2")
    return int(out)


@functools.cache
def _clebsch(j1: int, m1: int, j2: int, m2: int, j: int, m: int) -> float:
    """Doubled arguments; Racah's sum in exact integers, one square root at the end."""
    if m1 + m2 != m or not abs(j1 - j2) <= j <= j1 + j2 or (j1 + j2 + j) % 2:
        return 0.0
    if any(abs(b) > a or (a + b) % 2 for a, b in ((j1, m1), (j2, m2), (j, m))):
        return 0.0
    f = lambda n: math.factorial(n // 2)
    square = Fraction((j + 1) * f(j1 + j2 - j) * f(j1 - j2 + j) * f(-j1 + j2 + j), f(j1 + j2 + j + 2))
    square *= f(j1 + m1) * f(j1 - m1) * f(j2 + m2) * f(j2 - m2) * f(j + m) * f(j - m)
    total = Fraction(0)
    for k in range((j1 + j2 - j) // 2 + 1):
        terms = (2 * k, j1 + j2 - j - 2 * k, j1 - m1 - 2 * k, j2 + m2 - 2 * k, j - j2 + m1 + 2 * k, j - j1 - m2 + 2 * k)
        if min(terms) >= 0:
            total += Fraction((-1) ** k, math.prod(map(f, terms)))
    return math.copysign(math.sqrt(square * total * total), total) if total else 0.0


def clebsch_gordan(j1, m1, j2, m2, j, m) -> float:
    """<j1 m1 j2 m2 | j m>."""
    return _clebsch(*map(_twice, (j1, m1, j2, m2, j, m)))


def wigner_3j(j1, j2, j3, m1, m2, m3) -> float:
    a, b, c, x, y, z = map(_twice, (j1, j2, j3, m1, m2, m3))
    if x + y + z or (a - b - z) % 2:
        return 0.0
    return (-1) ** ((a - b - z) // 2) * _clebsch(a, x, b, y, c, -z) / math.sqrt(c + 1)


class WignerD:
    """Rotation matrix elements d^j_{m' m} and D^j_{m' m}."""

    def __init__(self, j, mp, m):
        self.j, self.mp, self.m = _twice(j), _twice(mp), _twice(m)
        if self.j < 0 or any(abs(k) > self.j or (self.j - k) % 2 for k in (self.mp, self.m)):
            raise ValueError(f"no rotation element with j = {j}, m' = {mp}, m = {m}")

    def d(self, beta) -> Expr:
        """A sum over powers of the cosine and sine of half the angle."""
        half = Expr.of(beta) / 2.0
        c, s = half.cos(), half.sin()
        j, a, b = self.j, self.mp, self.m
        f = lambda n: math.factorial(n // 2)
        size = math.sqrt(f(j + a) * f(j - a) * f(j + b) * f(j - b))
        out = None
        for k in range(j + 1):
            parts = (j + b - 2 * k, 2 * k, a - b + 2 * k, j - a - 2 * k)
            if min(parts) < 0:
                continue
            sign = (-1) ** ((a - b) // 2 + k)
            term = sign * size / math.prod(map(f, parts)) * c ** (j + (b - a) // 2 - 2 * k) * s ** ((a - b) // 2 + 2 * k)
            out = term if out is None else out + term
        return out

    def D(self, alpha, beta, gamma) -> Expr:  # noqa: N802
        phase = -(self.mp / 2.0 * Expr.of(alpha) + self.m / 2.0 * Expr.of(gamma))
        return cis(phase) * self.d(beta)
