"""Counter-based sampling: a hash of seed and event id gives each event its uniform number, whatever the partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it: a one-element array's transform binds the value. Written out
    in place, each step would double the plan several times."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]


def _joined(limbs: list[Column]) -> Column:
    """Sixteen-bit columns with carries, back to a long; the bits beyond 64 go. No step overflows, so ANSI mode is fine."""
    out, carry = None, F.lit(0).cast("long")
    for k, x in enumerate(limbs):
        x = x + carry
        low = F.shiftleft(x.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * k)
        out = low if out is None else out.bitwiseOR(low)
        carry = F.shiftrightunsigned(x, 16)
    return out


def wrapping_add(x: Column, c: int) -> Column:
    return _let(x, lambda v: _joined([a + ((c >> 16 * k) & 0xFFFF) for k, a in enumerate(_limbs(v))]))


def wrapping_mul(x: Column, c: int) -> Column:
    return _let(x, lambda v: _product(v, c))


def _product(x: Column, c: int) -> Column:
    a, b = _limbs(x), [(c >> 16 * k) & 0xFFFF for k in range(4)]
    rows = []
    for k in range(4):
        total = None
        for i in range(k + 1):
            part = a[i] * b[k - i]
            total = part if total is None else total + part
        rows.append(total)
    return _joined(rows)


def splitmix64(x: Column) -> Column:
    """One output of the splitmix64 generator at state x, in built-in functions."""
    z = wrapping_add(x, GOLDEN)
    for shift, c in zip((30, 27), MIX, strict=True):
        z = wrapping_mul(_folded(z, shift), c)
    return _folded(z, 31)


def _folded(z: Column, shift: int) -> Column:
    return _let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))


def splitmix64_np(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + np.uint64(GOLDEN)
        for shift, c in zip((30, 27), MIX, strict=True):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(c)
        return z ^ (z >> np.uint64(31))


def uniform01(seed: int, event_id: Column) -> Column:
    """In [0, 1): the hash's upper 53 bits."""
    h = splitmix64(event_id.cast("long").bitwiseXOR(F.lit(_signed(seed & MASK)).cast("long")))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def uniform01_np(seed: int, event_id: np.ndarray) -> np.ndarray:
    h = splitmix64_np(np.asarray(event_id).astype(np.uint64) ^ np.uint64(seed & MASK))
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_table() -> list[float]:
    """Cumulative probabilities of Poisson(1) as doubles, up to where they no longer grow."""
    out, p, total = [], math.exp(-1.0), 0.0
    k = 0
    while True:
        total += p
        if out and total == out[-1]:
            return out
        out.append(total)
        k += 1
        p /= k


def poisson1(u: Column) -> Column:
    """The Poisson(1) count at a uniform number: the first k whose cumulative probability is not below u."""
    return _let(u, _poisson1)


def _poisson1(u: Column) -> Column:
    table = poisson_table()
    out = F.when(u <= table[0], 0.0)
    for k, c in enumerate(table[1:], 1):
        out = out.when(u <= c, float(k))
    return out.otherwise(float(len(table)))


def poisson1_np(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(poisson_table(), u, "left").astype(float)
