"""Expressions as Spark columns: a (real, imaginary) pair per scalar node, IEEE semantics, never null."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import Expr
from .facts import Facts, facts

INF, NAN = float("inf"), float("nan")
#: Nodes above which a graph goes to the NumPy kernel instead.
MAX_NODES = 500
#: References above which a part becomes a column of its own: formulas name their operands several times over, so that
#: expressions written out in full would grow with the power of their depth.
MAX_SIZE = 24
#: How often an operation's formula names each operand, at most: for real ones, and for complex ones.
TIMES = {"div": (5, 12), "sqrt": (6, 6), "log": (4, 8), "mul": (1, 2), "norm_sqr": (2, 2), "exp": (1, 2), "sin": (1, 2), "cos": (1, 2)}


class NotLowerable(ValueError):
    """The expression needs the NumPy kernel."""


@dataclass(frozen=True)
class Pair:
    """A complex value as columns; im is None where it is known to be zero."""

    re: Column
    im: Column | None = None

    @property
    def imag(self) -> Column:
        return F.lit(0.0) if self.im is None else self.im


def ieee_div(a: Column, b: Column, nonzero: bool = False) -> Column:
    """a / b with infinities and NaN as doubles have them; Spark's own division raises or gives null for b = 0."""
    if nonzero:
        return a / b
    at_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def ieee_log(x: Column) -> Column:
    """ln of a real number: -inf at 0, NaN below; Spark's gives null."""
    return F.when(x > 0, F.log(F.when(x > 0, x).otherwise(1.0))).when(x == 0, -INF).otherwise(NAN)


def _hypot(p: Pair) -> Column:
    return F.abs(p.re) if p.im is None else F.hypot(p.re, p.im)


def add(a: Pair, b: Pair) -> Pair:
    im = a.im if b.im is None else b.im if a.im is None else a.im + b.im
    return Pair(a.re + b.re, im)


def neg(a: Pair) -> Pair:
    return Pair(-a.re, None if a.im is None else -a.im)


def mul(a: Pair, b: Pair) -> Pair:
    if a.im is None and b.im is None:
        return Pair(a.re * b.re)
    if a.im is None:
        return Pair(a.re * b.re, a.re * b.im)
    if b.im is None:
        return Pair(a.re * b.re, a.im * b.re)
    return Pair(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def norm_sqr(a: Pair) -> Column:
    return a.re * a.re if a.im is None else a.re * a.re + a.im * a.im


def div(a: Pair, b: Pair, nonzero: bool = False) -> Pair:
    if b.im is None:
        return Pair(ieee_div(a.re, b.re, nonzero), None if a.im is None else ieee_div(a.im, b.re, nonzero))
    d = norm_sqr(b)
    top = mul(a, Pair(b.re, -b.im))
    return Pair(ieee_div(top.re, d, nonzero), ieee_div(top.imag, d, nonzero))


def sqrt(a: Pair, nonneg: bool) -> Pair:
    """The principal root. With r = |z|: re = sqrt((r + x) / 2), im = sign(y) sqrt((r - x) / 2)."""
    if a.im is None and nonneg:
        return Pair(F.sqrt(a.re))
    r = _hypot(a)
    re = F.sqrt(F.greatest((r + a.re) / 2.0, F.lit(0.0)))
    im = F.sqrt(F.greatest((r - a.re) / 2.0, F.lit(0.0)))
    return Pair(re, im if a.im is None else F.when(a.im < 0, -im).otherwise(im))


def powi(a: Pair, n: int) -> Pair:
    if n == 0:
        return Pair(F.lit(1.0))
    base = a if n > 0 else div(Pair(F.lit(1.0)), a)
    out, square, n = None, base, abs(n)
    while n:
        if n & 1:
            out = square if out is None else mul(out, square)
        n >>= 1
        if n:
            square = mul(square, square)
    return out


def _scalar(e: Expr, a: list, known: dict[int, Facts], leaf) -> Pair:
    k = [known[id(x)] for x in e.args]
    if e.op == "const":
        return Pair(F.lit(e.data.real), None if e.data.imag == 0 else F.lit(e.data.imag))
    if e.op in ("param", "scalar", "p4"):
        return Pair(leaf(e))
    x = a[0]
    if e.op == "neg":
        return neg(x)
    if e.op == "real":
        return Pair(x.re)
    if e.op == "imag":
        return Pair(x.imag)
    if e.op == "conj":
        return Pair(x.re, None if x.im is None else -x.im)
    if e.op == "norm_sqr":
        return Pair(norm_sqr(x))
    if e.op == "sqrt":
        return sqrt(x, k[0].nonneg)
    if e.op == "exp":
        m = F.exp(x.re)
        return Pair(m) if x.im is None else Pair(m * F.cos(x.im), m * F.sin(x.im))
    if e.op in ("sin", "cos"):
        if x.im is None:
            return Pair(getattr(F, e.op)(x.re))
        s, c = F.sin(x.re), F.cos(x.re)
        sh, ch = F.sinh(x.im), F.cosh(x.im)
        return Pair(s * ch, c * sh) if e.op == "sin" else Pair(c * ch, -(s * sh))
    if e.op == "log":
        if x.im is None and k[0].nonneg:
            return Pair(ieee_log(x.re))
        return Pair(ieee_log(_hypot(x)), F.atan2(x.imag, x.re))
    if e.op == "powi":
        return powi(x, e.data)
    if e.op == "complex":
        return add(x, mul(Pair(F.lit(0.0), F.lit(1.0)), a[1]))
    if e.op == "add":
        return add(x, a[1])
    if e.op == "sub":
        return add(x, neg(a[1]))
    if e.op == "mul":
        return mul(x, a[1])
    if e.op == "div":
        return div(x, a[1], e.args[1].op == "const" and e.args[1].data != 0 or k[1].positive)
    if e.op == "atan2":
        return Pair(F.atan2(x.re, a[1].re))
    raise NotLowerable(e.op)


def _solve2(m: list[list[Pair]], v: list[Pair]) -> list[Pair]:
    """Cramer's rule for one or two unknowns."""
    if len(v) == 1:
        return [div(v[0], m[0][0])]
    (a, b), (c, d) = m
    det = add(mul(a, d), neg(mul(b, c)))
    return [div(add(mul(v[0], d), neg(mul(b, v[1]))), det), div(add(mul(a, v[1]), neg(mul(c, v[0]))), det)]


class Lowered:
    """Columns of several expressions over one DataFrame: `frame` has the shared parts, `pairs` the results."""

    def __init__(self, frame: DataFrame, exprs: list[Expr], values: Mapping[str, float | Column] | None = None):
        values = values or {}
        uses: dict[int, int] = {}
        for e in exprs:
            for x in e.nodes():
                for y in x.args:
                    uses[id(y)] = uses.get(id(y), 0) + 1
        total = len({id(x) for e in exprs for x in e.nodes()})
        if total > MAX_NODES:
            raise NotLowerable(f"{total} nodes")
        done: dict[int, object] = {}
        depth: dict[int, int] = {}
        size: dict[int, int] = {}
        pending: dict[int, list[tuple[str, Column]]] = {}
        count = 0

        def leaf(e: Expr) -> Column:
            if e.op == "param":
                p = e.data
                v = p.value if p.fixed else values.get(p.name, p.value)
                if v is None:
                    raise KeyError(f"parameter {p.name} has no value")
                return v if isinstance(v, Column) else F.lit(float(v))
            name = e.data if e.op == "scalar" else f"{e.data[0]}_{e.data[1]}"
            return F.col(f"`{name}`").cast("double")

        for root in exprs:
            known = facts(root)
            for e in root.nodes():
                if id(e) in done:
                    continue
                a = [done[id(x)] for x in e.args]
                level = max((depth[id(x)] for x in e.args), default=0)
                if e.shape != () or e.op in ("component", "element", "dot"):
                    out = self._shaped(e, a)
                else:
                    out = _scalar(e, a, known, leaf)
                plain = all(not isinstance(x, Pair) or x.im is None for x in a)
                times = abs(e.data) if e.op == "powi" else TIMES.get(e.op, (1, 1))[0]
                times = times if plain else 4 * abs(e.data) if e.op == "powi" else TIMES.get(e.op, (1, 1))[1]
                size[id(e)] = 1 + times * sum(size[id(x)] for x in e.args)
                if isinstance(out, Pair) and e.args and (size[id(e)] > MAX_SIZE or uses.get(id(e), 0) > 1 and size[id(e)] > 1):
                    size[id(e)] = 1
                    cols = []
                    for part in ("re", "im"):
                        c = getattr(out, part)
                        if c is None:
                            cols.append(None)
                            continue
                        name = f"__b{count}_{part}"
                        pending.setdefault(level, []).append((name, c))
                        cols.append(F.col(name))
                    count += 1
                    out, level = Pair(*cols), level + 1
                done[id(e)], depth[id(e)] = out, level
        for level in sorted(pending):
            frame = frame.withColumns(dict(pending[level]))
        self.frame = frame
        self.values = [done[id(e)] for e in exprs]

    @staticmethod
    def _shaped(e: Expr, a: list):
        if e.op == "vector":
            return list(a)
        if e.op == "matrix":
            r, c = e.shape
            return [a[i * c : (i + 1) * c] for i in range(r)]
        if e.op == "component":
            return a[0][e.data]
        if e.op == "element":
            return a[0][e.data[0]][e.data[1]]
        dot = lambda x, y: _total([mul(p, q) for p, q in zip(x, y, strict=True)])
        if e.op == "dot":
            return dot(a[0], a[1])
        if e.op == "matvec":
            return [dot(row, a[1]) for row in a[0]]
        if e.op == "matmul":
            return [[dot(row, [b[c] for b in a[1]]) for c in range(e.shape[1])] for row in a[0]]
        if e.op == "solve" and e.shape[0] <= 2:
            return _solve2(a[0], a[1])
        raise NotLowerable(f"{e.op} of shape {e.shape}")

    def pairs(self) -> list[Pair]:
        out = []
        for v in self.values:
            if not isinstance(v, Pair):
                raise ValueError("a scalar expression is needed")
            out.append(v)
        return out


def _total(items: list[Pair]) -> Pair:
    out = items[0]
    for x in items[1:]:
        out = add(out, x)
    return out
