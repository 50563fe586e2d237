"""Symbolic expressions over weighted events: an immutable graph with eager shape checks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

Shape = tuple[int, ...]  # () scalar, (n,) vector, (r, c) matrix


class ShapeError(ValueError):
    """Operands whose shapes do not fit."""


@dataclass(frozen=True)
class Parameter:
    """A real fit parameter: free unless `fixed`, with bounds, period, scale and labels."""

    name: str
    value: float | None = None
    fixed: bool = False
    bounds: tuple[float | None, float | None] = (None, None)
    periodic: bool = False
    scale: float = 1.0
    unit: str | None = None
    latex: str | None = None
    description: str | None = None

    def __post_init__(self):
        lo, hi = self.bounds
        if not self.name:
            raise ValueError("a parameter needs a name")
        if lo is not None and hi is not None and not lo < hi:
            raise ValueError(f"{self.name}: the lower bound must be below the upper")
        if self.periodic and (lo is None or hi is None):
            raise ValueError(f"{self.name}: a periodic parameter needs both bounds")
        if self.fixed and self.value is None:
            raise ValueError(f"{self.name}: a fixed parameter needs a value")
        if not self.scale > 0:
            raise ValueError(f"{self.name}: the scale must be positive")

    def to_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if v is not None}

    @classmethod
    def from_dict(cls, d: dict) -> Parameter:
        return cls(**{**d, "bounds": tuple(d.get("bounds", (None, None)))})


UNARY = ("neg", "real", "imag", "conj", "norm_sqr", "sqrt", "exp", "sin", "cos", "log")
BINARY = ("add", "sub", "mul", "div", "atan2")


class Expr:
    """One node. `op` names it, `args` are its operands, `data` what else it needs (a value, a name, an index)."""

    __slots__ = ("op", "args", "data", "shape", "label", "tags", "_key")

    def __init__(self, op: str, args: Sequence[Expr] = (), data=None, shape: Shape = (), label: str | None = None, tags: frozenset[str] = frozenset()):
        self.op, self.args, self.data, self.shape, self.label, self.tags = op, tuple(args), data, shape, label, tags
        self._key = None

    # -- building ------------------------------------------------------------------------------------------------

    @staticmethod
    def of(x) -> Expr:
        if isinstance(x, Expr):
            return x
        if hasattr(x, "as_expr"):
            return x.as_expr()
        if isinstance(x, Parameter):
            return Expr("param", data=x)
        if isinstance(x, (int, float, complex)) and not isinstance(x, bool):
            z = complex(x)
            return Expr("const", data=z)
        raise TypeError(f"{type(x).__name__} is no expression")

    def _scalar(self) -> Expr:
        if self.shape != ():
            raise ShapeError(f"a scalar is needed, not shape {self.shape}")
        return self

    def _unary(self, op: str) -> Expr:
        return Expr(op, (self._scalar(),))

    def _binary(self, op: str, other, swap: bool = False) -> Expr:
        a, b = self, Expr.of(other)
        if swap:
            a, b = b, a
        if a.shape == b.shape == ():
            return Expr(op, (a, b))
        if op in ("add", "sub") and a.shape == b.shape:
            return _build(a.shape, [x._binary(op, y) for x, y in zip(a.parts(), b.parts(), strict=True)])
        if op == "mul" and () in (a.shape, b.shape):
            return _build(b.shape, [a._binary(op, y) for y in b.parts()]) if a.shape == () else _build(a.shape, [x._binary(op, b) for x in a.parts()])
        if op == "div" and b.shape == ():
            return _build(a.shape, [x._binary(op, b) for x in a.parts()])
        raise ShapeError(f"{op} of shapes {a.shape} and {b.shape}")

    def parts(self) -> list[Expr]:
        """The scalar elements, row by row."""
        if self.shape == ():
            return [self]
        if self.op in ("vector", "matrix"):
            return list(self.args)
        if len(self.shape) == 1:
            return [Expr("component", (self,), i) for i in range(self.shape[0])]
        return [Expr("element", (self,), (r, c)) for r in range(self.shape[0]) for c in range(self.shape[1])]

    def __add__(self, o):
        return self._binary("add", o)

    def __radd__(self, o):
        return self._binary("add", o, True)

    def __sub__(self, o):
        return self._binary("sub", o)

    def __rsub__(self, o):
        return self._binary("sub", o, True)

    def __mul__(self, o):
        return self._binary("mul", o)

    def __rmul__(self, o):
        return self._binary("mul", o, True)

    def __truediv__(self, o):
        return self._binary("div", o)

    def __rtruediv__(self, o):
        return self._binary("div", o, True)

    def __matmul__(self, o):
        o = Expr.of(o)
        if len(self.shape) == 2:
            return matmul(self, o) if len(o.shape) == 2 else matvec(self, o)
        return dot(self, o)

    def __neg__(self):
        return self._unary("neg") if self.shape == () else _build(self.shape, [-x for x in self.parts()])

    def __pow__(self, n):
        if not isinstance(n, int) or isinstance(n, bool):
            raise TypeError("powers are integers")
        return Expr("powi", (self._scalar(),), n)

    powi = __pow__

    def __getitem__(self, i) -> Expr:
        return self.at(*i) if isinstance(i, tuple) else self.at(i)

    def at(self, *i: int) -> Expr:
        """A vector's component or a matrix's element."""
        if len(i) != len(self.shape) or not i or any(not 0 <= k < n for k, n in zip(i, self.shape, strict=True)):
            raise ShapeError(f"index {i} into shape {self.shape}")
        if self.op == "vector":
            return self.args[i[0]]
        if self.op == "matrix":
            return self.args[i[0] * self.shape[1] + i[1]]
        return Expr("component", (self,), i[0]) if len(i) == 1 else Expr("element", (self,), i)

    def real(self):
        return self._unary("real")

    def imag(self):
        return self._unary("imag")

    def conj(self):
        return self._unary("conj")

    def norm_sqr(self):
        return self._unary("norm_sqr")

    def sqrt(self):
        return self._unary("sqrt")

    def exp(self):
        return self._unary("exp")

    def sin(self):
        return self._unary("sin")

    def cos(self):
        return self._unary("cos")

    def log(self):
        return self._unary("log")

    def acos(self):
        """atan2(sqrt(1 - x^2), x)."""
        return atan2((1.0 - self**2).sqrt(), self)

    # -- comparisons (predicates) ---------------------------------------------------------------------------------

    def _compare(self, op: str, other):
        from ..operators.predicate import Comparison

        return Comparison(op, self, Expr.of(other))

    def __lt__(self, o):
        return self._compare("lt", o)

    def __le__(self, o):
        return self._compare("le", o)

    def __gt__(self, o):
        return self._compare("gt", o)

    def __ge__(self, o):
        return self._compare("ge", o)

    def __eq__(self, o):
        return self._compare("eq", o)

    def __ne__(self, o):
        return self._compare("ne", o)

    __hash__ = object.__hash__

    # -- names and tags -------------------------------------------------------------------------------------------

    def named(self, label: str) -> Expr:
        return Expr(self.op, self.args, self.data, self.shape, label, self.tags)

    def tagged(self, *tags: str) -> Expr:
        return Expr(self.op, self.args, self.data, self.shape, self.label, self.tags | frozenset(tags))

    def project(self, *tags: str) -> Expr:
        """Tagged nodes without any of the given tags become zero of their shape; what is chosen stays whole."""
        chosen = frozenset(tags)

        def change(e: Expr, args: tuple[Expr, ...]) -> Expr:
            return e.with_args(args)

        done: dict[int, Expr] = {}

        def walk(e: Expr) -> Expr:
            if id(e) not in done:
                if e.tags:
                    done[id(e)] = e if e.tags & chosen else zero(e.shape)
                else:
                    done[id(e)] = change(e, tuple(walk(a) for a in e.args))
            return done[id(e)]

        return walk(self)

    # -- graph -----------------------------------------------------------------------------------------------------

    def with_args(self, args: tuple[Expr, ...]) -> Expr:
        if all(a is b for a, b in zip(args, self.args, strict=True)):
            return self
        return Expr(self.op, args, self.data, self.shape, self.label, self.tags)

    def nodes(self) -> list[Expr]:
        """All nodes, operands first, each object once."""
        out, seen, stack = [], set(), [(self, False)]
        while stack:
            e, ready = stack.pop()
            if ready:
                out.append(e)
            elif id(e) not in seen:
                seen.add(id(e))
                stack.append((e, True))
                stack.extend((a, False) for a in reversed(e.args) if id(a) not in seen)
        return out

    def merged(self) -> Expr:
        """The same graph with equal nodes shared (hash-consing; floats by their bits)."""
        known: dict[tuple, Expr] = {}
        done: dict[int, Expr] = {}
        for e in self.nodes():
            args = tuple(done[id(a)] for a in e.args)
            data = (e.data.real.hex(), e.data.imag.hex()) if e.op == "const" else e.data
            key = (e.op, data, tuple(map(id, args)), e.shape, e.label, e.tags)
            done[id(e)] = known.setdefault(key, e.with_args(args))
        return done[id(self)]

    def rewrite(self, f: Callable[[Expr], Expr]) -> Expr:
        """The graph with f applied to every node, operands first."""
        done: dict[int, Expr] = {}
        for e in self.nodes():
            done[id(e)] = f(e.with_args(tuple(done[id(a)] for a in e.args)))
        return done[id(self)]

    def parameters(self) -> list[Parameter]:
        """Parameters in the order of first use; one name has one specification."""
        out: dict[str, Parameter] = {}
        for e in self.nodes():
            if e.op == "param":
                if out.setdefault(e.data.name, e.data) != e.data:
                    raise ValueError(f"parameter {e.data.name} is specified in two ways")
        return list(out.values())

    def columns(self) -> set[str]:
        """Physical columns that the expression reads."""
        return {e.data if e.op == "scalar" else f"{e.data[0]}_{e.data[1]}" for e in self.nodes() if e.op in ("scalar", "p4")}

    def fix(self, **values: float) -> Expr:
        """Parameters held at values."""
        return self._respecify({k: lambda p, v=v: replace(p, fixed=True, value=float(v)) for k, v in values.items()})

    def free(self, *names: str) -> Expr:
        """Parameters freed."""
        return self._respecify({k: lambda p: replace(p, fixed=False) for k in names})

    def _respecify(self, change: dict[str, Callable[[Parameter], Parameter]]) -> Expr:
        missing = set(change) - {p.name for p in self.parameters()}
        if missing:
            raise KeyError(f"no such parameter: {', '.join(sorted(missing))}")
        return self.rewrite(lambda e: Expr("param", (), change[e.data.name](e.data), (), e.label, e.tags) if e.op == "param" and e.data.name in change else e)

    # -- JSON ------------------------------------------------------------------------------------------------------

    def to_json(self) -> str:
        nodes = self.merged().nodes()
        at = {id(e): i for i, e in enumerate(nodes)}
        rows = []
        for e in nodes:
            data = e.data
            if e.op == "const":
                data = [data.real, data.imag]
            elif e.op == "param":
                data = data.to_dict()
            rows.append({"op": e.op, "args": [at[id(a)] for a in e.args], "data": data, "shape": list(e.shape), "label": e.label, "tags": sorted(e.tags)})
        return json.dumps({"nodes": rows, "root": len(rows) - 1})

    @classmethod
    def from_json(cls, text: str) -> Expr:
        d = json.loads(text)
        out: list[Expr] = []
        for i, r in enumerate(d["nodes"]):
            if any(not 0 <= a < i for a in r["args"]):
                raise ValueError(f"node {i} refers to a later node")
            data = r["data"]
            if r["op"] == "const":
                data = complex(*data)
            elif r["op"] == "param":
                data = Parameter.from_dict(data)
            elif isinstance(data, list):
                data = tuple(data)
            out.append(cls(r["op"], [out[a] for a in r["args"]], data, tuple(r["shape"]), r["label"], frozenset(r["tags"])))
        return out[d["root"]]

    def __repr__(self):
        from .render import equation

        return f"Expr({equation(self)})"


def _build(shape: Shape, parts: Sequence[Expr]) -> Expr:
    return Expr("vector" if len(shape) == 1 else "matrix", parts, None, shape)


def zero(shape: Shape = ()) -> Expr:
    n = math.prod(shape)
    return Expr.of(0.0) if shape == () else _build(shape, [Expr.of(0.0)] * n)


def const(x) -> Expr:
    return Expr.of(x)


def parameter(name: str, value: float | None = None, **spec) -> Expr:
    return Expr("param", data=Parameter(name, value, **spec))


def scalar(name: str) -> Expr:
    """A real event column."""
    return Expr("scalar", data=name)


def p4_component(name: str, part: str) -> Expr:
    """e, px, py or pz of a four-momentum column."""
    if part not in ("e", "px", "py", "pz"):
        raise ValueError(f"a four-momentum has no part {part}")
    return Expr("p4", data=(name, part))


def complex_(re, im) -> Expr:
    return Expr("complex", (Expr.of(re)._scalar(), Expr.of(im)._scalar()))


def cis(phase) -> Expr:
    phase = Expr.of(phase)
    return complex_(phase.cos(), phase.sin())


def polar_complex(magnitude, phase) -> Expr:
    m, phase = Expr.of(magnitude), Expr.of(phase)
    return complex_(m * phase.cos(), m * phase.sin())


def atan2(y, x) -> Expr:
    return Expr("atan2", (Expr.of(y)._scalar(), Expr.of(x)._scalar()))


def acos(x) -> Expr:
    return Expr.of(x).acos()


def vector(items: Iterable) -> Expr:
    parts = [Expr.of(x)._scalar() for x in items]
    if not parts:
        raise ShapeError("a vector needs an element")
    return _build((len(parts),), parts)


def matrix(rows: Iterable[Iterable]) -> Expr:
    rows = [list(r) for r in rows]
    if not rows or not rows[0] or any(len(r) != len(rows[0]) for r in rows):
        raise ShapeError("a matrix needs rows of one positive length")
    return _build((len(rows), len(rows[0])), [Expr.of(x)._scalar() for r in rows for x in r])


def matrix_from_flat(rows: int, cols: int, items: Iterable) -> Expr:
    items = list(items)
    if len(items) != rows * cols:
        raise ShapeError(f"{len(items)} elements for {rows} x {cols}")
    return matrix([items[r * cols : (r + 1) * cols] for r in range(rows)])


def matmul(a, b) -> Expr:
    a, b = Expr.of(a), Expr.of(b)
    if len(a.shape) != 2 or len(b.shape) != 2 or a.shape[1] != b.shape[0]:
        raise ShapeError(f"matmul of shapes {a.shape} and {b.shape}")
    return Expr("matmul", (a, b), None, (a.shape[0], b.shape[1]))


def matvec(a, b) -> Expr:
    a, b = Expr.of(a), Expr.of(b)
    if len(a.shape) != 2 or len(b.shape) != 1 or a.shape[1] != b.shape[0]:
        raise ShapeError(f"matvec of shapes {a.shape} and {b.shape}")
    return Expr("matvec", (a, b), None, (a.shape[0],))


def dot(a, b) -> Expr:
    """The sum of products, without conjugation."""
    a, b = Expr.of(a), Expr.of(b)
    if len(a.shape) != 1 or a.shape != b.shape:
        raise ShapeError(f"dot of shapes {a.shape} and {b.shape}")
    return Expr("dot", (a, b))


def solve(a, b) -> Expr:
    """x with a x = b; a singular matrix is an error when evaluated."""
    a, b = Expr.of(a), Expr.of(b)
    if len(a.shape) != 2 or a.shape[0] != a.shape[1] or b.shape != (a.shape[0],):
        raise ShapeError(f"solve of shapes {a.shape} and {b.shape}")
    return Expr("solve", (a, b), None, b.shape)


def reduce_(items: Sequence[Expr], op: Callable[[Expr, Expr], Expr]) -> Expr:
    out = items[0]
    for x in items[1:]:
        out = op(out, x)
    return out
