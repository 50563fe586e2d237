"""Separability: an intensity as a sum of coefficient(parameters) times basis(event), so that its sum over a sample
needs one pass over the events, whatever the number of parameter values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

from .evaluate import evaluate
from .expr import Expr
from .facts import facts

#: Terms beyond which a decomposition is not worth it.
MAX_TERMS = 4096


class NotSeparable(ValueError):
    """The expression mixes parameters and event columns in one operation."""


@dataclass(frozen=True)
class Term:
    """coefficient * basis; with `real` the real part of the product counts."""

    coefficient: Expr
    basis: Expr


ONE = Expr.of(1.0)


def separate(root: Expr) -> list[Term]:
    """The terms whose sum is the expression. Raises NotSeparable.

    norm_sqr of a sum of n terms gives n (n + 1) / 2 terms, each of them real by itself, so that products and powers of
    norms stay exact.
    """
    known = facts(root)
    memo: dict[int, list[Term]] = {}

    def walk(e: Expr) -> list[Term]:
        if id(e) in memo:
            return memo[id(e)]
        k = known.get(id(e))
        if k is not None and not k.event:
            out = [Term(e, ONE)]
        elif k is not None and not k.free:
            out = [Term(ONE, e)]
        elif e.op == "add":
            out = walk(e.args[0]) + walk(e.args[1])
        elif e.op == "sub":
            out = walk(e.args[0]) + [Term(-t.coefficient, t.basis) for t in walk(e.args[1])]
        elif e.op == "neg":
            out = [Term(-t.coefficient, t.basis) for t in walk(e.args[0])]
        elif e.op == "mul":
            out = [Term(s.coefficient * t.coefficient, s.basis * t.basis) for s in walk(e.args[0]) for t in walk(e.args[1])]
        elif e.op == "powi" and 1 <= e.data <= 4:
            out = walk(e.args[0])
            for _ in range(e.data - 1):
                out = [Term(s.coefficient * t.coefficient, s.basis * t.basis) for s in out for t in walk(e.args[0])]
        elif e.op == "div" and not known[id(e.args[1])].event:
            out = [Term(t.coefficient / e.args[1], t.basis) for t in walk(e.args[0])]
        elif e.op == "div" and not known[id(e.args[1])].free:
            out = [Term(t.coefficient, t.basis / e.args[1]) for t in walk(e.args[0])]
        elif e.op == "conj":
            out = [Term(t.coefficient.conj(), t.basis.conj()) for t in walk(e.args[0])]
        elif e.op == "complex":
            out = walk(e.args[0]) + [Term(Expr.of(1j) * t.coefficient, t.basis) for t in walk(e.args[1])]
        elif e.op == "norm_sqr":
            t = walk(e.args[0])
            out = []
            for i, x in enumerate(t):
                out.append(Term(x.coefficient.norm_sqr(), x.basis.norm_sqr()))
                for y in t[i + 1 :]:
                    # 2 Re(c b) = 2 Re c Re b - 2 Im c Im b
                    c, b = x.coefficient * y.coefficient.conj(), x.basis * y.basis.conj()
                    out.append(Term(2.0 * c.real(), b.real()))
                    out.append(Term(-2.0 * c.imag(), b.imag()))
        elif e.op in ("real", "imag"):
            out = []
            for t in walk(e.args[0]):
                c, b = t.coefficient, t.basis
                if e.op == "real":
                    out += [Term(c.real(), b.real()), Term(-c.imag(), b.imag())]
                else:
                    out += [Term(c.real(), b.imag()), Term(c.imag(), b.real())]
        else:
            raise NotSeparable(e.op)
        if len(out) > MAX_TERMS:
            raise NotSeparable(f"more than {MAX_TERMS} terms")
        memo[id(e)] = out
        return out

    terms = walk(root)
    # equal bases are summed once
    pool: dict[str, tuple[Expr, Expr]] = {}
    for t in terms:
        key = t.basis.to_json()
        c = pool[key][0] + t.coefficient if key in pool else t.coefficient
        pool[key] = (c, t.basis)
    return [Term(c, b) for c, b in pool.values()]


def parts(root: Expr) -> list[Expr]:
    """The summands at the top of an expression."""
    if root.op == "add":
        return parts(root.args[0]) + parts(root.args[1])
    return [root]


def split(root: Expr) -> tuple[list[Term], Expr | None]:
    """Terms of the separable summands, and the sum of the others (to be evaluated event by event) or None."""
    terms: list[Term] = []
    rest: Expr | None = None
    for p in parts(root):
        try:
            terms += separate(p)
        except NotSeparable:
            rest = p if rest is None else rest + p
    return terms, rest


def contract(terms: list[Term], sums: np.ndarray, values: Mapping[str, float]) -> complex:
    """The sum over the sample at parameter values, from the bases' sums."""
    return complex(sum(evaluate(t.coefficient, {}, values, 1)[0] * s for t, s in zip(terms, sums, strict=True)))
