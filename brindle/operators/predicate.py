"""Predicates over expressions. A comparison with NaN on either side is false, also `!=`; their negation is true."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.evaluate import evaluate
from ..plans.expr import Expr


class Predicate:
    """Combines with &, | and ~."""

    def __and__(self, o: Predicate) -> Predicate:
        return Both("and", self, o)

    def __or__(self, o: Predicate) -> Predicate:
        return Both("or", self, o)

    def __invert__(self) -> Predicate:
        return Not(self)

    def __bool__(self):
        raise TypeError("combine predicates with &, | and ~")

    def exprs(self) -> list[Expr]:
        raise NotImplementedError

    def column(self, real: dict[int, Column]) -> Column:
        """Never null. `real` has the real part of each expression by id()."""
        raise NotImplementedError

    def mask(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Comparison(Predicate):
    op: str
    left: Expr
    right: Expr

    def exprs(self):
        return [self.left, self.right]

    def column(self, real):
        a, b = real[id(self.left)], real[id(self.right)]
        c = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[self.op]
        return ~F.isnan(a) & ~F.isnan(b) & c

    def mask(self, columns):
        a, b = evaluate(self.left, columns).real, evaluate(self.right, columns).real
        c = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[self.op]
        return c & ~np.isnan(a) & ~np.isnan(b)


@dataclass(frozen=True, eq=False)
class Both(Predicate):
    op: str
    left: Predicate
    right: Predicate

    def exprs(self):
        return self.left.exprs() + self.right.exprs()

    def column(self, real):
        a, b = self.left.column(real), self.right.column(real)
        return a & b if self.op == "and" else a | b

    def mask(self, columns):
        a, b = self.left.mask(columns), self.right.mask(columns)
        return a & b if self.op == "and" else a | b


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    inner: Predicate

    def exprs(self):
        return self.inner.exprs()

    def column(self, real):
        return ~self.inner.column(real)

    def mask(self, columns):
        return ~self.inner.mask(columns)


def between(x, low, high, closed: str = "both") -> Predicate:
    """low .. high; `closed` is both, neither, left or right. Bounds may be expressions."""
    if closed not in ("both", "neither", "left", "right"):
        raise ValueError(f"closed={closed}")
    x, low, high = Expr.of(x), Expr.of(low), Expr.of(high)
    return (x >= low if closed in ("both", "left") else x > low) & (x <= high if closed in ("both", "right") else x < high)
