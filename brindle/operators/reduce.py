"""Weighted reductions: one aggregate for values, gradients and the check that intensities are positive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..plans.evaluate import evaluate
from ..plans.expr import Expr, vector
from ..plans.lower import Lowered, NotLowerable
from ..plans.rewrite import derivative, simplify

REAL, POSITIVE, LOG = "real", "positive", "log"


class NotPositive(ArithmeticError):
    """An intensity that must be positive is zero, negative or NaN for some events."""


def weighted_sums(ds, exprs: Sequence[Expr], values: Mapping[str, float] | None = None) -> np.ndarray:
    """The complex sums of weight times each scalar expression, in one pass."""
    exprs = [simplify(e) for e in exprs]
    try:
        low = Lowered(ds.frame, exprs, values)
        aggs = []
        for i, p in enumerate(low.pairs()):
            aggs.append(F.coalesce(F.sum(ds.weight * p.re), F.lit(0.0)).alias(f"re{i}"))
            if p.im is not None:
                aggs.append(F.coalesce(F.sum(ds.weight * p.im), F.lit(0.0)).alias(f"im{i}"))
        r = low.frame.agg(*aggs).first().asDict()
        return np.array([r[f"re{i}"] + 1j * r.get(f"im{i}", 0.0) for i in range(len(exprs))])
    except NotLowerable:
        rows = _kernel_sums(ds, exprs, values)
        return rows[0::2] + 1j * rows[1::2]


def _kernel_sums(ds, exprs: Sequence[Expr], values) -> np.ndarray:
    """Partial sums per Arrow batch from the NumPy kernel, then one aggregate."""
    need = sorted(set().union(*(e.columns() for e in exprs)))
    n = 2 * len(exprs)
    every = vector(exprs).merged()  # equal parts are computed once for all

    def run(batches):
        for b in batches:
            cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(need, 1)}
            w = b.column(0).to_numpy(zero_copy_only=False)
            if not b.num_rows:
                continue
            z = (w[:, None] * evaluate(every, cols, values, b.num_rows)).sum(axis=0)
            flat = [x for v in z for x in (complex(v).real, complex(v).imag)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in flat], names=[f"s{i}" for i in range(n)])

    frame = ds.frame.select(ds.weight.alias("__w"), *[f"`{c}`" for c in need]).mapInArrow(run, ", ".join(f"s{i} double" for i in range(n)))
    r = frame.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(n)]).first()
    return np.array([float(x) for x in r])


def reduce(ds, expr: Expr, transform: str = REAL, values: Mapping[str, float] | None = None, gradient: Sequence[str] = ()) -> tuple[float, np.ndarray]:
    """The sum of weight * t(Re expr), t the identity or the logarithm, and its gradient; one pass.

    positive and log raise NotPositive if any event's value is not above zero.
    """
    root = simplify(expr)
    grads = [simplify(derivative(root, g)) for g in gradient]
    try:
        low = Lowered(ds.frame, [root, *grads], values)
        pairs = low.pairs()
        x, w = pairs[0].re, ds.weight
        bad = F.isnan(x) | ~(x > 0)
        safe = F.when(bad, 1.0).otherwise(x)
        body = F.log(safe) if transform == LOG else x
        aggs = [F.coalesce(F.sum(w * body), F.lit(0.0)).alias("value")]
        if transform != REAL:
            aggs.append(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("bad"))
        for i, g in enumerate(pairs[1:]):
            d = g.re / safe if transform == LOG else g.re
            aggs.append(F.coalesce(F.sum(w * d), F.lit(0.0)).alias(f"g{i}"))
        r = low.frame.agg(*aggs).first().asDict()
        out, n_bad = r["value"], r.get("bad", 0)
        grad = np.array([r[f"g{i}"] for i in range(len(gradient))])
    except NotLowerable:
        out, n_bad, grad = _kernel_reduce(ds, root, grads, transform, values)
    if transform != REAL and n_bad:
        raise NotPositive(f"{n_bad} events have an intensity that is not positive")
    return float(out), grad


def _kernel_reduce(ds, root: Expr, grads: list[Expr], transform: str, values):
    need = sorted(set().union(*(e.columns() for e in [root, *grads])))
    names = ["value", "bad", *(f"g{i}" for i in range(len(grads)))]
    every = vector([root, *grads]).merged()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(need, 1)}
            w = b.column(0).to_numpy(zero_copy_only=False)
            v = evaluate(every, cols, values, b.num_rows).real
            x = v[:, 0]
            bad = ~(x > 0)
            safe = np.where(bad, 1.0, x)
            row = [(w * (np.log(safe) if transform == LOG else x)).sum(), float(bad.sum())]
            for d in v.T[1:]:
                row.append((w * (d / safe if transform == LOG else d)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([float(y)]) for y in row], names=names)

    frame = ds.frame.select(ds.weight.alias("__w"), *[f"`{c}`" for c in need]).mapInArrow(run, ", ".join(f"{n} double" for n in names))
    r = [float(v) for v in frame.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first()]
    return r[0], int(r[1]), np.array(r[2:])


#: Parameter points whose sums one pass takes together.
GROUP = 32


def many(ds, expr: Expr, draws, names: Sequence[str], transform: str = REAL) -> np.ndarray:
    """The sum at each row of `draws` (parameter values by `names`): points are columns of one pass over the events, GROUP
    of them at a time, so that no event is repeated; what the points have in common is computed once."""
    points = [expr.fix(**dict(zip(names, map(float, d), strict=True))) if len(names) else expr for d in draws]
    out = np.zeros(len(points))
    for at in range(0, len(points), GROUP):
        group = points[at : at + GROUP]
        try:
            low = Lowered(ds.frame, [simplify(e) for e in group])
        except NotLowerable:
            out[at : at + GROUP] = [reduce(ds, e, transform)[0] for e in group]
            continue
        aggs = []
        for k, p in enumerate(low.pairs()):
            x = p.re
            bad = F.isnan(x) | ~(x > 0)
            body = F.log(F.when(bad, 1.0).otherwise(x)) if transform == LOG else x
            aggs.append(F.coalesce(F.sum(ds.weight * body), F.lit(0.0)).alias(f"v{k}"))
            if transform != REAL:
                aggs.append(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias(f"bad{k}"))
        r = low.frame.agg(*aggs).first().asDict()
        if n_bad := sum(v for c, v in r.items() if c.startswith("bad")):
            raise NotPositive(f"{n_bad} events have an intensity that is not positive")
        out[at : at + GROUP] = [r[f"v{k}"] for k in range(len(group))]
    return out
