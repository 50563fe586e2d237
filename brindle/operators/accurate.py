"""Sums without rounding but the last: a wide accumulator whose parts Spark adds as whole numbers, in any order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..plans.expr import Expr
from ..plans.lower import Lowered
from ..plans.rewrite import simplify

#: Bits of a double's mantissa, cut in two so that sums of parts stay whole numbers below 2**63 for 2**36 events.
BITS, LOW = 53, 27
SPECIAL = 1 << 20


def parts(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(exponent, high, low) whose sum of (high * 2**LOW + low) * 2**exponent is the exact sum of x; infinities and NaN
    as (SPECIAL + kind, count, 0)."""
    out = []
    for kind, bad in enumerate((np.isnan(x), x == np.inf, x == -np.inf)):
        if bad.any():
            out.append((SPECIAL + kind, int(bad.sum()), 0))
    m, e = np.frexp(x[np.isfinite(x)])
    whole = (m * 2.0**BITS).astype(np.int64)
    high, low = whole >> LOW, whole & ((1 << LOW) - 1)
    for k in np.unique(e):
        at = e == k
        out.append((int(k) - BITS, int(high[at].sum()), int(low[at].sum())))
    return out


def joined(rows) -> float:
    """The nearest double to what the parts add up to."""
    total, special = Fraction(0), set()
    for e, high, low in rows:
        if e >= SPECIAL:
            special.add(e - SPECIAL)
        else:
            total += Fraction((high << LOW) + low) * Fraction(2) ** e
    if 0 in special or {1, 2} <= special:
        return float("nan")
    return float("inf") if 1 in special else float("-inf") if 2 in special else float(total)


def accurate_sums(ds, exprs: Sequence[Expr], values: Mapping[str, float] | None = None) -> list[complex]:
    """The sums of weight times each scalar expression, correctly rounded: the products are rounded once, their sum once.

    The result depends neither on partitions nor on order. Some two thousand rows at most reach the driver, whatever the
    number of events.
    """
    low = Lowered(ds.frame, [simplify(e) for e in exprs], values)
    cols = []
    for p in low.pairs():
        cols += [ds.weight * p.re, ds.weight * (p.im if p.im is not None else F.lit(0.0))]
    frame = low.frame.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)])

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i in range(b.num_columns) for r in parts(b.column(i).to_numpy(zero_copy_only=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["i", "e", "high", "low"])

    summed = frame.mapInArrow(run, "i long, e long, high long, low long").groupBy("i", "e").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found: dict[int, list] = {}
    for r in summed.collect():
        found.setdefault(r.i, []).append((r.e, r.high, r.low))
    sums = [joined(found.get(i, [])) for i in range(len(cols))]
    return [complex(a, b) for a, b in zip(sums[0::2], sums[1::2], strict=True)]
