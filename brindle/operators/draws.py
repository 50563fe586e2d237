"""Ensembles of any size: the draws are rows of a DataFrame and Spark takes their statistics; none of them reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..plans.lower import ieee_div

BITS, SIGN = 64, np.uint64(1 << 63)
#: Bits that a pass of a selection settles, and the number of values of which a pass settles all bits.
DIGIT = 12
FEW = 1 << DIGIT


def keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: zeros are alike, NaN is last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def doubles(k: np.ndarray) -> np.ndarray:
    return np.where(k & SIGN, k ^ SIGN, ~k).view(np.float64)


def _counts(frame: DataFrame, among: dict[int, np.ndarray], left: int, right: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By column: the keys without their last `right` bits and how many values have each, of those values whose keys without
    their last `left` bits are in `among`."""

    def run(batches):
        for b in batches:
            for i, at in among.items():
                k = keys(b.column(i).drop_null().to_numpy(zero_copy_only=False))
                if left < BITS:
                    k = k[np.isin(k >> np.uint64(left), at)]
                k, n = np.unique(k >> np.uint64(right), return_counts=True)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i)), pa.array(k.view(np.int64)), pa.array(n)], names=["i", "k", "n"])

    rows = frame.mapInArrow(run, "i long, k long, n long").groupBy("i", "k").agg(F.sum("n").alias("n")).collect()
    found = {}
    for i in among:
        k, n = (np.array([r[c] for r in rows if r["i"] == i], np.int64) for c in ("k", "n"))
        order = np.argsort(k.view(np.uint64))
        found[i] = k.view(np.uint64)[order], n[order]
    return found


def quantiles(frame: DataFrame, wanted: Sequence[tuple[Column, float]]) -> list[float | None]:
    """Exact quantiles by linear interpolation between sorted values; nulls do not count, and of no values it is null.

    Values are selected digit by digit of their bits, all at once: a pass counts the values that begin as a wanted one does by
    their next DIGIT bits. It sends FEW counts for each wanted value at most, however many values there are and however many are
    alike. Where FEW values are left, the next pass settles all bits; six passes always do.
    """
    if not wanted:
        return []
    columns = list({id(c): c for c, _ in wanted}.values())
    of = [next(i for i, c in enumerate(columns) if c is w) for w, _ in wanted]
    frame = frame.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    found = _counts(frame, {i: np.zeros(0, np.uint64) for i in range(len(columns))}, BITS, BITS - DIGIT)
    share: dict[int, float] = {}
    sought: dict[tuple[int, int], tuple[np.uint64, int]] = {}  # lower and upper value: how its key begins, its rank among those
    for j, (_, p) in enumerate(wanted):
        if n := int(found[of[j]][1].sum()):
            at = p * (n - 1)
            share[j] = at - int(at)
            sought |= {(j, 0): (np.uint64(0), int(at)), (j, 1): (np.uint64(0), min(int(at) + 1, n - 1))}
    left, right = BITS, BITS - DIGIT
    while sought:
        most = 0
        for (j, side), (begin, rank) in sought.items():
            k, n = found[of[j]]
            if left < BITS:
                inside = k >> np.uint64(left - right) == begin
                k, n = k[inside], n[inside]
            upto = np.cumsum(n)
            at = int(np.searchsorted(upto, rank, side="right"))
            sought[j, side] = k[at], rank - int(upto[at] - n[at])
            most = max(most, int(n[at]))
        if not right:
            break
        left, right = right, 0 if most <= FEW else max(right - DIGIT, 0)
        found = _counts(frame, {i: np.unique(np.array([b for (j, _), (b, _) in sought.items() if of[j] == i], np.uint64)) for i in {of[j] for j in share}}, left, right)
    out: list[float | None] = []
    for j in range(len(wanted)):
        if j not in share:
            out.append(None)
            continue
        low, high = (float(x) for x in doubles(np.array([sought[j, side][0] for side in (0, 1)], np.uint64)))
        out.append(low if low == high or not share[j] else low * (1 - share[j]) + high * share[j])
    return out


@dataclass(frozen=True)
class Quantile:
    column: Column
    p: float


@dataclass
class ColumnEstimate:
    """A value of each draw of an ensemble. Its statistics are taken by the ensemble's `summary`, many in one pass."""

    column: Column
    ensemble: FrameEnsemble

    def _with(self, o, f: Callable[[Column, Column], Column]) -> ColumnEstimate:
        if isinstance(o, ColumnEstimate):
            if o.ensemble is not self.ensemble:
                raise ValueError("estimates of two sources have no draws in common")
            return ColumnEstimate(f(self.column, o.column), self.ensemble)
        return ColumnEstimate(f(self.column, F.lit(float(o))), self.ensemble)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: F.when(a.isNotNull(), ieee_div(a, b)))

    def mean(self) -> Column:
        return F.avg(self.column)

    def std(self) -> Column:
        return F.stddev_samp(self.column)

    def covariance(self, o: ColumnEstimate) -> Column:
        return self._with(o, F.covar_samp).column

    def quantile(self, p: float) -> Quantile:
        if not 0 <= p <= 1:
            raise ValueError("a quantile lies between 0 and 1")
        return Quantile(self.column, p)

    def median(self) -> Quantile:
        return self.quantile(0.5)

    def interval(self, level: float = 0.6827) -> tuple[Quantile, Quantile]:
        return self.quantile((1 - level) / 2), self.quantile((1 + level) / 2)


@dataclass
class FrameEnsemble:
    """Parameter points of one source: a row for each draw, a double column for each parameter."""

    names: list[str]
    frame: DataFrame

    @classmethod
    def from_chain(cls, names: Sequence[str], chain: DataFrame, discard: int = 0, thin: int = 1, step: str = "step") -> FrameEnsemble:
        """A chain (a row for each step and walker, a column for each parameter) without its start, every thin-th step."""
        at = F.col(f"`{step}`") - discard
        kept = chain.where((at >= 0) & (at % thin == 0))
        return cls(list(names), kept.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names]))

    def __getitem__(self, name: str) -> ColumnEstimate:
        if name not in self.names:
            raise KeyError(name)
        return ColumnEstimate(F.col(f"`{name}`"), self)

    def resident(self) -> FrameEnsemble:
        """Keep the draws in memory, spilling to disk."""
        self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def streaming(self) -> FrameEnsemble:
        """Make the draws again for every use."""
        self.frame.unpersist()
        return self

    def summary(self, **statistics: Column | Quantile) -> dict[str, float | None]:
        """The number of draws as `draws`, and the statistics: one pass for sums, and those of `quantiles`. As in SQL, a null
        does not count and what too few draws leave open is null."""
        plain = {k: v for k, v in statistics.items() if not isinstance(v, Quantile)}
        ranked = {k: v for k, v in statistics.items() if isinstance(v, Quantile)}
        out = self.frame.agg(F.count(F.lit(1)).alias("draws"), *[v.alias(k) for k, v in plain.items()]).first().asDict()
        return out | dict(zip(ranked, quantiles(self.frame, [(q.column, q.p) for q in ranked.values()]), strict=True))
