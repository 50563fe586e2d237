"""Histograms: right-open bins with underflow and overflow; errors add in quadrature."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from ..plans.lower import Lowered
from .binning import check_edges


@dataclass
class Histogram:
    """Counts and errors per bin. Without errors these are the roots of the counts' sizes."""

    counts: np.ndarray
    bin_edges: np.ndarray
    underflow: float = 0.0
    overflow: float = 0.0
    errors: np.ndarray | None = field(default=None)

    def __post_init__(self):
        self.bin_edges = np.array(check_edges(self.bin_edges))
        self.counts = np.array(self.counts, float)
        if len(self.counts) != len(self.bin_edges) - 1:
            raise ValueError("one count for each bin")
        self.errors = np.sqrt(np.abs(self.counts)) if self.errors is None else np.array(self.errors, float)
        if self.errors.shape != self.counts.shape or not (np.isfinite(self.errors).all() and (self.errors >= 0).all()):
            raise ValueError("errors are finite, not negative, one for each bin")
        if not (np.isfinite(self.counts).all() and math.isfinite(self.underflow) and math.isfinite(self.overflow)):
            raise ValueError("counts are finite")

    @classmethod
    def empty(cls, bins: int, low: float, high: float) -> Histogram:
        return cls(np.zeros(bins), np.linspace(low, high, bins + 1))

    @classmethod
    def empty_with_edges(cls, edges) -> Histogram:
        return cls(np.zeros(len(edges) - 1), edges)

    @classmethod
    def from_values(cls, values, bins: int, low: float, high: float, weights=None) -> Histogram:
        return cls.from_values_with_edges(values, np.linspace(low, high, bins + 1), weights)

    @classmethod
    def from_values_with_edges(cls, values, edges, weights=None) -> Histogram:
        out = cls.empty_with_edges(edges)
        x = np.asarray(values, float)
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        if not (np.isfinite(x).all() and np.isfinite(w).all()):
            raise ValueError("values and weights are finite")
        i = np.searchsorted(out.bin_edges, x, "right")
        n = len(out.counts)
        sums = np.bincount(i, w, n + 2)
        out.underflow, out.counts, out.overflow = float(sums[0]), sums[1 : n + 1], float(sums[n + 1])
        out.errors = np.sqrt(np.bincount(i, w * w, n + 2)[1 : n + 1])
        return out

    @classmethod
    def of_dataset(cls, ds, expr, edges) -> Histogram:
        """The histogram of a real expression over weighted events: one aggregate keyed by bin, flow included."""
        from ..dataset import query

        edges = check_edges(edges)
        low = Lowered(ds.frame, [query(expr, real=True)])
        x, w, n = low.pairs()[0].re, ds.weight, len(edges) - 1
        slot = F.when(F.isnan(x) | F.isnan(w) | (F.abs(x) == math.inf) | (F.abs(w) == math.inf), -2).when(x < edges[0], -1).when(x >= edges[-1], n)
        from .binning import _search

        rows = low.frame.groupBy(slot.otherwise(_search(x, edges, 0, n - 1)).alias("b")).agg(F.sum(w).alias("c"), F.sqrt(F.sum(w * w)).alias("e")).collect()
        got = {r.b: r for r in rows}
        if -2 in got:
            raise ValueError("values and weights are finite")
        at = lambda k, f: float(got[k][f]) if k in got else 0.0
        return cls([at(k, "c") for k in range(n)], edges, at(-1, "c"), at(n, "c"), [at(k, "e") for k in range(n)])

    # -- filling ---------------------------------------------------------------------------------------------------

    def fill(self, value: float, weight: float = 1.0, error: float | None = None) -> None:
        """Add a value; its error is the weight's size unless given."""
        if not (math.isfinite(value) and math.isfinite(weight)):
            raise ValueError("values and weights are finite")
        if value < self.bin_edges[0]:
            self.underflow += weight
        elif value >= self.bin_edges[-1]:
            self.overflow += weight
        else:
            i = self.bin_index(value)
            self.counts[i] += weight
            self.errors[i] = math.hypot(self.errors[i], abs(weight) if error is None else error)

    def bin_index(self, value: float) -> int | None:
        if not self.bin_edges[0] <= value < self.bin_edges[-1]:
            return None
        return int(np.searchsorted(self.bin_edges, value, "right")) - 1

    def set_bin(self, i: int, count: float, error: float | None = None) -> None:
        self.counts[i] = count
        self.errors[i] = math.sqrt(abs(count)) if error is None else error

    def set_counts(self, counts) -> None:
        new = Histogram(counts, self.bin_edges)
        self.counts, self.errors = new.counts, new.errors

    def set_errors(self, errors) -> None:
        self.errors = Histogram(self.counts, self.bin_edges, errors=errors).errors

    # -- figures ---------------------------------------------------------------------------------------------------

    @property
    def bins(self) -> int:
        return len(self.counts)

    @property
    def limits(self) -> tuple[float, float]:
        return float(self.bin_edges[0]), float(self.bin_edges[-1])

    def bin_center(self, i: int) -> float:
        return float(self.bin_edges[i] + self.bin_edges[i + 1]) / 2

    def total_weight(self, flow: bool = False) -> float:
        return math.fsum(self.counts) + (self.underflow + self.overflow if flow else 0.0)

    def _over(self, total: float) -> Histogram:
        if total == 0 or not math.isfinite(total):
            raise ZeroDivisionError("a histogram without weight has no normal form")
        return Histogram(self.counts / total, self.bin_edges, self.underflow / total, self.overflow / total, self.errors / abs(total))

    def normalized(self, flow: bool = False) -> Histogram:
        return self._over(self.total_weight(flow))

    def density(self, signed: bool = False) -> np.ndarray:
        """Per unit of the value; negative counts only if `signed`."""
        if not signed and (self.counts < 0).any():
            raise ValueError("negative counts have no density")
        total = self.total_weight()
        if total == 0:
            raise ZeroDivisionError("a histogram without weight has no density")
        return self.counts / (total * np.diff(self.bin_edges))

    def sample(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Values by the inverse distribution: u picks bins, v places within them."""
        if (self.counts < 0).any() or self.total_weight() <= 0:
            raise ValueError("counts are not negative, and some are positive")
        c = np.cumsum(self.counts) / self.counts.sum()
        i = np.minimum(np.searchsorted(c, u, "right"), np.flatnonzero(self.counts)[-1])
        return self.bin_edges[i] + np.asarray(v) * np.diff(self.bin_edges)[i]

    def to_json(self) -> str:
        return json.dumps({"counts": self.counts.tolist(), "bin_edges": self.bin_edges.tolist(), "underflow": self.underflow, "overflow": self.overflow, "errors": self.errors.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Histogram:
        return cls(**json.loads(text))
