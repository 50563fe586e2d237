"""Bins. Three conventions that must not be mixed: bin_by keeps the last edge, histograms have flow, axes drop the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def check_edges(edges: Sequence[float]) -> tuple[float, ...]:
    out = tuple(float(e) for e in edges)
    if len(out) < 2 or not all(map(math.isfinite, out)) or any(a >= b for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("edges must be two or more finite, strictly increasing numbers")
    return out


@dataclass(frozen=True)
class Bins:
    """Edges of bins that are closed on the left."""

    edges: tuple[float, ...]

    def __post_init__(self):
        object.__setattr__(self, "edges", check_edges(self.edges))

    @classmethod
    def uniform(cls, n: int, low: float, high: float) -> Bins:
        if n < 1:
            raise ValueError("at least one bin")
        width = (high - low) / n
        return cls(tuple(low + i * width for i in range(n)) + (high,))

    def __len__(self):
        return len(self.edges) - 1

    @property
    def widths(self) -> np.ndarray:
        return np.diff(self.edges)

    def index(self, x: Column, last_closed: bool = False) -> Column:
        """The bin of a column, null outside and for NaN. Even bins by arithmetic that the edges then correct, others by
        a balanced search; both stay inside generated code."""
        e, n = self.edges, len(self)
        inside = ~F.isnan(x) & (x >= e[0]) & ((x <= e[-1]) if last_closed else (x < e[-1]))
        if n > 8 and e == Bins.uniform(n, e[0], e[-1]).edges:
            width = (e[-1] - e[0]) / n
            edge = lambda k: F.when(k >= n, e[-1]).otherwise(F.lit(e[0]) + k * width)
            guess = F.least(F.floor((x - e[0]) / width).cast("int"), F.lit(n - 1))
            right = F.when(x < edge(guess), guess - 1).when((x >= edge(guess + 1)) & (guess < n - 1), guess + 1).otherwise(guess)
            return F.when(inside, right.cast("int"))
        return F.when(inside, _search(x, e, 0, n - 1))

    def find(self, x: np.ndarray, last_closed: bool = False) -> np.ndarray:
        """The bin of each value, -1 outside and for NaN."""
        x = np.asarray(x, float)
        i = np.searchsorted(self.edges, x, "right") - 1
        if last_closed:
            i = np.where(x == self.edges[-1], len(self) - 1, i)
        return np.where(np.isfinite(x) & (i >= 0) & (i < len(self)), i, -1)


def _search(x: Column, edges: tuple[float, ...], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(x >= edges[mid], _search(x, edges, mid, hi)).otherwise(_search(x, edges, lo, mid - 1))
