"""Models: an expression with its parameters, evaluated over datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import ID, Dataset
from .operators.likelihood import Layout, merge
from .operators.reduce import REAL, reduce
from .plans import render
from .plans.expr import Expr, complex_, scalar
from .plans.facts import facts
from .plans.lower import Lowered
from .plans.rewrite import derivative, simplify


class Model:
    """A scalar expression and its parameter layout."""

    def __init__(self, expr: Expr):
        self.expr = Expr.of(expr)
        if self.expr.shape != ():
            raise ValueError(f"a scalar is needed, not shape {self.expr.shape}")
        self.layout: Layout = merge([self.expr.parameters()])

    def equation(self) -> str:
        return render.equation(self.expr)

    def latex(self) -> str:
        return render.latex(self.expr)

    def tree(self) -> str:
        return render.tree(self.expr)

    def dot(self, rules: Sequence[render.Style] = render.PRESET) -> str:
        return render.dot(self.expr, rules)

    def svg(self, rules: Sequence[render.Style] = render.PRESET) -> str:
        return render.svg(self.expr, rules)

    def parameter_names(self) -> list[str]:
        return self.layout.names()

    def default_parameters(self) -> np.ndarray:
        return self.layout.defaults()

    def sample_parameters(self, seed: int = 0) -> np.ndarray:
        return self.layout.sample(np.random.default_rng(seed))

    def projection(self, *tags: str) -> Model:
        return Model(self.expr.project(*tags))

    def fix(self, **values: float) -> Model:
        return Model(self.expr.fix(**values))

    def free(self, *names: str) -> Model:
        return Model(self.expr.free(*names))

    def values(self, x: Mapping[str, float] | Sequence[float] | None = None) -> dict[str, float]:
        if isinstance(x, Mapping):
            return dict(x)
        return self.layout.values(self.default_parameters() if x is None else x)

    def evaluate(self, ds: Dataset, x=None) -> DataFrame:
        """(_event_id, re, im) of every event."""
        return ds.evaluate_frame(self.expr, self.values(x))

    def evaluate_with_gradient(self, ds: Dataset, x=None) -> DataFrame:
        """(_event_id, value, d_<name> ...): the real part and its derivatives, in one projection."""
        names = self.parameter_names()
        low = Lowered(ds.frame, [simplify(self.expr), *[simplify(derivative(self.expr, n)) for n in names]], self.values(x))
        cols = [p.re.alias(c) for c, p in zip(["value", *[f"d_{n}" for n in names]], low.pairs(), strict=True)]
        return low.frame.select(ID, *cols)

    def value_and_gradient(self, ds: Dataset, x=None, transform: str = REAL) -> tuple[float, np.ndarray]:
        """The weighted sum over a dataset and its gradient, in one pass."""
        return reduce(ds, self.expr, transform, self.values(x), self.parameter_names())

    def cached(self, ds: Dataset) -> tuple[Dataset, Model]:
        """The dataset with the model's largest parameter-free parts as columns, kept in memory, and the model over them.

        Worth it where many parameter points follow: only what depends on parameters is computed again.
        """
        root = simplify(self.expr)
        known = facts(root)
        parts: list[Expr] = []
        fixed = {id(e) for e in root.nodes() if known[id(e)].event and not known[id(e)].free and e.shape == () and e.op not in ("scalar", "p4")}
        top = {id(a) for e in root.nodes() if id(e) not in fixed for a in e.args if id(a) in fixed}
        replaced: dict[int, Expr] = {}
        for e in root.nodes():
            if id(e) in top:
                k = len(parts)
                parts.append(e)
                replaced[id(e)] = scalar(f"cache_{k}_re") if known[id(e)].real else complex_(scalar(f"cache_{k}_re"), scalar(f"cache_{k}_im"))
            else:
                replaced[id(e)] = e.with_args(tuple(replaced[id(a)] for a in e.args))
        if not parts:
            return ds.resident(), Model(root)
        low = Lowered(ds.frame, parts)
        cols = {}
        for k, (e, p) in enumerate(zip(parts, low.pairs(), strict=True)):
            cols[f"cache_{k}_re"] = p.re
            if not known[id(e)].real:
                cols[f"cache_{k}_im"] = p.imag
        frame = low.frame.withColumns(cols).select(*ds.frame.columns, *cols)
        return Dataset(frame, ds.schema, ds.dense).resident(), Model(replaced[id(root)])


def parameter_table(spark, names: Sequence[str], draws) -> DataFrame:
    """Parameter points as a table (draw, names ...)."""
    return spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(draws)], "draw int" + "".join(f", `{n}` double" for n in names))


def covariance(table: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The sample covariance of a table's columns, in one aggregate."""
    r = table.agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).first()
    return np.array([[r[f"c{i}_{j}"] for j in range(len(names))] for i in range(len(names))])
