"""Datasets: a lazy DataFrame of weighted events with its schema."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .operators.binning import Bins
from .operators.predicate import Predicate
from .operators.sampling import poisson1, uniform01
from .plans.evaluate import evaluate
from .plans.expr import Expr
from .plans.facts import is_real
from .plans.lower import Lowered, NotLowerable
from .plans.rewrite import simplify
from .schema import EventSchema, SchemaError

ID = "_event_id"
#: Rows of a block when ids are made dense again: one count for each reaches the driver.
BLOCK = 1 << 20


@dataclass
class Dataset:
    """Events in a DataFrame; `schema` names its columns. Operators are lazy and return new datasets.

    The id column is dense from 0 in source order. Filters keep ids; select, which makes a new source, gives dense ones
    again when they are next needed. Weights are 1 where the schema has none.
    """

    frame: DataFrame
    schema: EventSchema
    dense: bool = True
    options: dict = field(default_factory=dict)
    _stats: dict = field(default_factory=dict, repr=False)

    # -- sources ---------------------------------------------------------------------------------------------------

    @classmethod
    def from_frame(cls, frame: DataFrame, schema: EventSchema | None = None, id_col: str | None = None, **infer) -> Dataset:
        """Events of a DataFrame whose id column orders them. Without one ids are made from the rows' order in their
        partitions, which only a source with fixed partitions keeps."""
        plain = frame.drop(id_col) if id_col else frame
        schema = schema or EventSchema.infer(plain.schema, **infer)
        schema.check(frame.schema)
        cols = [F.col(f"`{c}`").cast("double").alias(c) for c in schema.columns()]
        if id_col:
            return cls(frame.select(*cols, F.col(f"`{id_col}`").cast("long").alias(ID)), schema)
        loose = frame.select(*cols, F.monotonically_increasing_id().alias(ID))
        return cls(loose, schema, dense=False)

    @classmethod
    def from_arrays(cls, spark: SparkSession, p4s: Mapping[str, np.ndarray] | None = None, scalars: Mapping[str, np.ndarray] | None = None, weights: np.ndarray | None = None) -> Dataset:
        """Four-momenta as (n, 4) arrays E, px, py, pz; scalars and weights of length n."""
        cols: dict[str, np.ndarray] = {}
        for name, v in (p4s or {}).items():
            v = np.asarray(v, float)
            if v.ndim != 2 or v.shape[1] != 4:
                raise SchemaError(f"{name}: shape (n, 4) is needed, not {v.shape}")
            cols |= {f"{name}_{c}": v[:, k] for k, c in enumerate(("e", "px", "py", "pz"))}
        cols |= {k: np.asarray(v, float) for k, v in (scalars or {}).items()}
        if weights is not None:
            cols["weight"] = np.asarray(weights, float)
        if len({len(v) for v in cols.values()}) != 1:
            raise SchemaError("arrays of one length are needed")
        schema = EventSchema(tuple(p4s or ()), tuple(scalars or ()), weights is not None)
        n = len(next(iter(cols.values())))
        table = pa.table({**{c: cols[c] for c in schema.columns()}, ID: np.arange(n)})
        return cls(spark.createDataFrame(table), schema)

    @classmethod
    def from_batches(cls, spark: SparkSession, batches: Iterable[Mapping] | Callable[..., Iterable[Mapping]], schema: EventSchema, ranks: int = 1) -> Dataset:
        """Batches {p4s, scalars, weights} of one schema, one after another.

        A callable is called by the tasks that read it, never by the driver, and may be called again: f() by one task, or
        f(rank, ranks) by `ranks` tasks, whose events follow one another by rank. Batches that are at hand already go as
        one table. A batch of another schema is an error, raised when it is read.
        """
        cols, names = schema.columns(), [*schema.columns(), ID]

        def table(b: Mapping, start: int) -> pa.Table:
            p4s, scalars, weights = b.get("p4s") or {}, b.get("scalars") or {}, b.get("weights")
            got = EventSchema(tuple(p4s), tuple(scalars), weights is not None, schema.weight)
            if got != schema:
                raise SchemaError(f"a batch has {got}, not {schema}")
            flat: dict[str, np.ndarray] = {}
            for name, v in p4s.items():
                v = np.asarray(v, float)
                if v.ndim != 2 or v.shape[1] != 4:
                    raise SchemaError(f"{name}: shape (n, 4) is needed, not {v.shape}")
                flat |= {f"{name}_{c}": v[:, k] for k, c in enumerate(("e", "px", "py", "pz"))}
            flat |= {k: np.asarray(v, float) for k, v in scalars.items()}
            if weights is not None:
                flat[schema.weight] = np.asarray(weights, float)
            if len({len(v) for v in flat.values()}) != 1:
                raise SchemaError("arrays of one length are needed")
            n = len(flat[cols[0]])
            return pa.table({**{c: flat[c] for c in cols}, ID: np.arange(start, start + n)})

        if callable(batches):
            split = ranks > 1

            def run(parts):
                for p in parts:
                    for rank in p.column(0).to_pylist():
                        at = rank << 40  # room for a million million events of each rank
                        for b in batches(rank, ranks) if split else batches():
                            t = table(b, at)
                            at += len(t)
                            yield from t.to_batches()

            frame = spark.range(0, ranks, numPartitions=ranks).mapInArrow(run, ", ".join(f"`{c}` double" for c in cols) + f", {ID} long")
            return cls(frame, schema, dense=not split)
        made, at = [], 0
        for b in batches:
            made.append(table(b, at))
            at += len(made[-1])
        kind = pa.schema([(c, pa.int64() if c == ID else pa.float64()) for c in names])
        return cls(spark.createDataFrame(pa.concat_tables(made) if made else kind.empty_table()), schema)

    # -- introspection ---------------------------------------------------------------------------------------------

    @property
    def p4_names(self) -> tuple[str, ...]:
        return self.schema.p4s

    @property
    def scalar_names(self) -> tuple[str, ...]:
        return self.schema.scalars

    @property
    def weight(self) -> Column:
        return F.col(f"`{self.schema.weight}`") if self.schema.has_weight else F.lit(1.0)

    def _with(self, frame: DataFrame, **change) -> Dataset:
        return Dataset(frame, change.get("schema", self.schema), change.get("dense", self.dense), self.options)

    def with_ids(self) -> Dataset:
        """The same events with dense ids in the order of the present ones.

        Ids are ranked within blocks of the old ids, and blocks follow one another: a shuffle by block, and one count
        per block on the driver; independent of partitions and repeatable.
        """
        if self.dense:
            return self
        blocks = self.frame.withColumn("__block", F.floor(F.col(ID) / BLOCK))
        counts = sorted((r["__block"], r["n"]) for r in blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect())
        before = np.cumsum([0] + [n for _, n in counts])[:-1].tolist()
        rank = F.row_number().over(Window.partitionBy("__block").orderBy(ID)).cast("long") - 1
        if counts:
            table = self.frame.sparkSession.createDataFrame([(b, int(o)) for (b, _), o in zip(counts, before, strict=True)], "__block long, __before long")
            frame = blocks.withColumn("__rank", rank).join(F.broadcast(table), "__block").withColumn(ID, F.col("__before") + F.col("__rank"))
        else:
            frame = blocks
        return self._with(frame.select(*[f"`{c}`" for c in self.schema.columns()], ID), dense=True)

    # -- caching ---------------------------------------------------------------------------------------------------

    def resident(self) -> Dataset:
        """Keep the events in memory, spilling to disk."""
        return self._with(self.frame.persist(StorageLevel.MEMORY_AND_DISK))

    def streaming(self) -> Dataset:
        """Read the source again for every use."""
        return self._with(self.frame.unpersist())

    fastest = resident

    def chunked(self, rows: int) -> Dataset:
        """Rows of an Arrow batch of this session's Python kernels."""
        self.frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        return self

    def with_memory_budget(self, budget) -> Dataset:
        """Recorded; Spark's memory manager decides."""
        return Dataset(self.frame, self.schema, self.dense, {**self.options, "memory_budget": budget})

    # -- filters and samples ---------------------------------------------------------------------------------------

    def filter(self, test: Column | Callable[[pd.DataFrame], pd.Series]) -> Dataset:
        """Events for which a column, or a function of a pandas batch, is true. Ids stay."""
        if isinstance(test, Column):
            return self._with(self.frame.where(test))
        frame = self.frame

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[np.asarray(test(b), bool)]

        return self._with(frame.mapInPandas(run, frame.schema))

    def select(self, predicate: Predicate) -> Dataset:
        """Events for which a predicate holds, as a new source."""
        exprs = [query(e) for e in predicate.exprs()]
        try:
            low = Lowered(self.frame, exprs)
            real = {id(e): p.re for e, p in zip(predicate.exprs(), low.pairs(), strict=True)}
            frame = low.frame.where(predicate.column(real)).select(*self.frame.columns)
        except NotLowerable:
            names = self.schema.columns()
            frame = self.filter(lambda b: predicate.mask({c: b[c].to_numpy() for c in names})).frame
        return self._with(frame, dense=False)

    def subsample(self, fraction: float, seed: int = 0) -> Dataset:
        """Events whose uniform number is below the fraction. The same seed gives bootstrap the same numbers, so that
        a subsample of at most 1/e bootstrapped with its own seed has no weight left."""
        if not 0 <= fraction <= 1:
            raise ValueError("the fraction lies in 0 .. 1")
        d = self.with_ids()
        return d._with(d.frame.where(uniform01(seed, F.col(ID)) < fraction))

    def bootstrap(self, seed: int = 0) -> Dataset:
        """Weights times a Poisson(1) count."""
        d = self.with_ids()
        schema = EventSchema(self.schema.p4s, self.schema.scalars, True, self.schema.weight)
        frame = d.frame.withColumn(schema.weight, d.weight * poisson1(uniform01(seed, F.col(ID))))
        return d._with(frame.select(*[f"`{c}`" for c in schema.columns()], ID), schema=schema)

    def reweight(self, weight: Column | Expr) -> Dataset:
        """New weights from a column or a real expression."""
        schema = EventSchema(self.schema.p4s, self.schema.scalars, True, self.schema.weight)
        frame = self.frame
        if isinstance(weight, Expr):
            low = Lowered(frame, [query(weight, real=True)])
            frame, weight = low.frame, low.pairs()[0].re
        return self._with(frame.withColumn(schema.weight, weight).select(*[f"`{c}`" for c in schema.columns()], ID), schema=schema)

    def slice(self, start: int, end: int) -> Dataset:
        """Events start .. end - 1 in order."""
        d = self.with_ids()
        return d._with(d.frame.where((F.col(ID) >= start) & (F.col(ID) < end)), dense=False)

    def strided(self, n: int, rank: int) -> Dataset:
        """Every n-th event."""
        d = self.with_ids()
        return d._with(d.frame.where(F.pmod(F.col(ID), F.lit(n)) == rank), dense=False)

    def rows(self, ids: Sequence[int]) -> Dataset:
        """The events with the given ids."""
        d = self.with_ids()
        return d._with(d.frame.where(F.col(ID).isin([int(i) for i in ids])), dense=False)

    def bin_by(self, expr: Expr, bins: Bins) -> BinnedDataset:
        """Events by bin of a real expression, the last edge included; others and NaN go."""
        low = Lowered(self.frame, [query(expr, real=True)])
        frame = low.frame.withColumn("bin", bins.index(low.pairs()[0].re, last_closed=True)).where("bin is not null")
        return BinnedDataset(self, frame.select(*self.frame.columns, "bin"), bins)

    # -- reductions ------------------------------------------------------------------------------------------------

    def stats(self) -> tuple[int, float]:
        """(events, sum of weights), computed once."""
        if "stats" not in self._stats:
            r = self.frame.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(self.weight), F.lit(0.0)).alias("w")).first()
            self._stats["stats"] = (int(r.n), float(r.w))
        return self._stats["stats"]

    def num_events(self) -> int:
        return self.stats()[0]

    __len__ = num_events

    def sum_weights(self) -> float:
        return self.stats()[1]

    def weighted_sum(self, expr: Expr | Column, accurate: bool = False) -> float:
        """The sum of weight times a real expression; `accurate` rounds it once, whatever the order of events."""
        if accurate:
            from .operators.accurate import accurate_sums

            return accurate_sums(self, [query(expr, real=True)])[0].real
        if isinstance(expr, Column):
            return float(self.frame.agg(F.coalesce(F.sum(self.weight * expr), F.lit(0.0))).first()[0])
        return self.weighted_complex_sum(query(expr, real=True)).real

    def weighted_complex_sum(self, expr: Expr) -> complex:
        from .operators.reduce import weighted_sums

        return complex(weighted_sums(self, [query(expr)])[0])

    # -- values in order -------------------------------------------------------------------------------------------

    def evaluate_frame(self, expr: Expr, values: Mapping[str, float] | None = None) -> DataFrame:
        """(_event_id, re, im) of a scalar expression."""
        e = simplify(expr)
        try:
            low = Lowered(self.frame, [e], values)
            p = low.pairs()[0]
            return low.frame.select(ID, p.re.alias("re"), p.imag.alias("im"))
        except NotLowerable:
            need = sorted(e.columns())

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    z = evaluate(e, {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(need, 1)}, values, b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z.real), pa.array(z.imag)], names=[ID, "re", "im"])

            return self.frame.select(ID, *[f"`{c}`" for c in need]).mapInArrow(run, f"{ID} long, re double, im double")

    def evaluate(self, expr: Expr) -> np.ndarray:
        """Complex values in the order of events (on the driver)."""
        rows = self.evaluate_frame(query(expr)).orderBy(ID).toPandas()
        return rows["re"].to_numpy() + 1j * rows["im"].to_numpy()

    def evaluate_real(self, expr: Expr) -> np.ndarray:
        return self.evaluate(query(expr, real=True)).real

    def weights(self) -> np.ndarray:
        return self.frame.select(ID, self.weight.alias("w")).orderBy(ID).toPandas()["w"].to_numpy()

    def map_events(self, f: Callable) -> list:
        """f of every event (a row) in order."""
        return [f(r) for r in self.frame.orderBy(ID).toLocalIterator()]

    def fold_events(self, start, f: Callable):
        """An ordered fold on the driver, one partition in memory at a time."""
        for r in self.frame.orderBy(ID).toLocalIterator():
            start = f(start, r)
        return start

    def accumulate_events(self, state, f: Callable):
        """An ordered fold that changes its state."""
        for r in self.frame.orderBy(ID).toLocalIterator():
            f(state, r)
        return state

    def for_each_event(self, f: Callable) -> None:
        self.frame.foreach(f)

    def for_each_batch(self, f: Callable) -> None:
        self.frame.foreachPartition(f)

    def batches(self) -> Iterator[pd.DataFrame]:
        """Partitions in order as pandas frames."""
        rows: list = []
        for r in self.frame.orderBy(ID).toLocalIterator():
            rows.append(r)
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=self.frame.columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=self.frame.columns)

    def map_batches(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return self.frame.mapInPandas(lambda it: (f(b) for b in it), schema)

    # -- sinks -----------------------------------------------------------------------------------------------------

    def write_to(self, path: str, **options) -> None:
        from .sources.parquet import write_parquet

        write_parquet(self, path, **options)


@dataclass
class BinnedDataset:
    """A dataset with a bin column; item i is the dataset of bin i, empty ones included."""

    source: Dataset
    frame: DataFrame
    bins: Bins

    def __len__(self):
        return len(self.bins)

    def __getitem__(self, i: int) -> Dataset:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.source._with(self.frame.where(F.col("bin") == i).drop("bin"), dense=False)

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def limits(self, i: int) -> tuple[float, float]:
        return self.bins.edges[i], self.bins.edges[i + 1]

    def stats(self) -> DataFrame:
        """(bin, events, sum_weights) of the bins with events, in one pass."""
        return self.frame.groupBy("bin").agg(F.count(F.lit(1)).alias("events"), F.sum(self.source.weight).alias("sum_weights"))


def concat(parts: Sequence[Dataset]) -> Dataset:
    """Datasets of one schema, one after another."""
    first = parts[0]
    for p in parts:
        if p.schema != first.schema:
            raise SchemaError("datasets of different schemas")
    if len(parts) == 1:
        return first
    frame, base = None, 0
    for p in parts:
        p = p.with_ids()
        shifted = p.frame.withColumn(ID, F.col(ID) + base)
        frame = shifted if frame is None else frame.unionByName(shifted)
        base += p.num_events()
    return Dataset(frame, first.schema)


def query(expr: Expr, real: bool = False) -> Expr:
    """A scalar expression without free parameters, simplified; with `real`, one known to be real."""
    expr = Expr.of(expr)
    if expr.shape != ():
        raise ValueError(f"a scalar is needed, not shape {expr.shape}")
    free = [p.name for p in expr.parameters() if not p.fixed]
    if free:
        raise ValueError(f"free parameters: {', '.join(free)}")
    out = simplify(expr)
    if real and not is_real(out):
        raise ValueError("a real expression is needed")
    return out


def accurate_sum(values: Iterable[float]) -> float:
    """A sum without rounding but the last."""
    return math.fsum(values)
