"""Sources and sinks in memory, and user factories of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import SparkSession

from ..dataset import Dataset
from ..schema import EventSchema
from .contract import SourceCapabilities, part


class MemorySource:
    """Arrays, held by Spark."""

    def __init__(self, p4s: Mapping | None = None, scalars: Mapping | None = None, weights=None):
        self.args = (p4s, scalars, weights)

    def load(self, spark: SparkSession) -> Dataset:
        return Dataset.from_arrays(spark, *self.args)

    def fragment(self, spark: SparkSession, index: int, count: int) -> Dataset:
        return part(self.load(spark), index, count)

    def capabilities(self) -> SourceCapabilities:
        return SourceCapabilities(known_length=True, fragments=True, projection=True)


class BatchSource:
    """A factory of batches {p4s, scalars, weights}, which may be called again: f(), read by one task, or f(rank, ranks),
    called by as many tasks as there are ranks."""

    def __init__(self, factory: Callable[..., Iterable[Mapping]], schema: EventSchema, ranks: int = 1):
        self.factory, self.schema, self.ranks = factory, schema, ranks

    def load(self, spark: SparkSession) -> Dataset:
        return Dataset.from_batches(spark, self.factory, self.schema, self.ranks)

    def capabilities(self) -> SourceCapabilities:
        return SourceCapabilities()


class MemorySink:
    """Keeps what is written."""

    def __init__(self):
        self.dataset: Dataset | None = None

    def write(self, ds: Dataset) -> None:
        self.dataset = ds.resident()


class BatchBuilder:
    """Collects events one by one; all of them have a weight, or none."""

    def __init__(self, schema: EventSchema):
        self.schema, self.rows = schema, []

    def push(self, values: Mapping[str, float], weight: float | None = None) -> None:
        if (weight is not None) != self.schema.has_weight:
            raise ValueError("events of one batch all have a weight, or none has")
        row = dict(values) | ({self.schema.weight: weight} if weight is not None else {})
        self.rows.append(tuple(float(row[c]) for c in self.schema.columns()))

    def finish(self, spark: SparkSession) -> Dataset:
        from ..dataset import ID

        cols = self.schema.columns()
        frame = spark.createDataFrame([(*r, i) for i, r in enumerate(self.rows)], ", ".join(f"`{c}` double" for c in cols) + f", {ID} long")
        return Dataset(frame, self.schema)
