"""What a source of events promises, and the sources that promise it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import SparkSession

from ..dataset import Dataset


@dataclass(frozen=True)
class SourceCapabilities:
    """known_length: the number of events is known without reading them; fragments: parts can be read apart, by several
    tasks; rereadable: every read gives the same events; projection: columns that are not asked for are not read."""

    known_length: bool = False
    fragments: bool = False
    rereadable: bool = True
    projection: bool = False


@runtime_checkable
class EventSource(Protocol):
    """Something that events can be read from."""

    def load(self, spark: SparkSession) -> Dataset: ...

    def capabilities(self) -> SourceCapabilities: ...


@runtime_checkable
class FragmentedSource(EventSource, Protocol):
    """A source whose parts can be read apart: fragment i of n, all of which together are the source, in order."""

    def fragment(self, spark: SparkSession, index: int, count: int) -> Dataset: ...


def fragments(source: FragmentedSource, spark: SparkSession, count: int) -> list[Dataset]:
    return [source.fragment(spark, i, count) for i in range(count)]


def part(ds: Dataset, index: int, count: int) -> Dataset:
    """Events index / count up to (index + 1) / count of a dataset."""
    if not 0 <= index < count:
        raise ValueError(f"no fragment {index} of {count}")
    n = ds.num_events()
    return ds.slice(n * index // count, n * (index + 1) // count)
