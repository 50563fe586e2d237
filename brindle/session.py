"""What this installation can do, execution options, and memory budgets (Spark's memory manager decides)."""

from __future__ import annotations

import importlib.util
import os
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import SparkSession

from . import __version__


def capabilities() -> dict[str, object]:
    """Features by name."""
    return {
        "version": __version__,
        "spark": pyspark.__version__,
        "backend": "spark",
        "precisions": ["f64"],
        "autodiff": ["symbolic forward"],
        "normalization": ["auto", "general", "statistics", "verify"],
        "distributed": True,
        "gpu": False,
        "jit": "whole-stage code generation",
        "mpi": False,
        "root_files": importlib.util.find_spec("uproot") is not None,
    }


def host_memory() -> tuple[int, int]:
    """Bytes in all and available on this machine."""
    page = os.sysconf("SC_PAGE_SIZE")
    return page * os.sysconf("SC_PHYS_PAGES"), page * os.sysconf("SC_AVPHYS_PAGES")


@dataclass(frozen=True)
class MemoryBudget:
    """Bytes, or a share of all or of available memory."""

    kind: str
    amount: float

    @classmethod
    def bytes(cls, n: int) -> MemoryBudget:
        return cls("bytes", n)

    @classmethod
    def percent_total(cls, p: float) -> MemoryBudget:
        return cls("total", p)

    @classmethod
    def percent_available(cls, p: float) -> MemoryBudget:
        return cls("available", p)

    def __post_init__(self):
        if self.kind != "bytes" and not 0 < self.amount <= 100:
            raise ValueError("a share lies above 0 and up to 100 percent")
        if self.kind == "bytes" and self.amount < 0:
            raise ValueError("a budget is not negative")

    def resolve(self) -> int:
        total, free = host_memory()
        return int(self.amount if self.kind == "bytes" else (total if self.kind == "total" else free) * self.amount / 100)

    def rows(self, columns: int) -> int:
        """Rows of double columns that fit."""
        return max(1, self.resolve() // (8 * max(1, columns)))


@dataclass(frozen=True)
class Execution:
    """Options of a run; `apply` sets what Spark has settings for."""

    precision: str = "f64"
    normalization: str = "auto"
    shuffle_partitions: int | None = None
    batch_rows: int | None = None
    adaptive: bool = True
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.precision != "f64":
            raise ValueError("only f64 is supported")
        if self.normalization not in ("auto", "general", "statistics", "verify"):
            raise ValueError(self.normalization)

    def apply(self, spark: SparkSession) -> SparkSession:
        spark.conf.set("spark.sql.adaptive.enabled", self.adaptive)
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
        if self.batch_rows:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", self.batch_rows)
        for k, v in self.extra.items():
            spark.conf.set(k, v)
        return spark
