"""Streams of events: the stateless operators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicate import Predicate
from ..plans.expr import Expr
from ..plans.lower import Lowered
from ..schema import EventSchema


def read_stream(spark: SparkSession, path: str, schema: EventSchema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(", ".join(f"`{c}` double" for c in schema.columns())).parquet(path)


def select_stream(frame: DataFrame, predicate: Predicate) -> DataFrame:
    """Events for which a predicate holds, as they come."""
    from ..dataset import query

    exprs = predicate.exprs()
    low = Lowered(frame, [query(e) for e in exprs])
    real = {id(e): p.re for e, p in zip(exprs, low.pairs(), strict=True)}
    return low.frame.where(predicate.column(real)).select(*frame.columns)


def evaluate_stream(frame: DataFrame, name: str, expr: Expr) -> DataFrame:
    """The stream with a real expression's value as one more column."""
    from ..dataset import query

    low = Lowered(frame, [query(expr, real=True)])
    return low.frame.withColumn(name, low.pairs()[0].re).select(*frame.columns, name)


def weighted_totals(frame: DataFrame, weight: str = "weight") -> DataFrame:
    """Running number of events and sum of weights (complete mode)."""
    return frame.agg(F.count(F.lit(1)).alias("events"), F.sum(weight).alias("sum_weights"))
