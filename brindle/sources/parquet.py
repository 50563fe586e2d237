"""Parquet sources and sinks."""

from __future__ import annotations

import glob as globbing
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..dataset import ID, Dataset
from ..schema import EventSchema, SchemaError
from .contract import SourceCapabilities, part


def resolve(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Paths of a source; local globs are expanded in name order, and a pattern without a match is an error."""
    out: list[str] = []
    for p in [path] if isinstance(path, str) else path:
        if "://" in p or p.startswith("file:"):
            out.append(p)
            continue
        found = sorted(globbing.glob(p))
        if not found:
            raise FileNotFoundError(f"nothing matches {p}")
        out += found
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, in local mode, a temporary one. It is
    removed when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/brindle-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def read_parquet(spark: SparkSession, path: str | Sequence[str], schema: EventSchema | None = None, columns: Sequence[str] | None = None, nulls: str = "error", validate: bool = True, rename: dict[str, str] | None = None, where: str | None = None, **infer) -> Dataset:
    """Events of Parquet files. Ids follow the files in name order, then the rows.

    Only columns of the schema are read. A null is an error (`nulls="error"`, raised when the events are read) or NaN; with
    "trust" the files are said to hold none, and then predicates reach the scan.
    `columns` restricts inference; `rename` maps event names to SQL expressions of physical columns, cast to double. `where` is a
    condition on any physical columns that reaches the scan; ids then keep the rows' places in the files.
    """
    paths = resolve(spark, path)
    frame = source = spark.read.parquet(*paths)
    if where:
        frame = frame.where(where)
    if rename:
        frame = frame.select(*[F.expr(x).cast("double").alias(n) for n, x in rename.items()], "_metadata")
    if columns:
        frame = frame.select(*[f"`{c}`" for c in columns], "_metadata")
    kinds = StructType([f for f in frame.schema if f.name != "_metadata"])
    schema = schema or EventSchema.infer(kinds, **infer)
    if validate:
        schema.check(kinds)
    if nulls not in ("error", "nan", "trust"):
        raise ValueError(f"nulls={nulls}")
    cols = []
    for c in schema.columns():
        x = F.col(f"`{c}`").cast("double")
        if nulls == "trust":
            cols.append(x.alias(c))
            continue
        gone = F.lit(float("nan")) if nulls == "nan" else F.raise_error(F.lit(f"null in column {c}")).cast("double")
        cols.append(F.coalesce(x, gone).alias(c))
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(source.inputFiles()) <= 1:  # one file needs no counts
        return Dataset(frame.select(*cols, at.cast("long").alias(ID)), schema, dense=not where)
    counts = sorted((r["f"], r["n"]) for r in source.groupBy(file.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for f, n in counts:
        rows.append((f, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(rows, "__file string, __before long"))
    joined = frame.withColumn("__f", file).withColumn("__at", at).join(offsets, F.col("__f") == F.col("__file"))
    return Dataset(joined.select(*cols, (F.col("__before") + F.col("__at")).alias(ID)), schema, dense=not where)


class ParquetSource:
    """A builder of read_parquet."""

    def __init__(self, path, **options):
        self.path, self.options = path, options

    def load(self, spark: SparkSession) -> Dataset:
        return read_parquet(spark, self.path, **self.options)

    def fragment(self, spark: SparkSession, index: int, count: int) -> Dataset:
        return part(self.load(spark), index, count)

    def capabilities(self) -> SourceCapabilities:
        return SourceCapabilities(known_length=not self.options.get("where"), fragments=True, projection=True)


def write_parquet(ds: Dataset, path: str, precision: str = "f64", weight: str = "always", single: bool = False, mode: str = "error") -> None:
    """Columns in the canonical order, as doubles or floats. weight: `always` writes unit weights too, `if_present` not.
    `single` gives one file."""
    kind = {"f64": "double", "f32": "float"}[precision]
    cols = [F.col(f"`{c}`").cast(kind).alias(c) for c in ds.schema.columns()]
    if not ds.schema.has_weight and weight == "always":
        cols.append(F.lit(1.0).cast(kind).alias(ds.schema.weight))
    out = ds.frame.select(*cols)
    (out.coalesce(1) if single else out).write.mode(mode).parquet(path)


class ParquetSink:
    """A writer with fixed options."""

    def __init__(self, path: str, **options):
        self.path, self.options = path, options

    def write(self, ds: Dataset) -> None:
        write_parquet(ds, self.path, **self.options)


def read_frame(frame: DataFrame, id_col: str, **columns) -> Dataset:
    """Events of any DataFrame: name=column pairs become scalars, `weight` the weight."""
    if not columns:
        raise SchemaError("name some columns")
    schema = EventSchema((), tuple(k for k in columns if k != "weight"), "weight" in columns)
    cols = [F.expr(v).cast("double").alias(k) if isinstance(v, str) else v.cast("double").alias(k) for k, v in columns.items()]
    return Dataset.from_frame(frame.select(*cols, F.col(f"`{id_col}`").alias(ID)), schema, id_col=ID)
