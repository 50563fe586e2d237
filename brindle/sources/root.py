"""ROOT files: read through a Python library where one is installed; the error says so where none is."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dataset import ID, Dataset


def read_root(spark: SparkSession, path: str, tree: str | None = None, columns: list[str] | None = None) -> Dataset:
    """Events of one tree; without a name, of the file's first."""
    try:
        import uproot
    except ImportError:
        raise NotImplementedError("reading ROOT files needs the uproot library, which is not installed") from None
    with uproot.open(path) as f:
        names = [k for k, v in f.items() if hasattr(v, "arrays")]
        if not names:
            raise ValueError(f"{path} has no tree")
        frame = f[tree or names[0]].arrays(columns, library="pd")
    frame["_row"] = range(len(frame))
    return Dataset.from_frame(spark.createDataFrame(frame), id_col="_row")


def write_root(ds: Dataset, path: str, tree: str = "events") -> None:
    """Events as one tree of doubles, on the driver."""
    try:
        import uproot
    except ImportError:
        raise NotImplementedError("writing ROOT files needs the uproot library, which is not installed") from None
    frame = ds.frame.orderBy(ID).select(*[f"`{c}`" for c in ds.schema.columns()]).toPandas()
    with uproot.recreate(path) as f:
        f[tree] = {c: frame[c].to_numpy() for c in frame.columns}
