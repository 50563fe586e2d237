"""Shared pieces of the training-data operators: column picking, durable tables, word arrays."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer single text is a step of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Seconds between two times that a Python worker gives memory back while it makes batches.
GIVE_BACK_S = 0.2

#: The characters that part words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text is an empty one, other columns go."""
    return df.select(*pick_columns(id_col, text_col))


def pick_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What pick selects."""
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset, a folder of this process, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, dropped when the application ends."""
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back; survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow over batches of bounded size, so that a Python worker's memory does not follow the rows' length.

    The bound is a setting of the session, as Spark has no other; one that was set before stays. Workers outlive their
    tasks, so what a batch needed goes back to the system after it, not to the next stage's cost.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, f"{BATCH_BYTES >> 20}m")

    def run(batches):
        last = time.monotonic()
        for b in f(batches):
            yield b
            del b
            if time.monotonic() - last > GIVE_BACK_S:
                give_back()
                last = time.monotonic()
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory, which Arrow and the C library keep for themselves, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def drop(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about `limit` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        off = offsets(col)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def offsets(col: pa.Array) -> np.ndarray:
    """The byte offsets (n + 1) of a string or binary array."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets into them."""
    off = offsets(col)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts.

    data: the texts' bytes; start, end: each word's bytes in data; doc: words before each text (n + 1).
    """

    def __init__(self, col: pa.Array):
        self.data, self.text = text_bytes(col)
        ink = ~SPACE[self.data]
        n = len(ink)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.doc = np.zeros(len(self.text), np.int64)
            self.ink = ink
            return
        edge = np.zeros(n + 1, bool)
        edge[self.text] = True
        first = ink.copy()
        first[1:] &= ~ink[:-1] | edge[1:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:] | edge[1:-1]
        self.start, self.end, self.ink = np.flatnonzero(first), np.flatnonzero(last) + 1, ink
        self.doc = np.searchsorted(self.start, self.text)

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.BinaryArray:
        """The words as one binary array."""
        off = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.end - self.start, out=off[1:])
        return pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(off), pa.py_buffer(self.data[self.ink])])

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word in the list of different words, and that list."""
        if not len(self):
            return np.zeros(0, np.int64), []
        d = self.array().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] for every i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    out = np.repeat(starts - before, lengths)
    out += np.arange(total, dtype=np.int64)
    return out


def binary_rows(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array of data[off[i]:off[i + 1]]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
