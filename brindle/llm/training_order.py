"""Training-order materialisation: a keyed Feistel permutation gives every sequence a slot; ranges of slots become
fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, binary_rows, drop, durable, new_path, pick, ragged, text_slices
from .packing import tokens_of

#: Tokens of a sequence, and bytes of a stored id (unsigned, little-endian).
SEQ_LEN, ID_BYTES = 2048, 2
#: Sequences of a shard; every shard but the last has exactly so many, so that a slot's place is a division.
PER_SHARD = 1 << 14
ROUNDS = 6


def _round(x: np.ndarray, key: int, k: int) -> np.ndarray:
    """One round's keyed mixing of half a word."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((key + 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1: a balanced Feistel network over the next even number of bits, walked along its
    cycle until the value falls below n (under four steps on average)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    width = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> width, x & mask
        for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                a, b = b ^ (_round(a, key, k) & mask), a
            else:
                a, b = b, a ^ (_round(b, key, k) & mask)
        return a << width | b

    x = once(index.astype(np.uint64))
    out = x >= np.uint64(n)
    while out.any():
        x[out] = once(x[out])
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def sequences(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = 1, id_bytes: int = ID_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_ids, start, n_tokens, ids (binary, seq_len ids of id_bytes bytes), ids_crc32.

    Texts that a task reads together are laid end to end, each closed by end_id, and cut every seq_len ids; only the last
    sequence of a few megabytes of text is padded, with end_id. doc_ids are the documents with ids in the sequence, start
    the first one's ids before it. A null or empty text is end_id alone; a null doc_id stays null; repeated rows repeat;
    other columns are ignored; an empty table gives none. An id that id_bytes bytes cannot hold fails.
    """

    def run(batches):
        for b in text_slices(batches, limit=2 * CHUNK_BYTES):
            ids, off = tokens_of(b.column(1), path, end_id)
            if len(ids) and int(ids.max()) >> (8 * id_bytes):
                raise OverflowError(f"id {int(ids.max())} does not fit into {id_bytes} bytes")
            at = np.arange(0, len(ids), seq_len)
            stop = np.minimum(at + seq_len, len(ids))
            first = np.searchsorted(off, at, "right") - 1
            docs_in = np.searchsorted(off, stop, "left") - first
            grid = np.full(len(at) * seq_len, end_id, f"<u{id_bytes}")
            grid[: len(ids)] = ids
            names = b.column(0).take(pa.array(ragged(first, docs_in)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(docs_in)).astype(np.int32)), names)
            rows = binary_rows(grid.view(np.uint8), np.arange(len(at) + 1) * seq_len * id_bytes)
            crc = pa.array([zlib.crc32(x) for x in grid.reshape(-1, seq_len)], pa.int64())
            yield pa.RecordBatch.from_arrays([lists, pa.array(at - off[first]), pa.array(stop - at), rows, crc], names=["doc_ids", "start", "n_tokens", "ids", "ids_crc32"])

    return arrow_map(pick(docs), run, "doc_ids array<long>, start long, n_tokens long, ids binary, ids_crc32 long")


def numbered(spark: SparkSession, table: str, check: str) -> tuple[DataFrame, int, str]:
    """The rows of a written table with a dense index, their number, and a digest of their order and of column `check`.

    A row's place is its file (in name order) and its row number there: fixed once the files are written, whatever task
    reads them, so that lost tasks repeat the same indices. Only one count and checksum per file reach the driver.
    """
    rows = spark.read.parquet(table).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    summed = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("at", check)).alias("x"))
    counts = sorted((r["file"], r["n"], r["x"]) for r in summed.collect())
    digest = hashlib.sha256(json.dumps([x[1:] for x in counts]).encode()).hexdigest()
    before, total = {}, 0
    for name, n, _ in counts:
        before[name] = total
        total += n
    if not counts:
        return rows.select("*", F.lit(0).cast("long").alias("index")).drop("file", "at"), 0, digest
    offsets = spark.createDataFrame(list(before.items()), "file string, before long")
    return rows.join(F.broadcast(offsets), "file").withColumn("index", F.col("before") + F.col("at")).drop("file", "at", "before"), total, digest


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _shard(root: str, run: str, shard: int) -> str:
    return posixpath.join(root, f"shard-{run}-{shard:06d}.bin")


def _manifest(folder: str) -> dict | None:
    system, root = _filesystem(folder)
    name = posixpath.join(root, "manifest.json")
    if not system.get_file_info(name).is_file:
        return None
    with system.open_input_file(name) as f:
        return json.loads(f.read())


def _put(system, name: str, rows, stride: int, per_shard: int):
    """Writes rows (batches in slot order, ids compressed) as a shard under another name and moves it into place. What a
    file of that name holds already is compared, not written; from the first difference on it is written anew."""
    codec = pa.Codec("zstd")
    old = system.open_input_file(name) if system.get_file_info(name).is_file else None
    temp, sink, at, kept = f"{name}.{uuid.uuid4().hex}.tmp", None, 0, []
    for b in rows:
        data = b"".join(codec.decompress(x, stride, asbytes=True) for x in b.column("ids").to_pylist())
        if sink is None and (old is None or old.size() < at + len(data) or old.read_at(len(data), at) != data):
            sink = system.open_output_stream(temp)
            for done in range(0, at, 1 << 22):
                sink.write(old.read_at(min(1 << 22, at - done), done))
        if sink is not None:
            sink.write(data)
        at += len(data)
        kept.append(b.drop_columns(["ids"]))
    if sink is None and old.size() != at:  # an older file goes on after the last row
        sink = system.open_output_stream(temp)
        for done in range(0, at, 1 << 22):
            sink.write(old.read_at(min(1 << 22, at - done), done))
    if old is not None:
        old.close()
    if sink is not None:
        sink.close()
        system.move(temp, name)
    with system.open_input_file(name) as f:
        for b in kept:
            off = (b.column("slot").to_numpy() % per_shard) * stride
            data = f.read_at(len(off) * stride, int(off[0]))
            crc = [zlib.crc32(data[x : x + stride]) for x in range(0, len(data), stride)]
            if crc != b.column("ids_crc32").to_pylist():
                raise OSError(f"{name} does not hold what was written to it")
            yield b, off


def materialise(docs: DataFrame, path: str, key: int, folder: str | None = None, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, end_id: int = 1, id_bytes: int = ID_BYTES) -> tuple[DataFrame, str]:
    """docs -> (doc_ids, start, n_tokens, slot, shard, byte_offset, ids_crc32), and the folder with the shards.

    Sequences are written once, numbered, permuted, and dealt by slot range, one partition per shard; when this returns
    the shards are there, and last manifest.json, which holds what a reader needs. A run's identity (key, sizes, and a
    digest of every sequence in its order) is part of the shards' names: a broken run that starts anew over the same
    rows and splits finds its shards, compares them and writes only what differs, and a repeated task leaves the same
    file. Shards of other runs are never read; a folder whose manifest is another run's is refused. The checksums are
    of the bytes read back and are held against those taken before the shuffle. Odd input is as `sequences` has it.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    flat = new_path(spark, "sequences")
    made = sequences(docs, path, seq_len, end_id, id_bytes)
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(flat)
    rows, total, digest = numbered(spark, flat, "ids_crc32")
    stride, shards = seq_len * id_bytes, max(1, -(-total // per_shard))
    manifest = {"sequences": total, "seq_len": seq_len, "stride": stride, "per_shard": per_shard, "shards": shards if total else 0, "key": key, "dtype": f"<u{id_bytes}", "digest": digest}
    run = manifest["run"] = hashlib.sha256(json.dumps(manifest).encode()).hexdigest()[:16]
    there = _manifest(folder)
    if there is not None and there.get("run") != run:
        raise ValueError(f"{folder} holds another run's shards")

    def place(batches):
        codec = pa.Codec("zstd", 3)  # the ids are shuffled compressed
        for b in batches:
            slot = permute(b.column("index").to_numpy(), total, key)
            ids = pa.array([codec.compress(x, asbytes=True) for x in b.column("ids").to_pylist()], pa.binary())
            cols = [b.column(c) for c in ("doc_ids", "start", "n_tokens", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, ids, pa.array(slot), pa.array((slot // per_shard).astype(np.int32))], names=["doc_ids", "start", "n_tokens", "ids_crc32", "ids", "slot", "shard"])

    placed = arrow_map(rows, place, "doc_ids array<long>, start long, n_tokens long, ids_crc32 long, ids binary, slot long, shard int")
    dealt = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def put(batches):
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)

        def all_():
            yield head
            yield from batches

        for b, off in _put(system, _shard(root, run, head.column("shard")[0].as_py()), all_(), stride, per_shard):
            cols = [b.column(c) for c in ("doc_ids", "start", "n_tokens", "slot", "shard")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(off), b.column("ids_crc32")], names=["doc_ids", "start", "n_tokens", "slot", "shard", "byte_offset", "ids_crc32"])

    out = durable(arrow_map(dealt, put, "doc_ids array<long>, start long, n_tokens long, slot long, shard int, byte_offset long, ids_crc32 long"), "slots")
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(posixpath.join(root, "manifest.json")) as f:
        f.write(json.dumps(manifest).encode())
    drop(spark.read.parquet(flat))
    return out, folder


def read(folder: str, first: int = 0):
    """Yields (slot, ids) in training order from any slot on, reading one shard after another."""
    system, root = _filesystem(folder)
    m = _manifest(folder)
    if m is None:
        raise FileNotFoundError(f"{folder} holds no finished run")
    slot = first
    while slot < m["sequences"]:
        shard = slot // m["per_shard"]
        last = min(m["sequences"], (shard + 1) * m["per_shard"])
        with system.open_input_stream(_shard(root, m["run"], shard)) as f:
            f.read((slot - shard * m["per_shard"]) * m["stride"])
            while slot < last:
                yield slot, np.frombuffer(f.read(m["stride"]), m["dtype"])
                slot += 1
