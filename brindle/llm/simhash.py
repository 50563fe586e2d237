"""SimHash near-duplicates: fingerprints, multi-index hashing with Hamming balls, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, durable, pick, text_slices
from .components import connected_components

#: Differing bits at which two fingerprints still link.
MAX_BITS = 4
#: Words of a shingle.
SHINGLE = 4
#: Segments of a fingerprint, the radius of the balls within them being max_bits // SEGMENTS.
SEGMENTS = 3
#: Entries above which a table slot is dealt out further, by parts of the other bits; all slots are where there are more
#: than WIDE different fingerprints, so that the list of such slots stays below 2 MB. Rows do not depend on either.
HOT_SLOT, WIDE = 1 << 11, 1 << 26
#: Groups with at most this many compared pairs are compared at once; larger ones are searched along their links.
SMALL = 64


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str, width: int = SHINGLE, seed: int = 42) -> int:
    """SimHash over XXH64 of the text's word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1)
    spans = zip(start[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1))


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the 64 bits as a signed long). Whole texts, A-Z lower-cased, no shuffle.

    A null or empty text has fingerprint 0; fewer words than a shingle are one shingle; other columns are ignored.
    """

    def run(batches):
        for b in text_slices(batches, limit=CHUNK_BYTES):
            fp = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(pick(docs), run, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of `count` near-equal segments of 64 bits."""
    cut = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """The masks of at most `radius` set bits, the empty one first."""
    out = [0]
    if radius >= 1:
        out += [1 << i for i in range(width)]
    if radius >= 2:
        out += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    return out


def _probe(part: Column, count: int, segment: int):
    return lambda mask: F.struct((part.bitwiseXOR(mask) * count + segment).alias("key"), (mask == 0).alias("own"))


def _segment(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def probes(nodes: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """nodes (id, fp) -> key, id, fp, own: each fingerprint's table entry (own) and the ball around it, per segment.

    Two fingerprints within max_bits differ by at most max_bits // count bits in some segment, so that one's table
    entry lies in the other's ball there.
    """
    sets = []
    for s, (shift, width) in enumerate(segments(count)):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, max_bits // count)])
        sets.append(F.transform(masks, _probe(_segment(shift, width), count, s)))
    return nodes.select("id", "fp", F.explode(F.concat(*sets)).alias("p")).select("p.key", "id", "fp", "p.own")


def deeper(rows: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """What probes returns -> the same with keys further parted: a row for each of max_bits + 1 parts of the bits outside
    the slot's segment. Two fingerprints within max_bits agree in at least one of those parts, so that no link is lost."""
    parts = F.lit(None).cast("array<bigint>")
    for s, (shift, width) in enumerate(segments(count)):
        outside = [b for b in range(64) if not shift <= b < shift + width]
        cut = [outside[len(outside) * k // (max_bits + 1) : len(outside) * (k + 1) // (max_bits + 1)] for k in range(max_bits + 1)]
        masks = [sum(1 << b for b in part) for part in cut]
        found = [F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)]
        parts = F.when(F.pmod("key", F.lit(count)) == s, F.array(*found)).otherwise(parts)
    return rows.select(F.explode(parts).alias("key"), "id", "fp", "own")


def dealt(nodes: DataFrame, count: int, n: int, max_bits: int = MAX_BITS, hot_slot: int = HOT_SLOT, wide: int = WIDE) -> DataFrame:
    """The probes of n nodes, those of slots with over hot_slot entries dealt out further."""
    rows = probes(nodes, count, max_bits)
    if n > wide:
        return deeper(rows, count, max_bits)
    own = F.array(*[_segment(shift, width) * count + s for s, (shift, width) in enumerate(segments(count))])
    slots = durable(nodes.select(F.explode(own).alias("key")).groupBy("key").count().where(F.col("count") > hot_slot).select("key"), "slots")
    if slots.isEmpty():
        return rows
    hot = F.broadcast(slots)  # fewer than count * wide / hot_slot rows
    return rows.join(hot, "key", "left_anti").union(deeper(rows.join(hot, "key", "left_semi"), count, max_bits))


def _search(fp: np.ndarray, own: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one table slot: entries against all, visitors against entries.

    Walks along the links; what is reached is never compared again, so a dense group costs little more than its size.
    """
    out = []
    owners, visitors = np.flatnonzero(own), np.flatnonzero(~own)
    while len(owners):
        front, owners = [int(owners[0])], owners[1:]
        while front:
            x = front.pop()
            hit = np.bitwise_count(fp[owners] ^ fp[x]) <= max_bits
            got = owners[hit].tolist()
            owners = owners[~hit]
            if own[x] and len(visitors):
                hit = np.bitwise_count(fp[visitors] ^ fp[x]) <= max_bits
                got += visitors[hit].tolist()
                visitors = visitors[~hit]
            out += [(x, y) for y in got]
            front += got
    return out


def _links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links found in whole table slots that lie one after another."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(cut, len(key)))
    entries = np.add.reduceat(own.astype(np.int64), cut)
    live = (entries > 0) & (size > 1)
    small = live & (entries * size <= SMALL)
    a, b = [], []
    if small.any():
        rows = np.flatnonzero(np.repeat(small, size))
        mine = rows[own[rows]]
        slot = np.searchsorted(cut, mine, "right") - 1
        left = np.repeat(mine, size[slot])
        right = np.repeat(cut[slot] - (np.cumsum(size[slot]) - size[slot]), size[slot]) + np.arange(len(left))
        hit = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= max_bits)
        a.append(node[left[hit]])
        b.append(node[right[hit]])
    for k in np.flatnonzero(live & ~small):
        at = slice(cut[k], cut[k] + size[k])
        found = _search(fp[at], own[at], max_bits)
        if found:
            x, y = np.array(found).T
            a.append(node[at][x])
            b.append(node[at][y])
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def links(nodes: DataFrame, n: int, max_bits: int = MAX_BITS, count: int = SEGMENTS, hot_slot: int = HOT_SLOT, wide: int = WIDE) -> DataFrame:
    """n nodes (id, fp; both unique and not null) -> a, b: links within max_bits bits that connect whatever all such links connect.

    One shuffle of the probes; each table slot is read as a sorted stream, so no Python call is made per slot. A slot
    is one worker's, which holds its rows (25 bytes each); slots with many entries are dealt out by max_bits + 1 further
    keys, and what still falls together agrees on more than half of the bits. No link is left out at either step.
    An empty table gives none.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def search(parts):
            t = pa.Table.from_batches(parts)
            cols = [t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "id", "fp", "own")]
            a, b = _links(cols[0], cols[1], cols[2].view(np.uint64), cols[3], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if held and key[0] != last:
                yield search(held)
                held = []
            end = int(np.searchsorted(key, key[-1]))  # the last slot may go on in the next batch
            if end:
                yield search([*held, batch.slice(0, end)])
                held = []
            held.append(batch.slice(end))
            last = key[-1]
        if held:
            yield search(held)

    p = dealt(nodes, count, n, max_bits, hot_slot, wide)
    return arrow_map(p.repartition("key").sortWithinPartitions("key"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: the smallest doc_id reachable over links of max_bits bits or fewer.

    Copies fall together before anything is compared: a node is a fingerprint, whatever documents have it. Texts without
    words share fingerprint 0 and link like any other; repeated rows, and rows of one doc_id with different texts, each
    keep their row and link by their own text alone. A null doc_id takes part; a component of null ones has a null
    component_id. An empty table gives none.
    """
    fps = durable(fingerprints(docs), "fingerprints")
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = connected_components(links(nodes.select(F.col("fp").alias("id"), "fp"), nodes.count(), max_bits)).withColumnRenamed("component", "root")
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = durable(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(named, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
