"""Near duplicates by the Jaccard similarity of word shingles: SimHash and MinHash propose links, whole sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, drop, durable, text_slices
from .components import connected_components
from .simhash import links, majority
from .urls import bloom, passing

#: Words of a shingle.
SHINGLE = 5
#: Similarity from which two texts link, as a fraction of whole numbers.
SHARE = (4, 5)
#: Bands of MinHash values and values of a band: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: Bands that a pair of different components has to share; at similarity 0.8 it shares fewer with probability 1.1e-6.
SHARED = 2
#: 64-bit words of a set's parity bits, a power of two.
PARITY = 4
#: Shingles hashed by all functions at once.
BLOCK = 2048

_RANDOM = np.random.Generator(np.random.PCG64(42))
FLIP = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None]
TIMES = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(parts: np.ndarray) -> np.ndarray:
    """One hash of each column of parts, from top to bottom."""
    out = np.full(parts.shape[1], len(parts), np.uint64)
    for p in parts:
        out = _mix(out * STEP + p)
    return out


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's different word shingles, A-Z lower-cased; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    return np.unique(_fold(np.stack([h[k : len(h) - width + 1 + k] for k in range(width)])))


def bands(found: np.ndarray) -> np.ndarray:
    """A key per band of the MinHash values of a shingle set that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK] ^ FLIP) * TIMES).min(axis=1), out=least)
    return _fold(np.stack([np.arange(BANDS, dtype=np.uint64), *least.reshape(BANDS, ROWS).T]))


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes falls into each of 64 * PARITY bins, as bits: two sets differ in at least
    as many hashes as these bits do."""
    count = np.bincount((found >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((count & 1).astype(np.uint8)).view(np.uint64)


def _list(parts: list[np.ndarray]) -> pa.Array:
    off = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def row_keys() -> list[Column]:
    """Two hashes that tell rows of another doc_id or text apart, nulls included."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(1), "text", F.col("doc_id").isNull(), "doc_id").alias("row_b")]


def sketches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_a, row_b, node (a hash of the shingle set), fp (its SimHash), keys (of its bands)."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in text_slices(batches, limit=CHUNK_BYTES):
            sets = [shingles(t) for t in b.column(3).to_pylist()]
            node = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64)
            keys = _list([bands(s) if len(s) else s for s in sets])
            cols = [*b.columns[:3], pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), keys]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_a", "row_b", "node", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, run, "doc_id long, row_a long, row_b long, node long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs (node, text) -> node, found (the different shingles' hashes), odd (their parity bits)."""

    def run(batches):
        for b in text_slices(batches, limit=CHUNK_BYTES):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _list(sets), _list([parity(s) for s in sets])], names=["node", "found", "odd"])

    return arrow_map(docs, run, "node long, found array<long>, odd array<long>")


def _some(rows: DataFrame, key: Column, wanted: DataFrame, by: str) -> DataFrame:
    """The rows whose key may be among wanted's values of `by`: a Bloom filter of bounded size before an exact join."""
    filt, blocks = bloom(wanted.select(F.col(by).alias("url")), wanted.count())
    out, hit = passing(rows, key, filt, blocks, "inner")
    return out.where(hit).select(*rows.columns)


def _may_link() -> Column:
    """Whether sets of m and l shingles, of which at most p and q are found in any other set, can be SHARE similar."""
    one, all_ = SHARE
    most = F.least("p", "q", "m", "l")
    return most * all_ >= (F.col("m") + F.col("l") - most) * one


def _near(u: str, v: str) -> Column:
    """Whether sets of m and l shingles with parity bits u and v can be SHARE similar: exact, as the bits never differ in
    more places than the sets."""
    one, all_ = SHARE
    differ = sum((F.bit_count(F.col(u)[k].bitwiseXOR(F.col(v)[k])) for k in range(PARITY)), F.lit(0))
    return differ * (all_ + one) <= (F.col("m") + F.col("l")) * (all_ - one)


def weighed(sets: DataFrame) -> DataFrame:
    """sets (node, found) -> node, m (shingles), p (those found in other sets too), of nodes that can link to another.

    A shingle that no other set holds counts against every pair: a text with more than a fifth of such has no link. That
    is exact, needs one shuffle of the sets, and spares a group of loosely alike texts its comparisons.
    """
    one, all_ = SHARE
    lone = sets.select("node", F.explode("found").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lone = lone.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    rows = sets.select("node", F.size("found").cast("long").alias("m")).join(lone, "node", "left")
    return rows.select("node", "m", (F.col("m") - F.coalesce("u", F.lit(0))).alias("p")).where(F.col("p") * all_ >= F.col("m") * one)


def verified(pairs: DataFrame, sets: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs (a, b) of different nodes -> those whose Jaccard similarity is SHARE or more, in whole numbers."""
    one, all_ = SHARE
    held = pairs.join(weights.toDF("a", "m", "p"), "a").join(weights.toDF("b", "l", "q"), "b").where(_may_link())
    found = sets.select("node", "found")
    both = held.join(found.toDF("b", "y"), "b").join(found.toDF("a", "x"), "a")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(same * all_ >= (F.col("m") + F.col("l") - same) * one).select("a", "b")


def _simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash proposes: those of one fingerprint as a star, and links of fingerprints a few bits apart."""
    nodes = rows.groupBy("fp").agg(F.min("node").alias("rep"))
    nodes = durable(nodes, "fingerprints")
    same = rows.select("node", "fp").join(nodes, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    found = links(nodes.select(F.col("fp").alias("id"), "fp"), nodes.count()).toDF("x", "y")
    near = found.join(nodes.toDF("x", "a"), "x").join(nodes.toDF("y", "b"), "y").select("a", "b")
    pairs = durable(same.union(near).distinct(), "proposed")
    drop(nodes)
    return pairs


def similar(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_a, row_b, component: rows are in one component if links of SHARE or more join them.

    Equal shingle sets are one node before anything is compared; texts without words are one. What SimHash fingerprints
    link within a few bits is proposed first, and each node with the best connected one of every MinHash slot it is in: at
    a similarity of 0.8 fingerprints differ in about ten bits, beyond any ball that can be enumerated, so the slots have
    to propose the rest. Then, across the components that makes, the pairs of a slot but those within its largest
    component, where another link changes nothing: each pair once, in the first slot that it shares, if it shares more
    than one and its parity bits allow a link. Every link is verified on whole shingle sets, those texts aside that cannot link
    (`weighed`). Each repeated row keeps its row; a null doc_id takes part; an empty table gives none. The result is a
    table of its own, and all others are gone.
    """
    rows = durable(sketches(docs), "sketches")
    nodes = rows.where(F.size("keys") > 0)
    entries = nodes.select("node", F.explode("keys").alias("key"))
    slots = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    slots = durable(slots.select("key"), "slots")
    live = durable(_some(entries, F.col("key"), slots, "key").join(slots, "key", "left_semi").select("key", "node").distinct(), "live")
    drop(slots)

    held = rows.select("node", "row_a", "row_b").join(live.select("node").distinct(), "node", "left_semi")
    held = held.groupBy("node").agg(F.min(F.struct("row_a", "row_b")).alias("r"))
    held = durable(held.select("node", "r.row_a", "r.row_b"), "held")
    keyed = docs.select(*row_keys(), F.col("text").cast("string").alias("text"))
    texts = _some(keyed, F.col("row_a"), held, "row_a").join(held, ["row_a", "row_b"]).select("node", "text")
    sets = durable(shingle_sets(texts).dropDuplicates(["node"]), "sets")
    drop(held)
    weights = durable(weighed(sets), "weights")

    live, before = durable(live.join(weights, "node").select("key", "node", "m", "p"), "live"), live
    drop(before)
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live, before = durable(live.join(sizes, "key"), "live"), live
    drop(before)
    scores = live.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = live.join(scores, "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("hub"))
    hubs = durable(hubs, "hubs")
    stars = live.join(hubs, "key").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    proposed = _simhash_pairs(nodes)
    pairs = durable(stars.union(proposed).distinct(), "pairs")
    found = durable(verified(pairs, sets, weights), "verified")

    groups = connected_components(found).toDF("member", "c")
    named = live.join(groups, live["node"] == groups["member"], "left").select("key", "node", F.coalesce("c", "node").alias("c"), "m", "p")
    named = durable(named, "named")
    counted = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    split = counted.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "main")
    split = durable(split, "split")
    named, before = durable(named.join(split, "key"), "named"), named
    drop(before)
    held = nodes.join(named.select("node").distinct(), "node", "left_semi").select("node", "keys").dropDuplicates(["node"])
    held = durable(held.join(sets.select("node", "odd"), "node"), "held")
    # a shingle that no other component holds counts against every pair that is left, as lone shingles do in `weighed`
    spread = sets.join(named.select("node", "c").distinct(), "node").select("c", F.explode("found").alias("s"))
    spread = spread.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    loose = sets.join(named.where("c <> main").select("node").distinct(), "node", "left_semi").select("node", F.explode("found").alias("s"))
    shared = durable(loose.join(spread, "s").groupBy("node").agg(F.count(F.lit(1)).alias("o")), "shared")
    rest = named.where("c <> main").join(shared, "node").join(held, "node")
    rest = rest.select("key", F.col("node").alias("a"), "c", "m", F.least("p", "o").alias("p"), F.col("keys").alias("x"), F.col("odd").alias("u"))
    rest = durable(rest, "rest")
    is_main = (F.col("c") == F.col("main")).alias("is_main")
    every = named.join(held, "node").select("key", F.col("node").alias("b"), F.col("c").alias("d"), F.col("m").alias("l"), F.col("p").alias("q"), is_main, F.col("keys").alias("y"), F.col("odd").alias("v"))
    every = durable(every, "every")
    once = (F.array_min(F.array_intersect("x", "y")) == F.col("key")) & (F.size(F.array_intersect("x", "y")) >= SHARED)
    across = rest.join(every, "key").where((F.col("c") != F.col("d")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & _may_link() & _near("u", "v") & once)
    across = durable(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more = durable(verified(across, sets, weights), "verified")
    groups = connected_components(found.union(more)).toDF("member", "c")
    out = rows.join(groups, rows["node"] == groups["member"], "left")
    out = durable(out.select("doc_id", "row_a", "row_b", F.coalesce("c", "node").alias("component")), "components")
    for t in (rows, live, sets, weights, hubs, proposed, pairs, found, named, split, held, shared, rest, every, across, more, groups):
        drop(t)
    return out


def survivors(rows: DataFrame) -> DataFrame:
    """What similar returns -> row_a, row_b, stays (false: the row goes; true: one of its equal rows stays), of those rows
    that do not simply stay.

    Of each component the row of the smallest doc_id stays, a null one last; rows of one doc_id go by the hash of doc_id
    and text.
    """
    counted = rows.groupBy("component", "doc_id", "row_a", "row_b").agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_a", "row_b")
    best = counted.groupBy("component").agg(F.min(order).alias("r"), F.count(F.lit(1)).alias("members"), F.max("times").alias("most")).where("members > 1 or most > 1")
    best = best.select("component", F.col("r.row_a").alias("best_a"), F.col("r.row_b").alias("best_b"))
    told = counted.join(best, "component").withColumn("stays", (F.col("row_a") == F.col("best_a")) & (F.col("row_b") == F.col("best_b")))
    return told.where("not stays or times > 1").select("row_a", "row_b", "stays")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> its rows but those that go by `survivors`; only rows that may go are shuffled."""
    found = similar(docs)
    told = durable(survivors(found), "survivors")
    drop(found)
    names = [f"col_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *row_keys())
    filt, blocks = bloom(told.select(F.col("row_a").alias("url")), told.count())
    probed, hit = passing(rows, F.col("row_a"), filt, blocks, "left")
    probed = probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("hit"))
    asked = probed.where("hit").join(told, ["row_a", "row_b"], "left")
    once = asked.where("stays").dropDuplicates(["row_a", "row_b"]).select(*names)
    out = probed.where("not hit").select(*names).union(asked.where("stays is null").select(*names)).union(once)
    return out.toDF(*docs.columns)
