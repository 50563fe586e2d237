"""Substring dedup by recompression: long repeats of words between documents, found by shared high-level symbols.

Every document's words are a sequence of symbols. In each round runs of one symbol, then pairs of a left and a
right symbol, get a new name. A name is a hash of the round and of the names it replaces, so that equal strings have
equal names wherever they stand, with no exchange of names between tasks. With each symbol goes its need: the span of
words that settles that the symbol is cut out just so. A symbol whose need lies within a window of words is cut
out alike in every copy of the window.

Each window is filed under one such interior symbol (highest round, then smallest name, then leftmost): its anchor.
Neighbouring windows under one anchor form an extent. Then
  1. equal extents (anchor and content) of different documents are repeats as a whole;
  2. an anchor with two or more different extents has one document of each show its windows one by one.
Anchors of one document alone show nothing, so that what is shuffled per word of clean text is a small fraction of a row.
Both tests key on the anchor's name and a content hash, which only propose: the document that a repeat is held against
gives a 128-bit cryptographic digest of the words themselves, and a word goes only where the digest of its own
document's words is the same.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Words, arrow_map, binary_rows, drop, durable, pick_columns, ragged, text_slices
from .urls import bloom, passing

#: Words of a window.
WINDOW = 50
#: Rounds of recompression. A later round's symbols need more words, so that fewer of them fit within a window of 50 and
#: anchors change more often: measured on prose, a row for each 15.4 words after 3 rounds, 13.3 after 4, 10.0 after 5.
ROUNDS = 3
CHUNK = 1 << 20
BIG = np.iinfo(np.int64).max // 4
#: Odd multiplier of the rolling content hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def name(level: int, kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The global name of a run or a pair."""
    with np.errstate(over="ignore"):
        return mix(mix(a + np.uint64(2 * level + kind) * BASE) * np.uint64(3) + b)


class Symbols:
    """Symbols of one round over several documents: name, first and end word, need (lo, hi), document."""

    def __init__(self, sym, start, end, lo, hi, doc):
        self.sym, self.start, self.end, self.lo, self.hi, self.doc = sym, start, end, lo, hi, doc

    def _seen(self):
        """Each symbol's need with its neighbours'; what ends a document is never settled by a window."""
        same = self.doc[1:] == self.doc[:-1]
        left = np.append(-BIG, np.where(same, self.lo[:-1], -BIG))
        right = np.append(np.where(same, self.hi[1:], BIG), BIG)
        return same, left, right

    def runs(self, level: int) -> Symbols:
        """Each longest run of two or more equal symbols becomes one symbol. That a symbol is no part of a run, or
        where a run ends, is settled by both neighbours."""
        if not len(self.sym):
            return self
        same, left, right = self._seen()
        head = np.append(True, ~(same & (self.sym[1:] == self.sym[:-1])))
        at = np.flatnonzero(head)
        tail = np.append(at[1:], len(head)) - 1
        n = tail - at + 1
        sym = np.where(n > 1, name(level, 0, self.sym[at], n.astype(np.uint64)), self.sym[at])
        return Symbols(sym, self.start[at], self.end[tail], np.minimum(self.lo[at], left[at]), np.maximum(self.hi[tail], right[tail]), self.doc[at])

    def pairs(self, level: int) -> Symbols:
        """Each left symbol with the right symbol after it becomes one symbol; a bit of the name tells left from right.
        A left symbol that stays alone is settled by what follows, a right one by what precedes."""
        if not len(self.sym):
            return self
        same, left, right = self._seen()
        is_right = (mix(self.sym + np.uint64(level)) & np.uint64(1)).astype(bool)
        joins = np.append(same & ~is_right[:-1] & is_right[1:], False)
        at = np.flatnonzero(~np.append(False, joins[:-1]))
        two = joins[at]
        last = at + two
        sym = np.where(two, name(level, 1, self.sym[at], self.sym[last]), self.sym[at])
        lo = np.where(two, np.minimum(self.lo[at], self.lo[last]), np.where(is_right[at], np.minimum(self.lo[at], left[at]), self.lo[at]))
        hi = np.where(two, np.maximum(self.hi[at], self.hi[last]), np.where(is_right[at], self.hi[at], np.maximum(self.hi[at], right[at])))
        return Symbols(sym, self.start[at], self.end[last], lo, hi, self.doc[at])


def rounds(codes: np.ndarray, doc_off: np.ndarray, count: int = ROUNDS) -> list[Symbols]:
    """The symbols of every round, the words first."""
    n = len(codes)
    at = np.arange(n, dtype=np.int64)
    out = [Symbols(codes, at, at + 1, at, at + 1, np.repeat(np.arange(len(doc_off) - 1), np.diff(doc_off)))]
    for level in range(1, count + 1):
        out.append(out[-1].runs(level).pairs(level))
    return out


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each i the leftmost index of the smallest key in lo[i] .. hi[i], both included."""
    size = hi - lo + 1
    power = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    table = np.arange(len(key), dtype=np.int64)
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            a, b = table[: -(1 << (k - 1))], table[1 << (k - 1) :]
            table = np.where(key[a] <= key[b], a, b)
        q = np.flatnonzero(power == k)
        if len(q):
            a, b = table[lo[q]], table[hi[q] - (1 << k) + 1]
            out[q] = np.where(key[a] <= key[b], a, b)
    return out


def anchors(codes: np.ndarray, doc_off: np.ndarray, window: int = WINDOW, count: int = ROUNDS, hashes=None):
    """(first word, anchor name, anchor's identity) of every window, windows in order.

    An anchor's name stands for the symbol and for all words of its need, which every copy of the window holds too;
    so a short symbol of common words does not bring strangers together.
    """
    pre, back = hashes or content(codes)
    size = np.diff(doc_off)
    n_win = np.maximum(0, size - window + 1)
    win = ragged(doc_off[:-1], n_win)
    anchor = np.zeros(len(win), np.uint64)
    ident = np.zeros(len(win), np.int64)
    open_ = np.arange(len(win))
    levels = rounds(codes, doc_off, count)
    for level in range(count, -1, -1):
        if not len(open_):
            break
        s = levels[level]
        fits = s.hi - s.lo <= window
        sym, lo, hi = s.sym[fits], s.lo[fits], s.hi[fits]
        if not len(sym):
            continue
        p = win[open_]
        first = np.searchsorted(lo, p)
        last = np.searchsorted(hi, p + window, "right") - 1
        got = last >= first
        if not got.any():
            continue
        q = open_[got]
        at = _least(mix(sym), first[got], last[got])
        anchor[q] = mix(mix(sym[at] + np.uint64(level + 1)) ^ span_hash(pre, back, lo[at], hi[at]))
        ident[q] = at * (count + 1) + level
        open_ = open_[~got]
    return win, anchor, ident


def content(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash over the (mixed) words, and the inverse powers that shift a span to 0."""
    with np.errstate(over="ignore"):
        n = len(codes)
        power = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)), dtype=np.uint64)
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        back = np.cumprod(np.append(np.uint64(1), np.full(n, inv)), dtype=np.uint64)
        pre = np.append(np.uint64(0), np.cumsum(mix(codes ^ np.uint64(0xD6E8FEB86659FD93)) * power[:n], dtype=np.uint64))
    return pre, back


def span_hash(pre: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((pre[end] - pre[start]) * back[start] + (end - start).astype(np.uint64))


def word_codes(col: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and a 64-bit hash of each: the same for the same word everywhere."""
    w = Words(col)
    codes, different = w.coded()
    table = np.fromiter((xxh3_64_intdigest(x, 7) for x in different), np.uint64, len(different))
    return w, table[codes] if len(codes) else np.zeros(0, np.uint64)


def _extents(col: pa.Array, window: int):
    """Words, prefix hashes and, per extent: text's number, first window and number of windows in the text, anchor, content."""
    w, codes = word_codes(col)
    pre, back = content(codes)
    win, anchor, ident = anchors(codes, w.doc, window, hashes=(pre, back))
    if not len(win):
        none = np.zeros(0, np.int64)
        return w, (pre, back), none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.append(True, (ident[1:] != ident[:-1]) | (win[1:] != win[:-1] + 1))
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(win)))
    row = np.searchsorted(w.doc, win[at], "right") - 1
    body = span_hash(pre, back, win[at], win[at] + n + window - 1)
    return w, (pre, back), row, win[at] - w.doc[row], n, anchor[at], body


LAST = 2**63 - 1


def _texts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(id, tag, text, kept columns): id orders documents (a null doc_id comes last), tag tells rows of one id apart."""
    doc_id, text = pick_columns()
    base = docs.select(doc_id, text, *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    return base.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("tag"), "text", *[f"keep_{c}" for c in keep])


def extents(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, tag, text) -> id, tag, first, n, anchor, body: the extents of every text."""

    def run(batches):
        for b in text_slices(batches, "text", CHUNK):
            _, _, row, first, n, anchor, body = _extents(b.column(2), window)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64))],
                names=["id", "tag", "first", "n", "anchor", "body"],
            )

    return arrow_map(texts.select("id", "tag", "text"), run, "id long, tag long, first int, n int, anchor long, body long")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """rows (id, tag, wants, text) -> id, tag, first, anchor, body: each window of the wanted extents."""

    def run(batches):
        for b in text_slices(batches, "text", CHUNK):
            w, (pre, back), row, first, n, anchor, body = _extents(b.column(3), window)
            wants = b.column(2)
            owner = np.repeat(np.arange(len(wants)), np.diff(wants.offsets.to_numpy()))
            flat = wants.flatten().to_numpy().view(np.uint64)
            mine = _want(anchor, body) + row.astype(np.uint64)
            keep = np.isin(mine, flat + owner.astype(np.uint64))
            row, first, n, anchor = row[keep], first[keep], n[keep], anchor[keep]
            at = ragged(w.doc[row] + first, n)
            of = np.repeat(row, n)
            body = span_hash(pre, back, at, at + window)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array((at - w.doc[of]).astype(np.int32)), pa.array(np.repeat(anchor, n).view(np.int64)), pa.array(body.view(np.int64))],
                names=["id", "tag", "first", "anchor", "body"],
            )

    return arrow_map(rows, run, "id long, tag long, first int, anchor long, body long")


def _want(anchor: np.ndarray, body: np.ndarray) -> np.ndarray:
    return mix(body + mix(anchor))


def _wanted(rows: DataFrame) -> DataFrame:
    """Adds the key by which a text finds its wanted extents again."""

    def run(batches):
        for b in batches:
            key = _want(b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key.view(np.int64))], names=["id", "tag", "want"])

    return arrow_map(rows.select("id", "tag", "anchor", "body"), run, "id long, tag long, want long")


def _some(texts: DataFrame, wants: DataFrame) -> DataFrame:
    """The texts whose id may be one of those wanted; a superset, whatever the filter's bound lets through."""
    filt, blocks = bloom(wants.select(F.col("id").alias("url")), wants.count())
    rows, hit = passing(texts.select("id", "tag", "text"), F.col("id"), filt, blocks, "inner")
    return rows.where(hit).select("id", "tag", "text")


class Spans:
    """The words of several texts, each followed by one space, so that spans of words can be told by digests."""

    def __init__(self, w: Words):
        n = w.end - w.start
        self.off = np.append(0, np.cumsum(n + 1))
        joined = np.full(int(self.off[-1]), 0x20, np.uint8)
        joined[ragged(self.off[:-1], n)] = w.data[w.ink]
        self.joined = joined.tobytes()

    def digests(self, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Of n words from word `at` on, for each."""
        ends = zip(self.off[at].tolist(), self.off[at + n].tolist(), strict=True)
        return [blake2b(self.joined[a:b], digest_size=16).digest() for a, b in ends]


def _proofs(rows: DataFrame) -> DataFrame:
    """rows (id, tag, asked: list of (first, n, anchor, body, whole), text) -> id, anchor, body, whole, proof: the digest
    of the words of each span asked for."""

    def run(batches):
        for b in text_slices(batches, "text", CHUNK):
            w = Words(b.column(3))
            asked = b.column(2)
            row = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            first, n, anchor, body, whole = asked.flatten().flatten()
            proof = Spans(w).digests(w.doc[row] + first.to_numpy(), n.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), anchor, body, whole, pa.array(proof, pa.binary())], names=["id", "anchor", "body", "whole", "proof"])

    return arrow_map(rows, run, "id long, anchor long, body long, whole boolean, proof binary")


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (id, tag, text, ...) -> id, tag, gone: a list of (first, n, proof), the word spans covered by windows that also
    start in a text of smaller id, and the digest of that text's words there.

    Only texts that show windows or prove them are shuffled: a Bloom filter of bounded size keeps nearly all others from
    the exact joins. Counts and least ids are taken before any shuffle, and joins on them can be split where many texts
    share a key. Tables go as soon as nothing reads them any more.
    """
    ext = durable(extents(texts, window), "extents")
    met = ext.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("anchor")
    met = durable(met, "met")  # as a table of its own it leaves the join free to split an anchor that many texts share
    shared = durable(ext.join(met, "anchor", "left_semi"), "shared")
    drop(ext)
    drop(met)
    last = F.min(F.struct("id", F.bitwise_not("tag").alias("tag"))).alias("l")
    least = shared.groupBy("anchor", "body").agg(F.min(F.struct("id", "tag", "first", "n")).alias("m"), last, F.max("id").alias("most"))
    again, reused = F.col("m.id") < F.col("most"), F.col("m.tag") != F.bitwise_not("l.tag")
    length = (F.col("m.n") + (window - 1)).alias("n")
    least = durable(least.select("anchor", "body", "m.id", "m.tag", "m.first", length, again.alias("again"), reused.alias("reused")), "least")
    several = durable(least.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "several")
    show = least.join(several, "anchor", "left_semi").select("id", "tag", "anchor", "body")
    if not least.where("reused").isEmpty():  # texts that share the least id and an extent all show its windows
        show = show.union(shared.join(least.where("reused").select("anchor", "body", "id"), ["anchor", "body", "id"]).join(several, "anchor", "left_semi").select("id", "tag", "anchor", "body"))
    wants = durable(_wanted(show).groupBy("id", "tag").agg(F.collect_set("want").alias("wants")), "wants")
    shown = durable(_windows(_some(texts, wants).join(wants, ["id", "tag"]).select("id", "tag", "wants", "text"), window), "windows")
    first = shown.groupBy("anchor", "body").agg(F.min(F.struct("id", "tag", "first")).alias("m"), F.max("id").alias("most")).where("m.id < most")
    first = first.select("anchor", "body", "m.id", "m.tag", "m.first", F.lit(window).alias("n"), F.lit(False).alias("whole"))
    sources = least.where("again").select("anchor", "body", "id", "tag", "first", "n", F.lit(True).alias("whole")).union(first)
    asked = sources.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "n", "anchor", "body", "whole")).alias("asked"))
    asked = durable(asked, "asked")
    proofs = durable(_proofs(_some(texts, asked).join(asked, ["id", "tag"]).select("id", "tag", "asked", "text")), "proofs")
    for t in (least, several, wants, asked):
        drop(t)
    of = proofs.select("anchor", "body", F.col("id").alias("least"), "whole", "proof")
    later = F.col("id") > F.col("least")
    spans = shared.join(of.where("whole"), ["anchor", "body"]).where(later).select("id", "tag", "first", (F.col("n") + (window - 1)).alias("n"), "proof")
    single = shown.join(of.where("not whole"), ["anchor", "body"]).where(later).select("id", "tag", "first", F.lit(window).alias("n"), "proof")
    gone = durable(spans.union(single).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "n", "proof")).alias("gone")), "gone")
    for t in (shared, shown, proofs):
        drop(t)
    return gone


def substring_dedup(docs: DataFrame, window: int = WINDOW, joiner: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, text without the words of repeated windows, and the columns in keep.

    A word goes if a window of `window` consecutive words covers it whose words also start somewhere in a document
    with a smaller doc_id; windows are judged on the input. Without `joiner` a kept word keeps the white space before
    it; with one, kept words are joined by it. A null text has no words; texts shorter than a window stay; rows of one
    doc_id, whatever their texts, are one document to each other; a null doc_id counts as the largest; other columns,
    whatever their names, are ignored; an empty table gives none.
    """
    texts = _texts(docs, keep)
    rows = texts.join(repeats(texts, window), ["id", "tag"], "left")
    carried = [f"keep_{c}" for c in keep]
    rows = rows.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "text", F.col("gone.first").alias("first"), F.col("gone.n").alias("n"), F.col("gone.proof").alias("proof"), *carried)

    def run(batches):
        for b in text_slices(batches, "text", CHUNK):
            w = Words(b.column(1))
            first, n = b.column(2), b.column(3).flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), np.diff(first.fill_null([]).offsets.to_numpy()))
            at = w.doc[of] + first.flatten().to_numpy()
            if len(at):
                same = [x == y for x, y in zip(Spans(w).digests(at, n), b.column(4).flatten().to_pylist(), strict=True)]
                at, n = at[same], n[same]
            step = np.zeros(len(w) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
            out = np.cumsum(step[:-1]) > 0
            before = np.append(0, np.cumsum(out))
            removed = before[w.doc[1:]] - before[w.doc[:-1]]
            if joiner is None:
                # a word's bytes with the white space before it; white space after the last word stays
                lead = np.append(0, w.end[:-1]) if len(w) else w.start
                row = np.repeat(np.arange(b.num_rows), np.diff(w.doc))
                lead = np.maximum(lead, w.text[row])
                mark = np.zeros(len(w.data) + 1, np.int32)
                np.add.at(mark, lead[out], 1)
                np.add.at(mark, w.end[out], -1)
                keep = np.cumsum(mark[:-1]) == 0
                kept = np.append(0, np.cumsum(keep))
                text = binary_rows(w.data[keep], kept[w.text])
            else:
                glue = joiner.encode()
                ends, starts = w.end.tolist(), w.start.tolist()
                data = w.data.tobytes()
                flags = (~out).tolist()
                text = pa.array([glue.join([data[starts[i] : ends[i]] for i in range(p, q) if flags[i]]) for p, q in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.doc)), pa.array(removed), text.cast(pa.string()), *b.columns[5:]], names=["doc_id", "n_words", "n_removed", "text", *carried])

    schema = "doc_id long, n_words long, n_removed long, text string" + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return arrow_map(rows, run, schema).withColumnsRenamed(dict(zip(carried, keep, strict=True)))
