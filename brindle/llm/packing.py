"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, arrow_map, binary_rows, pick, ragged, text_slices

#: Tokens of a sequence.
SEQ_LEN = 2048
#: UTF-8 bytes of text per randomised group: about a thousand sequences, so that a last, part-filled bin weighs little.
GROUP_BYTES = 8 << 20
#: Different words whose ids a Python worker keeps, and bytes of them and their ids: texts without spaces have long words.
KEPT_WORDS = 500_000
KEPT_BYTES = 32 << 20
#: Marks after a word that form a token of their own beside its letters.
TAIL = b".,!?;:"
IS_TAIL = np.isin(np.arange(256), list(TAIL))
IS_ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])
#: Parts words that are encoded in one call; the words themselves are free of "<|".
MARK, MARK_ID = "<|startoftext|>", 49406


def _letter(core: bytes) -> bool:
    """Whether the last character is a letter, and stays one in lower case."""
    return unicodedata.category(unicodedata.normalize("NFC", core.decode()).lower()[-1])[0] == "L"


def parts(w: Words) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words' parts, and the number of parts before each text (n + 1): a word's core and the marks at its end, where
    both are sure to be tokenised apart, else the word. A-Z lower-cased, but not where the word may hold a special token."""
    data, n = w.data[w.ink], len(w)
    off = np.zeros(n + 1, np.int64)
    np.cumsum(w.end - w.start, out=off[1:])
    at = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    word = np.searchsorted(off, at, "right") - 1
    special = np.unique(word[at + 1 < off[word + 1]])
    upper = (data >= ord("A")) & (data <= ord("Z"))
    upper[ragged(off[special], off[special + 1] - off[special])] = False
    data[upper] |= 0x20
    del upper
    mark = IS_TAIL[data]
    run = mark.copy()  # the first mark of each run of marks within a word
    run[1:] &= ~mark[:-1]
    run[off[:-1]] |= mark[off[:-1]]
    runs = np.flatnonzero(run)
    tailed = mark[off[1:] - 1]
    tailed[special] = False
    del mark, run
    tailed = np.flatnonzero(tailed)
    cut = runs[np.searchsorted(runs, off[tailed + 1] - 1, "right") - 1]
    tailed, cut = tailed[cut > off[tailed]], cut[cut > off[tailed]]
    final = data[cut - 1]
    sure = IS_ALNUM[final]
    known: dict[bytes, bool] = {}
    for k in np.flatnonzero(final > 127):
        core = data[off[tailed[k]] : cut[k]].tobytes()
        if core not in known:
            known[core] = _letter(core)
        sure[k] = known[core]
    tailed, cut = tailed[sure], cut[sure]
    ends = np.append(0, np.insert(off[1:], tailed, cut)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]), w.doc + np.searchsorted(tailed, w.doc)


class WordTokenizer:
    """A tokenizer of the `tokenizers` library that lower-cases and whose matches never hold white space, nor letters
    and marks: each word's core and tail stand alone (`parts`), are encoded once, and are kept in one flat array.

    A special token's name in a text becomes that token, as the library has it unless told otherwise. Such names are
    case-sensitive and never hold white space: a word with "<|" goes to the library by itself and as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {b"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of each known word's ids in flat
        self.count = 1
        self.word_bytes = 0

    def _learn(self, words: list[bytes]):
        """Encodes words, many to a call. A word of letters is one match, whose last id alone ends a word: their ends
        show in the ids. Others are parted by a special token."""
        texts = [w.decode() for w in words]
        simple = [t.isalpha() and t.lower().isalpha() for t in texts]
        first = len(self.known)
        kept: list[bytes] = []
        for wanted, encode in ((True, self._simple), (False, self._marked)):
            own = [k for k, x in enumerate(simple) if x is wanted]
            for at in range(0, len(own), 20_000):
                encode([texts[k] for k in own[at : at + 20_000]])
            kept += [words[k] for k in own]
        self.known.update(zip(kept, range(first, first + len(kept)), strict=True))
        self.word_bytes += sum(map(len, kept))

    def _simple(self, part: list[str]):
        chunks = [part[k : k + 200] for k in range(0, len(part), 200)]
        for own, e in zip(chunks, self.tok.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(own):
                self._append(ids, ends)
            else:
                self._marked(own)

    def _marked(self, part: list[str]):
        odd = [k for k, w in enumerate(part) if "<|" in w]
        own = {k: self.tok.encode(part[k], add_special_tokens=False).ids for k in odd}
        part = [MARK[:1] if k in own else w for k, w in enumerate(part)]
        texts = [f" {MARK} ".join(part[k : k + 200]) for k in range(0, len(part), 200)]
        for c, e in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.append(np.flatnonzero(ids == MARK_ID), len(ids))
            keep = ids[ids != MARK_ID]
            ends = cut - np.arange(len(cut))
            for k in (k for k in own if c * 200 <= k < (c + 1) * 200):
                n = k - c * 200
                a, b = (ends[n - 1] if n else 0), ends[n]
                keep = np.concatenate([keep[:a], np.array(own[k], np.uint32), keep[b:]])
                ends[n:] += len(own[k]) - (b - a)
            self._append(keep, ends)

    def _append(self, ids: np.ndarray, ends: np.ndarray):
        used, n = int(self.ends[self.count - 1]), self.count
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ends) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[n : n + len(ends)] = ends + used
        self.count += len(ends)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, or parts of them, one after another, and the number of ids of each."""
        if len(self.known) > KEPT_WORDS or self.word_bytes + 4 * int(self.ends[self.count - 1]) > KEPT_BYTES:
            self.clear()
        number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            own = [words[k] for k in new]
            self._learn(list(dict.fromkeys(own)))
            number[new] = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        first = np.where(number > 0, self.ends[number - 1], 0)
        n = self.ends[number] - first
        return self.flat[ragged(first, n)], n


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokens_of(col: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each closed by end_id, and the offsets (n + 1) of the texts in them."""
    own, doc = parts(Words(col))
    d = own.dictionary_encode()
    del own
    codes = d.indices.to_numpy(zero_copy_only=False)
    flat, size = tokenizer(path).encode(d.dictionary.to_numpy(zero_copy_only=False).tolist())
    del d
    first = np.cumsum(size) - size
    n = size[codes] if len(codes) else np.zeros(0, np.int64)
    body = flat[ragged(first[codes], n)] if len(codes) else flat
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=before[1:])
    off = before[doc]
    del codes, flat, n, before
    if end_id is None:
        return body, off
    return np.insert(body, off[1:], np.uint32(end_id)), off + np.arange(len(off))


def pieces(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, doc_tokens, ids (binary: little-endian unsigned 32-bit).

    Each text is tokenised whole, closed by end_id and cut every seq_len ids. An empty or null text is the one id
    end_id; an empty table gives none; repeated rows give repeated pieces.
    """

    def run(batches):
        for b in text_slices(batches):
            ids, off = tokens_of(b.column(1), path, end_id)
            total = np.diff(off)
            n = -(-total // seq_len)
            row = np.repeat(np.arange(len(n)), n)
            start = ragged(np.zeros(len(n), np.int64), n) * seq_len
            length = np.minimum(seq_len, total[row] - start)
            cut = np.append(off[row] + start, off[-1]) * 4
            data = np.frombuffer(ids.astype("<u4").tobytes(), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(total[row]), binary_rows(data, cut)],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return arrow_map(pick(docs), run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """First fit in the given order: each item's bin and its offset there.

    The tournament tree holds at each node the largest room of the bins below it; the leftmost bin that takes an
    item is found by walking down from the root, in logarithmic time.
    """
    leaves = 1 << max(0, (max(1, len(lengths)) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offs = [], []
    for n in lengths:
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - leaves)
        offs.append(capacity - room[k])
        room[k] -= n
        k //= 2
        while k:
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
            k //= 2
    return bins, offs


def pack(rows: DataFrame, text_bytes: int, n_docs: int, seq_len: int = SEQ_LEN, seed: int = 17) -> DataFrame:
    """rows (doc_id, start, length, ...) -> the same and sequence_id, offset: first-fit decreasing in randomised groups.

    A piece's group comes from a seeded hash of its document, its start, and its place in the input (partition and row),
    so that no document, source, run of copies, repeated doc_id or null falls into one group; the number of groups
    follows the input. One shuffle of the pieces. The rows' order within an input partition has to be repeatable, as
    that of a table or of `pieces` is, so that a lost task deals the same groups again.

    Ties go by doc_id (null first), start, then the order in which they come; sequence_id is group * 2**32 + bin,
    offsets have no gaps from 0. Repeated rows are pieces of their own; columns named sequence_id or offset are
    replaced, others stay; an empty table gives none. A length above seq_len fails.
    """
    groups = max(1, text_bytes // GROUP_BYTES, n_docs // 8192)
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])
    out = StructType(list(rows.schema.fields)).add("sequence_id", "long").add("offset", "long")
    slot = "pack_group"
    while slot in kept:
        slot += "_"

    def place(table: pa.Table) -> pa.Table:
        if pc.max(table["length"]).as_py() > seq_len:
            raise ValueError(f"a piece is longer than {seq_len}")
        order = np.lexsort((table["start"].to_numpy(), table["doc_id"].fill_null(-(2**63)).to_numpy(), -table["length"].to_numpy()))
        table = table.take(pa.array(order))
        bins, offs = first_fit(table["length"].to_pylist(), seq_len)
        group = table[slot][0].as_py()
        at = pa.array(np.array(bins, np.int64) + (group << 32))
        return table.drop_columns([slot]).append_column("sequence_id", at).append_column("offset", pa.array(offs, pa.int64()))

    key = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("start"), F.monotonically_increasing_id()), F.lit(groups)).alias(slot)
    return rows.select("*", key).groupBy(slot).applyInArrow(place, out)


def volume(docs: DataFrame) -> tuple[int, int]:
    """UTF-8 bytes of all texts and the number of rows, in one aggregate."""
    r = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(r.b or 0), int(r.n)


def padding(packed: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row: sequences, tokens, and padding, where a sequence whose length is a power of two is not padded."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("bit_count(n) = 1"), 0).otherwise(F.lit(seq_len) - F.col("n"))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
