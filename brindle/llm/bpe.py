"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, arrow_map, binary_rows, pick, text_slices

#: Texts above this many characters are cut at safe boundaries before the library sees them.
PART_CHARS = 1 << 16
#: Runs of white space from this length on are cut out: the library's regular expression engine recurses over them.
RUN_CHARS = 1 << 12
#: The code points of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN_CHARS},}}")
#: No match of public_tokenizers.PATTERN holds white space after another character, or a letter and a digit: these places part matches.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?)])(?=[ \n\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


class Codec:
    """The tiktoken library over one rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cuts = pattern == public_tokenizers.PATTERN  # the safe places are this pattern's
        self.enc = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.binary())

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, whatever its length; with another pattern than the default one it is never cut."""
        if len(text) < RUN_CHARS or not self.cuts:
            return self.enc.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([np.zeros(0, np.uint32), *self._parts(text)])

    def _parts(self, text: str):
        at = 0
        for run in LONG_RUN.finditer(text):
            # `\s+(?!\S)` leaves the last white space to what follows; at the end of the text it takes all.
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from self._plain(text[at : run.start()])
            yield np.array(self.enc._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32)
            at = end
        yield from self._plain(text[at:])

    def _plain(self, text: str):
        at = 0
        while len(text) - at > PART_CHARS:
            cut = SAFE.search(text, at + PART_CHARS)
            if not cut:
                break
            yield self.enc.encode_to_numpy(text[at : cut.start()], disallowed_special=())
            at = cut.start()
        if at < len(text):
            yield self.enc.encode_to_numpy(text[at:], disallowed_special=())

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The bytes of ids[off[i]:off[i + 1]] for each i; bytes, as a row may end inside a character."""
        flat = self.pieces.take(pa.array(ids.astype(np.int64)))
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
        return binary_rows(data[ends[0] : ends[-1]], (ends - ends[0])[off])


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids array<int>, and with `decoded` the decoded bytes.

    Whole texts, each match of `pattern` separately, no special tokens. No shuffle: one pass in Arrow batches.
    A null or empty text has no ids; strings that look like special tokens are ordinary text; repeated rows and
    ties stay as they are; an empty table gives an empty table; columns other than doc_id and text are ignored.
    """

    def run(batches):
        c = codec(path, pattern)
        for b in text_slices(batches, limit=CHUNK_BYTES):
            each = [c.encode(t) for t in b.column(1).to_pylist()]
            off = np.zeros(len(each) + 1, np.int64)
            np.cumsum([len(x) for x in each], out=off[1:])
            ids = np.concatenate([np.zeros(0, np.uint32), *each])
            out = [b.column(0), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            if decoded:
                out.append(c.decode(ids, off))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    return arrow_map(pick(docs), run, "doc_id long, n_tokens long, ids array<int>" + ", decoded binary" * decoded)


def decode(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """rows (doc_id, ids array<int>) -> doc_id, decoded binary; null ids decode to no bytes."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            col = b.column(1).fill_null([])
            off = col.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), c.decode(col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0])], names=["doc_id", "decoded"])

    return arrow_map(rows.select("doc_id", "ids"), run, "doc_id long, decoded binary")
