"""Media columns for MPEG audio: write and read Layer III streams, with tags, seek tables, checksums and frame offsets."""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, text_slices

# Fixed values of the format (ISO 11172-3, 13818-3): kbit/s by version group and layer, Hz by version, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
VERSIONS, LAYERS = {3: 1, 2: 2, 0: 2.5}, {3: 1, 2: 2, 1: 3}

#: The stream that payloads are stored in: MPEG-1 Layer III, mono, 320 kbit/s at 32 kHz: frames of 1440 bytes.
HEADER = struct.pack(">I", 0xFFE00000 | 3 << 19 | 1 << 17 | 0 << 16 | 14 << 12 | 2 << 10 | 3 << 6)
FRAME, SIDE = 1440, 17
#: Bytes of payload in a frame: what is left after header, checksum and (empty) side information.
ROOM = FRAME - 4 - 2 - SIDE
#: The tag that gives the stored payload's length.
LENGTH_TAG = "payload_bytes"


@functools.lru_cache(1)
def _crc_table() -> tuple[int, ...]:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return tuple(out)


@functools.lru_cache(4096)
def crc16(data: bytes, bits: int = 0) -> int:
    """The checksum of a frame: over the last two header bytes and what follows the checksum, from 0xFFFF; of the last
    byte only the first `bits` count, if not 0."""
    t, c = _crc_table(), 0xFFFF
    for b in data[: len(data) - bool(bits)]:
        c = ((c << 8) & 0xFFFF) ^ t[(c >> 8) ^ b]
    for k in range(bits):
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (data[-1] >> (7 - k) & 1) else 0)
    return c


# Fixed values of the format: bits of allocation in each subband of Layer II, as (bits, subbands) from the lowest, by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    bound: int = 32  # the first subband that both channels share

    @property
    def allocation(self) -> list[int]:
        """Layer I and II: the bits of allocation of each subband."""
        if self.layer == 1:
            return [4] * 32
        rate = self.bitrate // (1 if self.mono else 2)
        if self.version != 1:
            table = "low"
        elif rate >= 56 and (self.rate == 48000 or rate <= 80):
            table = "a"
        elif rate >= 96:
            table = "b"
        else:
            table = "d" if self.rate == 32000 else "c"
        return [bits for bits, n in ALLOCATION[table] for _ in range(n)]

    def checksum(self, frame: bytes) -> int | None:
        """What the checksum of a protected frame has to be; None where the frame is too short for what it covers."""
        if self.layer == 3:
            return crc16(frame[2:4] + frame[6 : 6 + self.side])
        at = 48  # bits of header and checksum before the allocation
        used, shared = 0, 0
        for k, n in enumerate(self.allocation):
            for _ in range(1 if self.mono or k >= self.bound else 2):
                if at + n > 8 * len(frame):
                    return None
                word = int.from_bytes(frame[at // 8 : at // 8 + 2].ljust(2, b"\0"), "big")
                on = word >> (16 - at % 8 - n) & ((1 << n) - 1) > 0
                used += on
                shared += on and k >= self.bound and not self.mono
                at += n
        if self.layer == 2:  # the selection of scale factors too, two bits for each channel of a subband in use
            at += 2 * (used + shared)
        if at > 8 * len(frame):
            return None
        return crc16(frame[2:4] + frame[6 : -(-at // 8)], at % 8)

    @property
    def samples(self) -> int:
        return SAMPLES[1 if self.version == 1 else 2, self.layer]

    @property
    def size(self) -> int:
        """Bytes of the frame."""
        if self.layer == 1:
            return (12000 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@functools.lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The header that four bytes hold, or None. Free-format and reserved values are none."""
    if len(word) < 4:
        return None
    h = int.from_bytes(word, "big")
    version, layer = VERSIONS.get(h >> 19 & 3), LAYERS.get(h >> 17 & 3)
    bitrate, rate = h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version is None or layer is None or bitrate in (0, 15) or rate == 3:
        return None
    kbit = BITRATES[1 if version == 1 else 2, layer][bitrate]
    bound = 4 * (h >> 4 & 3) + 4 if h >> 6 & 3 == 1 and layer < 3 else 32
    return Header(version, layer, not h >> 16 & 1, kbit, RATES[version][rate], h >> 9 & 1, h >> 6 & 3 == 3, bound)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _from_synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def write(payload: bytes) -> bytes:
    """A stream that holds the payload: an ID3v2.4 tag with its length, a Xing frame with a seek table, protected frames."""
    text = b"\x00" + LENGTH_TAG.encode() + b"\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    out = [b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag]
    frames = -(-len(payload) // ROOM)
    checked = HEADER + crc16(HEADER[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
    total = (frames + 1) * FRAME
    seek = bytes(min(255, (FRAME + i * frames // 100 * FRAME) * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, frames, total) + seek
    out.append((checked + xing).ljust(FRAME, b"\x00"))
    for at in range(0, len(payload), ROOM):
        part = payload[at : at + ROOM]
        out += (checked, part)
        if len(part) < ROOM:
            out.append(bytes(ROOM - len(part)))
    return b"".join(out)


@dataclass
class Stream:
    """What a stream holds. offsets and starts: each audio frame's place in bytes and its first sample."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    seconds: float = 0.0
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    kbits: int = 0

    def seek(self, second: float) -> int | None:
        """The byte offset of the frame that plays at a time, exact."""
        if not self.offsets or self.first is None:
            return None
        from bisect import bisect_right

        return self.offsets[max(0, bisect_right(self.starts, int(second * self.first.rate)) - 1)]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a leading ID3v2.3 or 2.4 tag; the bytes that it takes. Broken frames end it."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    end = min(len(data), 10 + _from_synchsafe(data[6:10]))
    at = 10
    if data[5] & 0x40 and end - at >= 4:
        at += _from_synchsafe(data[at : at + 4]) if data[3] == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + 10 <= end and data[at] != 0:
        n = _from_synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
        if n <= 0 or at + 10 + n > end:
            break
        if name[0] == "T":
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\x00")
            if name == "TXXX" and "\x00" in text:
                name, _, text = text.partition("\x00")
            tags[name] = text
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0)


def _id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads a trailing ID3v1 tag; the bytes that it takes."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return 0
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        text = data[len(data) - 128 + a : len(data) - 128 + b].split(b"\x00")[0].decode("latin-1").strip()
        if text:
            tags.setdefault(name, text)
    return 128


def _vbr(frame: bytes, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table of a first frame, or nothing."""
    for at in (4 + 2 * h.protected + h.side, 4 + h.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out: dict[str, object] = {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["seek"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, n, scale, width, _ = struct.unpack(">HHHIIHHHH", frame[40:62])
        cells = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "seek": cells}
    return {}


def read(data: bytes) -> Stream:
    """Parses any byte string; what is no frame is skipped.

    A sync word counts if the next frame follows where the header says, with the same version, layer and rate, or
    if the data ends there; otherwise the search goes on one byte later. Free format (bit rate index 0), whose headers do
    not tell a frame's size, is skipped. Checksums are verified in all three layers.
    """
    s = Stream()
    at = _id3v2(data, s.tags)
    end = len(data) - _id3v1(data, s.tags)

    def like(a: Header | None, b: Header) -> bool:
        return a is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)

    locked, table = False, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and at + h.size <= end and (s.first is None or like(h, s.first))
        if good and not locked and at + h.size + 4 <= end:
            good = like(header(data[at + h.size : at + h.size + 4]), h)
        if not good:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            s.skipped += step - at
            at, locked = step, False
            continue
        locked = True
        if h.protected:
            s.checked += 1
            s.bad_checksums += h.checksum(data[at : at + h.size]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if s.first is None:
            s.first = h
            s.vbr = _vbr(data[at : at + h.size], h)
            table = bool(s.vbr)
        if table:
            table = False  # the table's frame plays nothing
        else:
            s.offsets.append(at)
            s.sizes.append(h.size)
            s.starts.append(s.samples)
            s.samples += h.samples
            s.kbits += h.bitrate
        at += h.size
    s.skipped += max(0, end - at)
    s.seconds = s.samples / s.first.rate if s.first else 0.0
    return s


def payload(data: bytes, s: Stream) -> tuple[bytes, bool]:
    """The payload that write() put into a stream, and whether it is whole: its length tag is there and a number, no frame
    is lost, no checksum is wrong, and nothing had to be skipped. Of a stream that is not, what its frames hold in place."""
    lead = 4 + 2 + SIDE
    body = b"".join(data[o + lead : o + n] for o, n in zip(s.offsets, s.sizes, strict=True))
    told = s.tags.get(LENGTH_TAG, "")
    size = int(told) if told.isascii() and told.isdigit() and len(told) < 16 else None
    kept = body if size is None else body[:size]
    whole = size == len(kept) and len(s.offsets) == s.vbr.get("frames") == -(-size // ROOM) and not s.skipped and not s.bad_checksums
    return kept, whole


def feature(s: Stream) -> str:
    """A stream's figures as one line."""
    rate = s.first.rate if s.first else 0
    n = max(1, len(s.offsets))
    return (
        f"rate={rate};frames={len(s.offsets)};samples={s.samples};seconds={s.seconds:.6f};kbps={s.kbits / n:.3f};vbr={s.vbr.get('kind', '')}:"
        f"{s.vbr.get('frames', 0)};checked={s.checked};bad={s.bad_checksums};skipped={s.skipped};"
        f"first={s.offsets[0] if s.offsets else -1};last={s.offsets[-1] if s.offsets else -1};mid={s.seek(s.seconds / 2)}"
    )


def padded(text: str) -> tuple[int, bytes]:
    """The bytes of a text, and the text with zero bytes up to a positive multiple of 64."""
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media: each whole text's padded bytes as an MPEG stream. A null text is empty;
    repeated rows stay; other columns are ignored; an empty table gives none. No shuffle."""

    def run(batches):
        for b in text_slices(batches, limit=1 << 20):
            rows = [padded(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([write(p) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow_map(pick(docs), run, "doc_id long, n_bytes long, media binary")


#: What info adds.
INFO = {
    "seconds": "double",
    "samples": "long",
    "rate": "int",
    "frame_offsets": "array<long>",
    "frame_starts": "array<long>",
    "tags": "map<string,string>",
    "vbr": "string",
    "bad_checksums": "long",
    "skipped": "long",
    "payload": "binary",
    "whole": "boolean",
    "feature": "string",
}
TYPES = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string()), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def info(media: DataFrame, id_cols: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """media (id_cols, media) -> id_cols, media and INFO. Null or unreadable media have no frames and duration 0, and a
    payload that is not whole; repeated rows stay; columns other than id_cols are ignored, and id_cols must not bear INFO's
    names; an empty table gives none. No shuffle."""
    kept = media.select(*[F.col(f"`{c}`") for c in id_cols], "media")
    types = [TYPES[t] for t in INFO.values()]

    def row(m: bytes) -> tuple:
        s = read(m)
        body, whole = payload(m, s)
        rate = s.first.rate if s.first else 0
        return s.seconds, s.samples, rate, s.offsets, s.starts, list(s.tags.items()), str(s.vbr.get("kind", "")), s.bad_checksums, s.skipped, body, whole, feature(s)

    def run(batches):
        for b in batches:
            i = 0
            data = b.column(b.schema.get_field_index("media"))
            while i < b.num_rows:
                j, size = i, 0
                rows = []
                while j < b.num_rows and (j == i or size < 1 << 20):
                    m = data[j].as_py() or b""
                    rows.append(row(m))
                    size += len(m)
                    j += 1
                part = b.slice(i, j - i)
                made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *INFO])
                i = j

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} {t}" for c, t in INFO.items())])
    return arrow_map(kept, run, schema)
