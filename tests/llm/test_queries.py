"""Each query's digests against plain Python over the whole table."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from brindle.llm import mpeg, quality, queries
from test_text_operators import BYTE_BPE, base_spans, brute_fingerprint, counts, key, removed

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def got(spark, name, *cols):
    return key(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, SF).collect())


def test_op2(spark, rows):
    names = ("assign", "access", "hex")
    want = []
    for i, t in rows:
        spans = base_spans(t)
        n = [sum(k == j for _, k, _ in spans) for j in range(3)]
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *n, sha(text)))
    assert got(spark, "op2_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == key(want)


def test_op3(spark, rows):
    assert got(spark, "op3_quality", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == key((i, *counts(t)) for i, t in rows)


def crc_of_bits(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ b else 0)
    return c


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def stream_by_hand(p):
    """The stream of a payload, byte by byte: MPEG-1 Layer III, 320 kbit/s, 32 kHz, mono, protected, frames of 1440 bytes."""
    head = bytes.fromhex("fffae8c0")
    lead = head + crc_of_bits(bits_of(head[2:] + bytes(17))).to_bytes(2, "big") + bytes(17)
    seven = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    text = b"\0payload_bytes\0" + str(len(p)).encode()
    tag = b"ID3\x04\0\0" + seven(len(text) + 10) + b"TXXX" + seven(len(text)) + b"\0\0" + text
    parts = [p[k : k + 1417] for k in range(0, len(p), 1417)]
    n = len(parts)
    seek = bytes(min(255, 256 * (1 + k * n // 100) // (n + 1)) for k in range(100))
    table = lead + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + (1440 * (n + 1)).to_bytes(4, "big") + seek
    media = tag + table + bytes(1440 - len(table)) + b"".join(lead + x + bytes(1417 - len(x)) for x in parts)
    first = len(tag) + 1440
    told = f"rate=32000;frames={n};samples={1152 * n};seconds={1152 * n / 32000:.6f};kbps=320.000;vbr=Xing:{n};checked={n + 1};bad=0;skipped=0;first={first};last={first + 1440 * (n - 1)};mid={first + 1440 * (n // 2)}"
    return media, told


def test_op4(spark, rows):
    want = []
    for i, t in rows:
        raw = t.encode()
        p = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        m, told = stream_by_hand(p)
        want.append((i, len(raw), len(p), sha(p), zlib.crc32(p[-64:]), len(m), sha(m), told))
    assert got(spark, "op4_mpeg", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == key(want)


def test_checksums_of_layers_one_and_two():
    import random

    rng = random.Random(8)
    four, three, two = [4], [3], [2]
    widths = {
        # (layer, header word without protection bit, bytes of a frame): bits of allocation by subband
        (1, 0xFFFE1000, 32, 1): four * 32,  # 32 kbit/s, 44.1 kHz
        (1, 0xFFFEE000, 484, 2): four * 32,  # 448 kbit/s, 44.1 kHz
        (2, 0xFFFCE400, 1152, 2): four * 11 + three * 12 + two * 4,  # 384 kbit/s, 48 kHz
        (2, 0xFFFCE000, 1253, 2): four * 11 + three * 12 + two * 7,  # 384 kbit/s, 44.1 kHz
        (2, 0xFFFC1000, 104, 1): four * 2 + three * 6,  # 32 kbit/s, 44.1 kHz
        (2, 0xFFFC1800, 144, 1): four * 2 + three * 10,  # 32 kbit/s, 32 kHz
        (2, 0xFFF48000, 417, 2): four * 4 + three * 7 + two * 19,  # MPEG-2: 64 kbit/s, 22.05 kHz
    }
    for (layer, word, size, channels), bits in widths.items():
        for mode in ([3] if channels == 1 else [0, 1, 1, 1]):
            bound = 4 * (ext := rng.randrange(4)) + 4 if mode == 1 else 32
            word_ = word | mode << 6 | (ext << 4 if mode == 1 else 0)
            head = word_.to_bytes(4, "big")
            body, used = [], 0
            for k, n in enumerate(bits):
                for c in range(1 if mode == 3 or k >= bound else 2):
                    v = rng.choice([0, rng.randrange(1 << n)])
                    body += [v >> j & 1 for j in range(n - 1, -1, -1)]
                    used += (v > 0) * (2 if mode == 1 and k >= bound else 1)
            body += [rng.randrange(2) for _ in range(2 * used * (layer == 2))]
            crc = crc_of_bits(bits_of(head[2:]) + body)
            rest = body + [rng.randrange(2) for _ in range(8 * (size - 6) - len(body))]
            assert len(rest) == 8 * (size - 6)
            data = bytes(int("".join(map(str, rest[k : k + 8])), 2) for k in range(0, len(rest), 8))
            good = mpeg.read((head + crc.to_bytes(2, "big") + data) * 3)
            assert (good.checked, good.bad_checksums, len(good.offsets), good.first.layer) == (3, 0, 3, layer), (hex(word_), size, good.first and good.first.size)
            assert mpeg.read((head + (crc ^ 1).to_bytes(2, "big") + data) * 3).bad_checksums == 3


def test_odd_media(spark, corpus):
    whole = stream_by_hand(b"x" * 6400)[0]
    odd = {
        0: (whole, b"x" * 6400, True),
        1: (whole.replace(b"payload_bytes\x006400", b"payload_bytes\x00xyz9"), None, False),
        2: (whole[:1490] + whole[1490 + 1440 :], None, False),  # a frame lost
        3: (whole.replace(b"\x006400", b"\x00\xb2\xb300"), None, False),
        4: (b"", b"", False),
        5: (None, b"", False),
        6: (b"no sound at all", b"", False),
        7: (whole[:-700], None, False),
    }
    frame = spark.createDataFrame([(k, 0, m) for k, (m, _, _) in odd.items()], "doc_id long, n_bytes long, media binary").selectExpr("*", "1 as seconds", "2 as payload")
    for r in mpeg.info(frame).collect():
        _, body, ok = odd[r.doc_id]
        assert r.whole == ok and (body is None or bytes(r.payload) == body), r.doc_id
    assert mpeg.info(mpeg.store(corpus.limit(0))).count() == 0 and all(r.whole for r in mpeg.info(mpeg.store(corpus)).collect())


def test_op4_tail_of_wide_characters(spark, tmp_path):
    text = "ä日" * 90
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = {x.doc_id: x for x in queries.op4_mpeg(spark, str(tmp_path)).collect()}
    assert r[1].tail_crc32 == zlib.crc32(mpeg.padded(text)[1][-64:]) and r[2].payload_bytes == 64 and r[2].tail_crc32 == zlib.crc32(bytes(64))


def test_op5(spark, rows):
    r = got(spark, "op5_toxicity", "doc_id", "held_out", "predicted", "score")
    assert [(x[0], x[1]) for x in r] == [(i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in key(rows)]
    assert all(p == (s >= 0.5) for _, _, p, s in r)


def test_op7(spark, rows):
    want = [(i, n, gone, sha(kept)) for i, n, gone, kept in removed(rows, 50)]
    assert got(spark, "op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == key(want)


def test_op8(spark, rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert got(spark, "op8_simhash", "doc_id", "fingerprint", "component_id") == key((i, f"{f:016x}", least[i]) for i, f in fps.items())


def test_op10(spark, rows):
    import base64

    import tiktoken

    with open(BYTE_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids), sha(" ".join(map(str, ids))), sha(t)) for i, t in rows for ids in [enc.encode_ordinary(t)]]
    assert got(spark, "op10_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == key(want)


def test_contract_columns(spark):
    kinds = {
        "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
        "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    }
    for name, want in kinds.items():
        frame = queries.QUERIES[name](spark, SF)
        assert ", ".join(f"{a} {b}" for a, b in frame.dtypes) == want
    assert re.match("op6_", next(n for n in queries.QUERIES if n.startswith("op6_")))


def features_by_hand(t):
    """What the rules look at, in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n_words, word_chars, n_symbols, n_dup, n_repeat = counts(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = len(re.findall("[A-Z]", t))
    letters = upper + len(re.findall("[a-z]", t)) + sum(len(c.encode()) > 1 and c.encode()[0] >= 0xC3 for c in t)
    stops = sum(x.encode().lower() in quality.STOPS for x in w)
    return n_words, word_chars, n_symbols, n_dup, n_repeat, len(lines), upper, letters, sum(len(x.encode()) > 25 for x in w), stops


def votes_by_hand(f):
    words, chars, symbols, dup, repeat, lines, upper, letters, long_, stops = f
    n, mean = max(words, 1), chars / max(words, 1)
    return (
        -1 if symbols / n > 0.12 else 0,
        -1 if upper / max(letters, 1) > 0.5 and letters >= 40 else 0,
        -1 if repeat / n > 0.12 else 0,
        -1 if dup >= 3 and dup / max(lines, 1) > 0.3 else 0,
        -1 if words < 10 else 0,
        -1 if mean < 2.5 or mean > 14 else 1 if 3.5 <= mean <= 10 else 0,
        -1 if long_ / n > 0.05 else 0,
        -1 if stops / n < 0.02 and words >= 30 else 1 if stops / n > 0.15 else 0,
    )


def posterior_by_hand(votes):
    """Expectation-maximisation over single texts."""
    import math

    n = len(votes)
    p = [(sum(x == 1 for x in v) + 2.0) / (sum(x == 1 for x in v) + 4.0 * sum(x == -1 for x in v) + 2.5) for v in votes]
    smooth = [[4.0, 2.0, 1.0], [0.5, 2.0, 4.0]]
    scale = max(20.0, n / 50)
    for _ in range(200):
        prior = min(0.98, max(0.02, sum(p) / n))
        rates = []
        for k in range(len(votes[0])):
            cell = [[sum((q if c else 1 - q) for v, q in zip(votes, p, strict=True) if v[k] == x - 1) / n + smooth[c][x] / scale for x in range(3)] for c in range(2)]
            rates.append([[y / sum(row) for y in row] for row in cell])
        new = []
        for v in votes:
            good = math.log(prior) + sum(math.log(rates[k][1][x + 1]) for k, x in enumerate(v))
            bad = math.log(1 - prior) + sum(math.log(rates[k][0][x + 1]) for k, x in enumerate(v))
            new.append(1 / (1 + math.exp(bad - good)))
        done = max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-7
        p = new
        if done:
            break
    return p


def test_op3_verdicts(spark, rows):
    features = [features_by_hand(t) for _, t in rows]
    good = posterior_by_hand([votes_by_hand(f) for f in features])
    want = {i: (f[0] < 10 or 100 * f[4] > 20 * f[0], q) for (i, _), f, q in zip(rows, features, good, strict=True)}
    found = queries.op3_quality(spark, SF).collect()
    assert len(found) == len(want) == len(rows)
    for r in found:
        failed, q = want[r.doc_id]
        assert r.base_failed == failed and r.quality == pytest.approx(q, abs=1e-5)
        assert r.kept == (not failed and q >= 0.5) or abs(q - 0.5) < 1e-5
    assert {r.kept for r in found} == {True, False}
