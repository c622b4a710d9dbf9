import hashlib
import os
import random
import zlib

import pytest

from lockstep.llm import flac


def payloads():
    r = random.Random(1)
    texts = ["", None, "a" * 5000, "hello wörld " * 300, "".join(chr(r.randrange(32, 50000)) for _ in range(3000))]
    return [flac.padded(t)[1] for t in texts] + [os.urandom(4096), bytes(range(256)) * 10, b"\0\xff" * 640, bytes(i % 7 * 3 + 100 for i in range(6400))]


def test_round_trip_and_seeking():
    held = payloads()
    media = flac.encode(held)
    assert flac.decode(media) == held
    for p, m in zip(held, media, strict=True):
        for start, n in ((0, 10), (1000, 1500), (len(p) - 3, 3), (0, len(p)), (5, 0)):
            assert flac.read_range(m, start, n) == p[start : start + n]


def test_frame_numbers_follow_utf8():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 0x10FFFF):
        assert flac._frame_number(n) == chr(n).encode("utf-8", "surrogatepass")


def test_checks_find_changed_bytes():
    media = flac.encode([b"some words of text, padded out to it".ljust(64, b".") * 40])[0]
    first = int(flac.seek_points(media)[0][0, 1])
    for at in (first, first + 5, first + 40, len(media) - 1):
        wrong = media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :]
        with pytest.raises(ValueError):
            flac.decode([wrong])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + media[4:]])


def test_known_checksums():
    # CRC-8 (polynomial 07) and CRC-16 (polynomial 8005) of "123456789".
    import numpy as np

    data = b"123456789"
    assert flac._crc8(data) == 0xF4
    assert flac._crc16(np.frombuffer(data, np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8


class Bits:
    """Bits in and out, one at a time."""

    def __init__(self, data=b""):
        self.bits, self.at = [b >> k & 1 for b in data for k in range(7, -1, -1)], 0

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << 7 - k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))

    def get(self, n, signed=False):
        value = 0
        for _ in range(n):
            value, self.at = value << 1 | self.bits[self.at], self.at + 1
        return value - (1 << n) if signed and n and value >> n - 1 else value


def plain_crc(data, poly, width):
    crc = 0
    for b in data:
        crc ^= b << width - 8
        for _ in range(8):
            crc = (crc << 1 ^ (poly if crc >> width - 1 else 0)) & (1 << width) - 1
    return crc


def plain_decode(media):
    """Samples of a stream, bit by bit, by the published format."""
    bits, last = Bits(media), 0
    assert bits.get(32) == 0x664C6143
    while not last:
        last, _, size = bits.get(1), bits.get(7), bits.get(24)
        bits.at += 8 * size
    out = []
    while bits.at < len(bits.bits):
        begin = bits.at // 8
        assert bits.get(16) == 0xFFF8
        code = bits.get(4)
        bits.at += 12
        lead = bits.get(8)
        more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        bits.at += 8 * more
        n = (bits.get(8) if code == 6 else bits.get(16)) + 1
        assert bits.get(8) == plain_crc(media[begin : bits.at // 8 - 1], 0x07, 8)
        kind = bits.get(8) >> 1
        if kind == 0:
            x = [bits.get(8, True)] * n
        elif kind == 1:
            x = [bits.get(8, True) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [bits.get(8, True) for _ in range(order)]
            shift, weights = 0, {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order)
            if kind >= 32:
                precision, shift = bits.get(4) + 1, bits.get(5)
                weights = [bits.get(precision, True) for _ in range(order)]
            width, parts = (5 if bits.get(2) else 4), bits.get(4)
            for p in range(1 << parts):
                k = bits.get(width)
                raw = bits.get(5) if k == (1 << width) - 1 else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is not None:
                        r = bits.get(raw, True)
                    else:
                        q = 0
                        while not bits.get(1):
                            q += 1
                        u = q << k | bits.get(k)
                        r = u >> 1 ^ -(u & 1)
                    x.append(r + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
        bits.at += -bits.at % 8
        assert bits.get(16) == plain_crc(media[begin : bits.at // 8 - 2], 0x8005, 16)
        out += x
    return bytes(x + 128 for x in out)


def test_a_bit_by_bit_decoder_agrees():
    r = random.Random(4)
    held = [p for p in payloads() if len(p) < 9000] + [bytes(min(255, max(0, 128 + int(100 * (i % 200 - 100) / 100) + r.randrange(3))) for i in range(2048))]
    for p, m in zip(held, flac.encode(held), strict=True):
        assert plain_decode(m) == p


def crafted(r, x, kind, order, method):
    """A stream of one frame with a predictor and random Rice parts, some of them escaped."""
    n, parts = len(x), r.choice([0, 1, 2])
    weights, shift, precision = [{0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order), 0, 0]
    sub = 8 | order
    if kind == "linear":
        precision, shift, sub = r.randrange(5, 13), r.randrange(0, 7), 31 + order
        weights = [r.randrange(-(1 << precision - 1), 1 << precision - 1) // (4 * order) for _ in range(order)]
    b = Bits()
    b.put(0, 1), b.put(sub, 6), b.put(0, 1)
    for v in x[:order]:
        b.put(v & 255, 8)
    if kind == "linear":
        b.put(precision - 1, 4), b.put(shift, 5)
        for w in weights:
            b.put(w & (1 << precision) - 1, precision)
    b.put(method, 2), b.put(parts, 4)
    rest = [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, n)]
    at, width = 0, 5 if method else 4
    for p in range(1 << parts):
        own = rest[at : at + (n >> parts) - (order if p == 0 else 0)]
        at += len(own)
        need = max((max(v, ~v).bit_length() + 1 for v in own), default=0)
        if r.random() < 0.3 and need < 32:
            b.put((1 << width) - 1, width), b.put(need, 5)
            for v in own:
                b.put(v & (1 << need) - 1, need)
            continue
        k = max(0, min(need - 2, 14))
        b.put(k, width)
        for v in own:
            u = 2 * v if v >= 0 else -2 * v - 1
            b.put(1, (u >> k) + 1), b.put(u & (1 << k) - 1, k)
    head = b"\xff\xf8\x70\x02\x00" + (n - 1).to_bytes(2, "big")
    frame = head + bytes([plain_crc(head, 0x07, 8)]) + b.data()
    frame += plain_crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in x)).digest()
    point = (0).to_bytes(16, "big") + n.to_bytes(2, "big")
    return b"fLaC\0" + (34).to_bytes(3, "big") + info + b"\x83" + len(point).to_bytes(3, "big") + point + frame


def test_all_predictors_and_escapes():
    r = random.Random(5)
    streams, want = [], []
    for kind, order in [*(("fixed", o) for o in range(5)), *(("linear", o) for o in (1, 2, 3, 8, 32))]:
        for method in (0, 1):
            for n in (64, 128, 1024):
                x = [max(-128, min(127, int(60 * ((i * 7 + order) % 50 - 25) / 25) + r.randrange(-9, 10))) for i in range(n)]
                streams.append(crafted(r, x, kind, order, method))
                want.append(bytes(v + 128 for v in x))
    assert flac.decode(streams) == want == [plain_decode(m) for m in streams]


def test_query_rows(spark):
    rows = [(1, "Text"), (2, None), (3, ""), (3, ""), (None, "Text"), (5, "é" * 40_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, media string, n_bytes int")
    rows_of = flac.stored_blocks(docs, ["doc_id"])
    got = flac.block_digests(rows_of, ["doc_id", "n_bytes", "media_bytes", "media_sha256"]).collect()
    want = []
    for key, text in rows:
        n, p = flac.padded(text)
        want.append((key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got), key=repr) == sorted(want, key=repr)
    assert len({(x.media_sha256, x.media_bytes, x.feature) for x in got if x.n_bytes == 4}) == 1
    assert flac.with_media(docs.limit(0), ["doc_id"]).collect() == []


def test_blocks_are_written_by_offset(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc " * 1000), (2, None)], "doc_id long, text string")
    flac.write_pcm_blocks(flac.with_media(docs, ["doc_id"]), "doc_id", str(tmp_path / "pcm"))
    rows = spark.read.parquet(str(tmp_path / "pcm")).orderBy("doc_id", "sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in rows if r.doc_id == 1) == flac.padded("abc " * 1000)[1]
    assert [r.sample_offset for r in rows if r.doc_id == 1] == [0, 1024, 2048, 3072]


def test_the_query_itself(spark, tmp_path):
    texts = {1: "Some text " * 400, 2: None, 3: "", 4: "ü" * 3000}
    spark.createDataFrame([*texts.items(), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in flac.op2_flac_media(spark, str(tmp_path)).collect()}
    assert len(got) == 5
    for i, t in texts.items():
        n, p = flac.padded(t)
        media = flac.encode([p])[0]
        assert plain_decode(media) == p
        assert got[i] == (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), flac.feature(p))
    blocks = flac.block_rows(flac.stored_blocks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ["doc_id"]), ["doc_id"])
    for x in blocks.collect():
        media = flac.encode([flac.padded(texts[x.doc_id])[1]])[0]
        assert media[x.byte_offset : x.byte_offset + 2] == b"\xff\xf8" and flac.read_range(media, x.sample_offset, x.n_samples) == bytes(x.pcm)
