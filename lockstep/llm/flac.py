"""Media columns: bytes as 8-bit mono FLAC, by the published format (RFC 9639).

A stream holds STREAMINFO (with the MD5 of its samples), a SEEKTABLE with a point for each frame, and
frames of up to 1024 samples. Frames carry one subframe: constant, verbatim, or a fixed or quantised
linear predictor with Rice-coded residuals in partitions. Coding and decoding go through many frames at
once: all first samples, then all second ones, and so on, so numpy does the work of the bit loops.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, written

BLOCK, PARTS, RATE, UNIT, LANES = 1024, 2, 8000, 64, 1024
LPC_BITS, LPC_SHIFT = 8, 6


def _crc_table(poly: int, width: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        crc = np.where(crc >> (width - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << width) - 1)
    return crc


CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _two_bytes(t: np.ndarray) -> np.ndarray:
    """The state after two bytes, by the old state xor these bytes."""
    x = np.arange(65536, dtype=np.uint32)
    x = (x << 8 & 0xFFFF) ^ t[x >> 8]
    return ((x << 8 & 0xFFFF) ^ t[x >> 8]).astype(np.uint16)


CRC16 = _two_bytes(_CRC16)
ZEROS16 = np.array([16 - int(x).bit_length() for x in range(65536)], dtype=np.int64)
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _frame_number(n: int) -> bytes:
    """A number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << 5 * k + 1)
    lead = 0xFF00 >> size & 0xFF | n >> 6 * (size - 1)
    return bytes([lead, *(0x80 | n >> 6 * k & 0x3F for k in reversed(range(size - 1)))])


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def _crc16(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges of one buffer, two bytes a step."""
    order = np.argsort(-size, kind="stable")
    start, left = at[order], size[order]
    odd = left & 1
    crc = np.zeros(len(order), np.uint16)
    # An odd range is led by one byte on its own.
    first = buf[np.minimum(start, len(buf) - 1)]
    crc[odd == 1] = _CRC16[first[odd == 1]]
    start, pairs = start + odd, left >> 1
    active = np.searchsorted(-pairs, -np.arange(1, (pairs.max() if len(pairs) else 0) + 1), side="right")
    pad = np.append(buf, np.uint8(0)).astype(np.uint16)
    word = pad[:-1] << 8 | pad[1:]
    for i, m in enumerate(active):
        crc[:m] = CRC16[crc[:m] ^ word[start[:m] + 2 * i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _encode_frames(x: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the rows of x (int32, as many samples as n says, in fours), each byte-aligned."""
    frames, width = x.shape
    cols = np.arange(width)
    valid = cols < n[:, None]
    x = np.where(valid, x, 0)
    candidates, costs = [], []
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[:, 1:], two[:, 2:] = x[:, :-1], x[:, :-2]
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1) + 1e-9, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    under = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    lpc = np.clip(np.rint(np.stack([r1 * (r0 - r2) / under, (r0 * r2 - r1 * r1) / under]) * (1 << LPC_SHIFT)), -128, 127).astype(np.int32)
    for order, predicted in ((0, 0), (1, one), (2, 2 * one - two), (2, (lpc[0][:, None] * one + lpc[1][:, None] * two) >> LPC_SHIFT)):
        r = np.where(valid & (cols >= order), x - predicted, 0)
        candidates.append(r)
        costs.append(np.abs(r).sum(1) + 12 * order + (25 if len(costs) == 3 else 0))
    kind = np.argmin(costs, axis=0)
    order = np.array([0, 1, 2, 2])[kind]
    r = np.choose(kind[:, None], candidates)
    u = np.where(r < 0, -2 * r - 1, 2 * r)
    warm = cols < order[:, None]

    # Rice parameters of the partitions, from their means.
    part = cols // np.maximum(n[:, None] >> PARTS, 1)
    part = np.minimum(part, (1 << PARTS) - 1)
    k = np.zeros((frames, 1 << PARTS), np.int32)
    for p in range(1 << PARTS):
        inside = valid & ~warm & (part == p)
        k[:, p] = np.clip(np.floor(np.log2(np.maximum((u * inside).sum(1) / np.maximum(inside.sum(1), 1), 1))), 0, 14)
    ks = np.take_along_axis(k, part, axis=1)
    q = u >> ks
    length = np.where(valid, np.where(warm, 8, q + 1 + ks), 0)
    opens = valid & ~warm & ((cols == order[:, None]) | ((part > 0) & (cols == part * (n[:, None] >> PARTS))))
    before = np.where(opens, 4, 0)
    before[np.arange(frames), order] += 6 + np.where(kind == 3, 9 + 2 * LPC_BITS, 0)
    total = (length + before).sum(1)
    flat = ((x == x[:, :1]) | ~valid).all(1)
    plain = ~flat & (total >= 8 * n)

    heads = []
    for i in range(frames):
        head = b"\xff\xf8\x70\x02" + _frame_number(int(numbers[i])) + struct.pack(">H", n[i] - 1)
        sub = 0 if flat[i] else 2 if plain[i] else (0b100001 << 1) if kind[i] == 3 else (0b001000 | int(order[i])) << 1
        heads.append(head + bytes([_crc8(head), sub]))
    head_size = np.array([len(h) for h in heads])
    body = np.where(flat, 8, np.where(plain, 8 * n, total))
    size = head_size + (body + 7 >> 3) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    buf = np.zeros(at[-1], np.uint8)

    rice = np.flatnonzero(~flat & ~plain)
    if len(rice):
        base = (at[rice] + head_size[rice]) * 8
        bits = np.zeros(at[-1] * 8, np.uint8)
        ends = np.cumsum(length[rice] + before[rice], axis=1)
        start = base[:, None] + ends - length[rice]

        def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
            for j in range(width):
                bits[where + width - 1 - j] = value >> j & 1

        for o in range(2):
            rows = np.flatnonzero(order[rice] > o)
            put(start[rows, o], x[rice[rows], o] & 0xFF, 8)
        first = start[np.arange(len(rice)), order[rice]]
        put(first - 10 - 0, np.full(len(rice), PARTS), 6)
        rows = np.flatnonzero(kind[rice] == 3)
        for c in range(2):
            put(first[rows] - 10 - LPC_BITS * (2 - c), lpc[c][rice[rows]] & 0xFF, LPC_BITS)
        put(first[rows] - 10 - 2 * LPC_BITS - 5, np.full(len(rows), LPC_SHIFT), 5)
        put(first[rows] - 10 - 2 * LPC_BITS - 9, np.full(len(rows), LPC_BITS - 1), 4)
        rows, where = np.nonzero(opens[rice])
        put(start[rows, where] - 4, ks[rice[rows], where], 4)
        coded = valid[rice] & ~warm[rice]
        pos, value, kk = (start + q[rice])[coded], u[rice][coded], ks[rice][coded]
        bits[pos] = 1
        pos += kk
        for j in range(int(kk.max(initial=0))):
            if not (kk > j).all():
                keep = kk > j
                pos, value, kk = pos[keep], value[keep], kk[keep]
            bits[pos - j] = value >> j & 1
        buf = np.packbits(bits)
    for i in np.flatnonzero(flat):
        buf[at[i] + head_size[i]] = x[i, 0] & 0xFF
    for i in np.flatnonzero(plain):
        buf[at[i] + head_size[i] : at[i] + head_size[i] + n[i]] = x[i, : n[i]] & 0xFF
    joined = np.frombuffer(b"".join(heads), np.uint8)
    spread = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(head_size)[:-1]]), head_size) + np.arange(len(joined))
    buf[spread] = joined
    crc = _crc16(buf, at[:-1], size - 2)
    buf[at[1:] - 2], buf[at[1:] - 1] = crc >> 8, crc & 0xFF
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (not empty, a multiple of 4 bytes); byte b is sample b - 128."""
    blocks = [(i, j, p[j : j + BLOCK]) for i, p in enumerate(payloads) for j in range(0, len(p), BLOCK)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for g in range(0, len(blocks), LANES):
        group = blocks[g : g + LANES]
        n = np.array([len(b) for _, _, b in group])
        width = int(n.max())
        raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, _, b in group), np.uint8).reshape(len(group), width)
        for (i, _, _), frame in zip(group, _encode_frames(raw.astype(np.int32) - 128, n, np.array([j // BLOCK for _, j, _ in group])), strict=True):
            frames[i].append(frame)
    out = []
    for p, own in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in own]
        least = min(BLOCK, len(p))
        samples = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", max(16, least), max(16, least)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p) & (1 << 36) - 1).to_bytes(8, "big") + hashlib.md5(samples).digest()
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        points = b"".join(struct.pack(">QQH", j * BLOCK, o, min(BLOCK, len(p) - j * BLOCK)) for j, o in enumerate(offset.tolist()))
        out.append(b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def seek_points(media: bytes) -> tuple[np.ndarray, int, int, bytes]:
    """Seek points (first sample, byte offset in the stream, samples), end of the stream, samples, MD5."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", b""
    while not last:
        kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        last = bool(media[at] & 0x80)
        held = media[at + 4 : at + 4 + size]
        info, points = (held if kind == 0 else info), (held if kind == 3 else points)
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 31 != 7 or packed >> 41 & 7:
        raise ValueError("only one channel of 8-bit samples is read")
    table = np.frombuffer(points, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    table = table[table["sample"] != 2**64 - 1]
    starts = np.stack([table["sample"].astype(np.int64), table["offset"].astype(np.int64) + at, table["n"].astype(np.int64)], axis=1)
    return starts, len(media), packed & (1 << 36) - 1, info[18:34]


def _decode_frames(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Samples of the frames at these places, after their header and frame checks hold."""
    frames = len(at)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    ends = at + size
    stored = pad[ends - 2].astype(np.uint16) << 8 | pad[ends - 1]
    if (pad[at] != 0xFF).any() or (pad[at + 1] != 0xF8).any():
        raise ValueError("a frame doesn't begin with the sync code")
    if (_crc16(buf, at, size - 2) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    lead = pad[at + 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code = pad[at + 2] >> 4
    if not np.isin(code, [6, 7]).all():
        raise ValueError("only frames with a block size of their own are read")
    head = 4 + number + np.where(code == 7, 2, 1)
    n = np.where(code == 7, (pad[at + 4 + number].astype(np.int64) << 8 | pad[at + 5 + number]), pad[at + 4 + number]) + 1
    crc = np.zeros(frames, np.int64)
    for i in range(int(head.max())):
        crc = np.where(i < head, CRC8[crc ^ pad[at + i]], crc)
    if (crc != pad[at + head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    sub = pad[at + head + 1]
    kind = sub >> 1
    body = at + head + 2
    out: list[np.ndarray] = [None] * frames
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(n[i], pad[body[i]], np.uint8).view(np.int8)
    for i in np.flatnonzero(kind == 1):
        out[i] = pad[body[i] : body[i] + n[i]].view(np.int8)
    coded = np.flatnonzero(kind > 1)
    if not len(coded):
        return out
    coded = coded[np.argsort(-n[coded], kind="stable")]
    order = np.where(kind[coded] >= 32, (kind[coded] & 31) + 1, kind[coded] & 7).astype(np.int64)
    wide = pad.astype(np.uint64)
    window = wide[:-4] << np.uint64(32) | wide[1:-3] << np.uint64(24) | wide[2:-2] << np.uint64(16) | wide[3:-1] << np.uint64(8) | wide[4:]
    window = window.astype(np.int64)
    pos, count, top = body[coded] * 8, n[coded], int(order.max())

    def peek(where: np.ndarray, width) -> np.ndarray:
        return window[where >> 3] >> (40 - (where & 7) - width) & ((1 << width) - 1)

    x = np.zeros((int(count[0]), len(coded)), np.int64)
    for j in range(top):
        lanes = np.flatnonzero(order > j)
        raw = peek(pos[lanes], 8)
        x[j, lanes] = raw - (raw >> 7 << 8)
        pos[lanes] += 8
    weights, shift = np.zeros((max(top, 1), len(coded)), np.int64), np.zeros(len(coded), np.int64)
    linear = kind[coded] >= 32
    for lane in np.flatnonzero(~linear):
        weights[: order[lane], lane] = FIXED[int(order[lane])]
    lanes = np.flatnonzero(linear)
    if len(lanes):
        precision = peek(pos[lanes], 4) + 1
        shift[lanes] = peek(pos[lanes] + 4, 5)
        pos[lanes] += 9
        for j in range(top):
            own = order[lanes] > j
            some, bits = lanes[own], precision[own]
            raw = peek(pos[some], bits)
            weights[j, some] = raw - (raw >> (bits - 1) << bits)
            pos[some] += bits
    method, parts = peek(pos, 2), peek(pos + 2, 4)
    pos += 6
    param = np.where(method == 1, 5, 4)
    each = count >> parts
    k, raw_bits = np.zeros(len(coded), np.int64), np.full(len(coded), -1, np.int64)
    next_part = order.copy()
    active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    for i in range(int(count[0])):
        m = int(active[i])
        lanes = slice(0, m) if i >= top else np.flatnonzero(order[:m] <= i)
        opening = next_part[lanes] == i
        if opening.any():
            some = np.arange(len(coded))[lanes][opening]
            k[some] = peek(pos[some], param[some])
            pos[some] += param[some]
            escaped = k[some] == (1 << param[some]) - 1
            raw_bits[some] = np.where(escaped, peek(pos[some], 5), -1)
            pos[some] += np.where(escaped, 5, 0)
            next_part[some] = (i // each[some] + 1) * each[some]
        p, kk = pos[lanes], k[lanes]
        zeros = ZEROS16[peek(p, 16)]
        if (zeros == 16).any():
            more = np.flatnonzero(zeros == 16)
            while len(more):
                step = ZEROS16[peek(p[more] + zeros[more], 16)]
                zeros[more] += step
                more = more[(step == 16) & (zeros[more] < 1 << 24)]
        p = p + zeros + 1
        u = zeros << kk | peek(p, kk)
        r = u >> 1 ^ -(u & 1)
        p += kk
        rb = raw_bits[lanes]
        if (rb >= 0).any():
            own = np.flatnonzero(rb >= 0)
            raw = peek(pos[lanes][own], rb[own])
            r[own] = np.where(rb[own] > 0, raw - (raw >> np.maximum(rb[own] - 1, 0) << rb[own]), 0)
            p[own] = pos[lanes][own] + rb[own]
        pos[lanes] = p
        for_sum = 0
        for j in range(min(top, i)):
            for_sum = for_sum + weights[j, lanes] * x[i - 1 - j, lanes]
        x[i, lanes] = r + (for_sum >> shift[lanes] if top else 0)
    x8 = np.ascontiguousarray(x.T.astype(np.int8))
    for lane, i in enumerate(coded):
        out[i] = x8[lane, : n[i]]
    return out


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its PCM blocks: (first sample, byte offset of the frame, payload bytes)."""
    jobs, out = [], [[] for _ in streams]
    for i, media in enumerate(streams):
        points, end, _, _ = seek_points(media)
        stops = np.append(points[1:, 1], end)
        jobs += [(i, int(s), int(a), int(b)) for (s, a, _), b in zip(points, stops, strict=True)]
    for g in range(0, len(jobs), LANES):
        group = jobs[g : g + LANES]
        size = np.array([b - a for _, _, a, b in group])
        buf = np.frombuffer(b"".join(streams[i][a:b] for i, _, a, b in group), np.uint8)
        for (i, s, a, _), samples in zip(group, _decode_frames(buf, np.concatenate([[0], np.cumsum(size)[:-1]]), size), strict=True):
            out[i].append((s, a, (samples.view(np.uint8) ^ 0x80).tobytes()))
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; frame checks, lengths and MD5 must hold."""
    out = [b"".join(b for _, _, b in blocks) for blocks in decode_blocks(streams)]
    for media, payload in zip(streams, out, strict=True):
        _check(media, payload)
    return out


def _check(media: bytes, payload: bytes) -> None:
    _, _, samples, md5 = seek_points(media)
    if len(payload) != samples or hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5:
        raise ValueError("the samples don't match STREAMINFO")


def read_range(media: bytes, start: int, n: int) -> bytes:
    """Payload bytes start to start + n, from the frames that hold them alone."""
    points, end, _, _ = seek_points(media)
    stops = np.append(points[1:, 1], end)
    some = np.flatnonzero((points[:, 0] < start + n) & (points[:, 0] + points[:, 2] > start))
    if not len(some) or n <= 0:
        return b""
    size = stops[some] - points[some, 1]
    buf = np.frombuffer(b"".join(media[points[i, 1] : stops[i]] for i in some), np.uint8)
    got = _decode_frames(buf, np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    joined = (np.concatenate(got).view(np.uint8) ^ 0x80).tobytes()
    skip = start - int(points[some[0], 0])
    return joined[skip : skip + n]


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def feature(payload: bytes) -> str:
    """Mean, root mean square and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    square = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    return f"mean={int(x.sum(dtype=np.int64)) / len(x):.6f};rms={math.sqrt(square / len(x)):.6f};turns={turns}"


def with_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with n_bytes and media, the FLAC stream of the padded UTF-8 text.

    Null and empty texts give 64 zero bytes. Equal texts give equal streams. Names in ``keep`` must not
    clash with the new ones.
    """

    def make():
        def run(texts):
            made = [padded(t) for t in texts]
            return [n for n, _ in made], encode([p for _, p in made])

        return run

    return map_texts(docs, keep, text, "n_bytes long, media binary", make)


BLOCKS = "blocks array<struct<sample_offset:bigint,byte_offset:bigint,n_samples:int,pcm:binary>>"


def _block_rows(blocks: list[tuple[int, int, bytes]]) -> list[dict]:
    return [{"sample_offset": s, "byte_offset": a, "n_samples": len(b), "pcm": b} for s, a, b in blocks]


def pcm_blocks(streams: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """A row for each block of each stream: ``keep``, sample_offset, byte_offset (of its frame in the
    stream), n_samples and pcm (unsigned 8-bit). A null stream gives no row."""

    def make():
        def run(held):
            got = iter(decode_blocks([m for m in held if m is not None]))
            return ([_block_rows(next(got)) if m is not None else [] for m in held],)

        return run

    return block_rows(map_texts(streams, keep, media, BLOCKS, make), keep)


def block_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each block of rows with blocks."""
    return rows.select(*keep, F.explode("blocks").alias("_b")).select(*keep, "_b.*")


def write_pcm_blocks(streams: DataFrame, key: str, path: str) -> None:
    """PCM blocks as Parquet, ordered by key and sample offset in each file, so that a range of samples
    is found by the files' statistics."""
    pcm_blocks(streams, [key]).sortWithinPartitions(key, "sample_offset").write.parquet(path)


def stored_blocks(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with n_bytes, media_bytes and media_sha256 of each text's FLAC stream, and blocks: the PCM blocks
    decoded from the stream, after its frame checks and its MD5 held, each with its sample offset and the byte
    offset of its frame. Written to the shared folder and read back.

    Null and empty texts give 64 zero bytes. Equal texts give equal streams and blocks."""

    def make():
        def run(texts):
            made = [padded(t) for t in texts]
            media = encode([p for _, p in made])
            blocks = decode_blocks(media)
            for m, b in zip(media, blocks, strict=True):
                _check(m, b"".join(x for _, _, x in b))
            return [n for n, _ in made], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], [_block_rows(b) for b in blocks]

        return run

    return written(map_texts(docs, keep, text, f"n_bytes long, media_bytes long, media_sha256 string, {BLOCKS}", make, 2 << 20), "pcm")


def block_digests(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the figures of op2, from stored blocks in the order of their sample offsets."""

    def make():
        def run(held):
            out = []
            for blocks in held:
                blocks = sorted(blocks, key=lambda b: b["sample_offset"])
                p = b"".join(b["pcm"] for b in blocks)
                if np.any(np.cumsum([0, *(b["n_samples"] for b in blocks)])[:-1] != [b["sample_offset"] for b in blocks]):
                    raise ValueError("blocks don't follow each other")
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), feature(p)))
            return list(zip(*out, strict=True))

        return run

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return map_texts(rows, keep, "blocks", made, make, size=lambda blocks: BLOCK * len(blocks))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored_blocks(docs, ["doc_id"])
    return block_digests(rows, ["doc_id", "n_bytes", "media_bytes", "media_sha256"]).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


QUERIES = {"op2_flac_media": op2_flac_media}
SQL: dict[str, str] = {}
