"""Media columns: FLAC streams of 8-bit samples, written and read in blocks of 576 samples.

The codec works on many frames at once. Decoding unpacks the bits, finds every position's next set bit, and
steps all frames side by side through their Rice codes and their linear prediction; a frame's CRC-8 (header)
and CRC-16 (whole frame), and a stream's MD5, are verified. A seek table with a point for each frame gives the
byte offset of any sample, so blocks can be read alone; streams without one, or with one too short for a point a frame, are followed frame by frame.

Encoding tries fixed predictors of order 0 to 2 and a second-order quantised linear predictor, with a
Rice parameter for each frame, and stores a frame as it is if that is smaller. Any subframe kind may be read:
constant, verbatim, fixed 0-4, linear 1-32, one Rice partition or many.

Distribution: a narrow map over Arrow batches, in pieces of bounded bytes. Defined results: a null text is an
empty one, whose payload is one block of 255s. Equal texts give equal streams. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

BLOCK = 576
RATE = 8000
PAD = 255
AT_ONCE = 2 << 20
FRAMES_AT_ONCE = 4096
#: Coefficients of the fixed predictors (fixed values of the format).
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
MOST_RICE = 14
#: Seek points that fit the length field of a metadata block; longer streams get every second, third, ... frame.
MOST_POINTS = (2**24 - 1) // 18


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_many(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of ``data``, stepped side by side, longest first."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    c = np.zeros(len(s), np.int64)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for t, m in enumerate(live):
        c[:m] = ((c[:m] << 8) & 0xFFFF) ^ _CRC16[(c[:m] >> 8) ^ data[s[:m] + t]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(maxsize=4096)
def frame_header(number: int) -> bytes:
    """Fixed block size 576, rate from the stream's header, mono, 8 bits."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = 2
        while number >= 1 << (5 * n + 1):
            n += 1
        lead = (0xFF << (8 - n)) & 0xFF
        coded = bytes([lead | number >> (6 * (n - 1))] + [0x80 | (number >> (6 * k)) & 0x3F for k in range(n - 2, -1, -1)])
    head = bytes([0xFF, 0xF8, 0x20, 0x02]) + coded
    return head + bytes([crc8(head)])


# --- encoding -----------------------------------------------------------------------------


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predict(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised second-order linear predictor of each row: coefficients (F, 2), residuals."""
    f = s.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, 2:], f[:, 2 - k : BLOCK - k]).astype(np.float64) for k in range(3))
    e0 = np.einsum("ij,ij->i", f, f).astype(np.float64) + 1
    den = e0 * e0 - r1 * r1 + 1
    a = np.stack([(r1 * e0 - r1 * r2) / den, (r2 * e0 - r1 * r1) / den], 1)
    q = np.clip(np.rint(a * 64), -127, 127).astype(np.int32)
    guess = (q[:, :1] * s[:, 1:-1] + q[:, 1:] * s[:, :-2]) >> 6
    return q, s[:, 2:] - guess, r0


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the rows (F, 576) of int32 samples; their bytes one after another and their lengths."""
    count = len(samples)
    res = [samples]
    for _ in range(2):
        res.append(np.diff(res[-1], axis=1))
    q, lin, _ = _predict(samples)
    # candidates: fixed 0, 1, 2 (kinds 0-2) and linear (kind 3); side bits beside the codes
    codes = [_zigzag(r) for r in (*res, lin)]
    extra = np.array([0, 8, 16, 16 + 4 + 5 + 16])
    best_bits = np.full(count, 8 * BLOCK, np.int64)
    kind = np.full(count, 4, np.int64)  # 4: as it is
    rice = np.zeros(count, np.int64)
    for j, u in enumerate(codes):
        mean = u.mean(axis=1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, MOST_RICE).astype(np.int64)
        bits = (u >> k[:, None]).sum(axis=1) + u.shape[1] * (1 + k) + 10 + extra[j]
        better = bits < best_bits
        best_bits[better], kind[better], rice[better] = bits[better], j, k[better]
    heads = [frame_header(int(n)) for n in numbers]
    head_len = np.array([len(h) for h in heads])
    total = (8 * head_len + 8 + best_bits + 7) // 8 + 2
    start = np.cumsum(total) - total
    bits = np.zeros(8 * int(total.sum()), np.uint8)
    body = 8 * (start + head_len) + 8

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    put(body - 8, np.array([0x10, 0x12, 0x14, 0x42, 0x02])[kind], 8)
    for j in range(5):
        rows = np.flatnonzero(kind == j)
        if not len(rows):
            continue
        if j == 4:
            raw = np.unpackbits((samples[rows] & 0xFF).astype(np.uint8), axis=1)
            bits[body[rows][:, None] + np.arange(8 * BLOCK)] = raw
            continue
        warm = min(j, 2)
        at = body[rows]
        for w in range(warm):
            put(at + 8 * w, samples[rows, w] & 0xFF, 8)
        at = at + 8 * warm
        if j == 3:
            put(at, np.full(len(rows), 7), 4)  # coefficients of 8 bits
            put(at + 4, np.full(len(rows), 6), 5)  # shift
            put(at + 9, q[rows, 0] & 0xFF, 8)
            put(at + 17, q[rows, 1] & 0xFF, 8)
            at = at + 25
        k = rice[rows]
        put(at + 6, k, 4)  # method 0 and partition order 0 are six zero bits
        u = codes[j][rows]
        high = u >> k[:, None]
        width = high + 1 + k[:, None]
        stop = np.cumsum(width, axis=1) - width + (at + 10)[:, None] + high
        bits[stop.ravel()] = 1
        for value in np.unique(k):
            mine = k == value
            s, v = stop[mine].ravel(), u[mine].ravel()
            for b in range(int(value)):
                bits[s + 1 + b] = (v >> (int(value) - 1 - b)) & 1
    out = np.packbits(bits)
    for i, h in enumerate(heads):
        out[start[i] : start[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_many(out, start, total - 2)
    out[start + total - 2], out[start + total - 1] = crc >> 8, crc & 0xFF
    return out.tobytes(), total


def flac_stream(payload: bytes, frames: bytes, lengths: np.ndarray) -> bytes:
    """Stream header, seek table and frames."""
    n = len(payload)
    pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()  # signed 8-bit samples
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    every = -(-len(lengths) // MOST_POINTS)
    points = np.zeros(-(-len(lengths) // every), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
    points["sample"] = np.arange(len(points)) * BLOCK * every
    points["offset"] = (np.cumsum(lengths) - lengths)[::every]
    points["size"] = BLOCK
    seek = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; lengths are multiples of the block."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    per = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(per) - per
    numbers = np.arange(len(samples)) - np.repeat(first, per)
    parts = [encode_frames(samples[i : i + FRAMES_AT_ONCE].astype(np.int32) - 128, numbers[i : i + FRAMES_AT_ONCE]) for i in range(0, len(samples), FRAMES_AT_ONCE)]
    data, lengths = b"".join(d for d, _ in parts), np.concatenate([n for _, n in parts])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return [flac_stream(p, data[ends[a] : ends[a + n]], lengths[a : a + n]) for p, a, n in zip(payloads, first, per, strict=True)]


# --- decoding -----------------------------------------------------------------------------


class FlacError(ValueError):
    pass


class Stream(NamedTuple):
    samples: int
    md5: bytes
    first: int  # byte offset of the first frame
    points: np.ndarray | None  # byte offsets of all frames, if the seek table has them


def parse_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info, points = 4, False, None, None
    while not last:
        last, kind, size = data[at] >> 7 == 1, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 36) & 0x1F != 7 or (packed >> 41) & 7:
                raise FlacError("only mono streams of 8-bit samples")
            info = (packed & ((1 << 36) - 1), body[18:34], int.from_bytes(body[:2], "big"))
        elif kind == 3:
            table_ = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
            points = table_[table_["sample"] != 2**64 - 1]
        at += 4 + size
    if info is None or info[2] != BLOCK:
        raise FlacError("block size is not 576")
    frames = -(-info[0] // BLOCK)
    whole = points is not None and len(points) == frames and (points["sample"] == np.arange(frames) * BLOCK).all()
    return Stream(info[0], info[1], at, at + points["offset"].astype(np.int64) if whole else None)


class _Bits:
    """Bit access for many positions at once."""

    def __init__(self, data: np.ndarray):
        self.data = data
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.word = (wide[:-4] << 32) | (wide[1:-3] << 24) | (wide[2:-2] << 16) | (wide[3:-1] << 8) | wide[4:]
        at = np.arange(8 * len(data), dtype=np.int32)
        ones = np.where(np.unpackbits(data), at, np.int32(8 * len(data)))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1]

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Up to 32 bits at each position."""
        return (self.word[at >> 3] >> (40 - (at & 7) - width)) & ((1 << np.asarray(width, np.int64)) - 1)


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (F, 576), frame numbers and byte lengths of the frames that begin at ``start``."""
    if len(start) and not ((data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] >> 4 == 2) & (data[start + 3] == 2)).all():
        raise FlacError("unexpected frame header")
    lead = data[start + 4].astype(np.int64)
    coded = np.where(lead < 0x80, 1, 0)
    for n in range(2, 7):
        coded = np.where(lead >> (7 - n) == (1 << (n + 1)) - 2, n, coded)
    if (coded == 0).any():
        raise FlacError("bad frame number")
    numbers = np.where(coded == 1, lead, lead & ((1 << np.maximum(7 - coded, 0)) - 1))
    for n in range(1, int(coded.max()) if len(coded) else 0):
        numbers = np.where(coded > n, numbers << 6 | (data[np.minimum(start + 4 + n, len(data) - 1)] & 0x3F), numbers)
    head = 4 + coded
    c = np.zeros(len(start), np.int64)
    for t in range(int(head.max()) if len(head) else 0):
        on = t < head
        c = np.where(on, _CRC8[c ^ data[np.minimum(start + t, len(data) - 1)]], c)
    if (c != data[start + head]).any():
        raise FlacError("frame header checksum")
    bits = _Bits(data)
    at = 8 * (start + head + 1)
    kind = bits.take(at, 8) >> 1
    if (bits.take(at, 8) & 0x81).any():
        raise FlacError("wasted bits are not supported")
    at = at + 8
    out = np.zeros((len(start), BLOCK), np.int16)
    end = np.zeros(len(start), np.int64)
    for value in np.unique(kind):
        rows = np.flatnonzero(kind == value)
        if value == 0:
            out[rows] = _signed(bits.take(at[rows], 8), 8)[:, None]
            end[rows] = at[rows] + 8
        elif value == 1:
            out[rows] = _signed(data_bytes(bits, at[rows]), 8)
            end[rows] = at[rows] + 8 * BLOCK
        elif 8 <= value <= 12 or value >= 32:
            out[rows], end[rows] = _predicted(bits, at[rows], int(value))
        else:
            raise FlacError("reserved subframe")
    size = (end + 7) // 8 - start
    want = data[start + size].astype(np.int64) << 8 | data[start + size + 1]
    if (crc16_many(data, start, size) != want).any():
        raise FlacError("frame checksum")
    return out, numbers, size + 2


def _signed(v: np.ndarray, width) -> np.ndarray:
    return v - ((v >> (width - 1)) << width)


def data_bytes(bits: _Bits, at: np.ndarray) -> np.ndarray:
    return bits.data[(at >> 3)[:, None] + np.arange(BLOCK)].astype(np.int64)


def _predicted(bits: _Bits, at: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed and linear subframes of one kind, stepped side by side."""
    n = len(at)
    order = kind - 8 if kind < 32 else kind - 31
    s = np.zeros((BLOCK, n), np.int64)
    for i in range(order):
        s[i] = _signed(bits.take(at, 8), 8)
        at = at + 8
    if kind < 32:
        coef, shift = np.repeat(np.array(FIXED[order], np.int64)[:, None], n, 1), np.zeros(n, np.int64)
    else:
        width = bits.take(at, 4) + 1
        shift = bits.take(at + 4, 5)
        at = at + 9
        coef = np.empty((order, n), np.int64)
        for i in range(order):
            coef[i] = _signed(bits.take(at, width), width)
            at = at + width
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    at = at + 6
    wide = 4 + method
    each = BLOCK >> parts
    escape = (1 << wide) - 1
    k, raw = np.zeros(n, np.int64), np.zeros(n, np.int64)
    plain = not parts.any()
    for i in range(order, BLOCK):
        if i == order or not plain:
            opens = np.full(n, True) if i == order else i % each == 0
            if opens.any():
                p = bits.take(at, wide)
                k = np.where(opens, p, k)
                at = np.where(opens, at + wide, at)
                esc = opens & (p == escape)
                raw = np.where(opens, 0, raw)
                if esc.any():
                    raw = np.where(esc, bits.take(at, 5) + 32, raw)  # 32 and more: unencoded, of so many bits less 32
                    at = np.where(esc, at + 5, at)
                unencoded = (raw > 0).any()
        one = bits.next_one[at]
        low = bits.take(one + 1, k)
        u = ((one - at) << k) | low
        r = (u >> 1) ^ -(u & 1)
        nxt = one + 1 + k
        if unencoded:
            b = np.maximum(raw - 32, 0)
            v = bits.take(at, b)
            r = np.where(raw > 0, np.where(b > 0, _signed(v, np.maximum(b, 1)), 0), r)
            nxt = np.where(raw > 0, at + b, nxt)
        at = nxt.astype(np.int64)
        if order:
            guess = coef[0] * s[i - 1]
            for j in range(1, order):
                guess += coef[j] * s[i - 1 - j]
            r = r + (guess >> shift)
        s[i] = r
    return s.T, at


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payload bytes of each stream, all checksums verified."""
    heads = [parse_stream(d) for d in streams]
    data = np.frombuffer(b"".join([*streams, bytes(8)]), np.uint8)
    base = np.cumsum([0] + [len(d) for d in streams])[:-1]
    out: list[bytes | None] = [None] * len(streams)
    seek = [i for i, h in enumerate(heads) if h.points is not None]
    if seek:
        per = [len(heads[i].points) for i in seek]
        start = np.concatenate([base[i] + heads[i].points for i in seek])
        parts = []
        for a in range(0, len(start), FRAMES_AT_ONCE):
            mine = start[a : a + FRAMES_AT_ONCE]
            high = start[a + FRAMES_AT_ONCE] if a + FRAMES_AT_ONCE < len(start) else len(data)
            s, n, _ = decode_frames(data[mine[0] : high], mine - mine[0])
            parts.append((s.astype(np.int8), n))
        samples, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum([0, *per])
        for i, a, b in zip(seek, ends[:-1], ends[1:], strict=True):
            if (numbers[a:b] != np.arange(b - a)).any():
                raise FlacError("frames out of order")
            out[i] = _checked(samples[a:b].reshape(-1), heads[i])
    for i, h in enumerate(heads):
        if out[i] is None:
            raw, at, parts = np.frombuffer(streams[i] + bytes(8), np.uint8), h.first, []
            while at < len(streams[i]):
                s, _, size = decode_frames(raw, np.array([at]))
                parts.append(s[0].astype(np.int8))
                at += int(size[0])
            out[i] = _checked(np.concatenate(parts) if parts else np.empty(0, np.int8), h)
    return out


def _checked(samples: np.ndarray, head: Stream) -> bytes:
    pcm = samples[: head.samples].tobytes()
    if hashlib.md5(pcm).digest() != head.md5:
        raise FlacError("stream checksum")
    return (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()


def read_blocks(stream: bytes, sample: int, count: int) -> bytes:
    """The payload bytes from ``sample`` on, decoding only the frames that hold them."""
    head = parse_stream(stream)
    if head.points is None:
        return decode_streams([stream])[0][sample : sample + count]
    a, b = sample // BLOCK, min(len(head.points), -(-(sample + count) // BLOCK))
    low, high = int(head.points[a]), int(head.points[b]) if b < len(head.points) else len(stream)
    s, _, _ = decode_frames(np.frombuffer(stream[low:high] + bytes(8), np.uint8), head.points[a:b] - low)
    flat = (s.reshape(-1) + 128).astype(np.uint8).tobytes()
    return flat[sample - a * BLOCK :][:count]


# --- columns ------------------------------------------------------------------------------


def _measured(pcm: np.ndarray, before: int) -> tuple[int, int, int]:
    """Energy, sign changes and peak of samples after one of sign ``before`` (1: negative)."""
    s = pcm.astype(np.int64) - 128
    below = np.concatenate([[before], s < 0])
    return int((s * s).sum()), int((below[1:] != below[:-1]).sum()), int(np.abs(s).max())


def features(payloads: list[bytes]) -> list[str]:
    """Energy, sign changes and peak of the samples of each payload, a long one piece by piece."""
    out = []
    for p in payloads:
        raw, energy, crossings, peak = np.frombuffer(p, np.uint8), 0, 0, 0
        for a in range(0, len(raw), AT_ONCE):
            e, c, high = _measured(raw[a : a + AT_ONCE], int(raw[max(a - 1, 0)] < 128))
            energy, crossings, peak = energy + e, crossings + c, max(peak, high)
        out.append(f"energy={energy};crossings={crossings};peak={peak}")
    return out


def _frames(stream: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of decoded frames: the first one's number, byte offsets, PCM."""
    head = parse_stream(stream)
    raw, number = np.frombuffer(stream + bytes(8), np.uint8), 0
    if head.points is not None:
        for a in range(0, len(head.points), FRAMES_AT_ONCE):
            mine = head.points[a : a + FRAMES_AT_ONCE]
            high = int(head.points[a + FRAMES_AT_ONCE]) + 8 if a + FRAMES_AT_ONCE < len(head.points) else len(raw)
            s, _, _ = decode_frames(raw[int(mine[0]) : high], mine - mine[0])
            yield a, mine, s.astype(np.int8)
        return
    at = head.first
    while at < len(stream):
        s, _, size = decode_frames(raw[at:], np.array([0]))
        yield number, np.array([at]), s.astype(np.int8)
        at, number = at + int(size[0]), number + 1


def pcm_blocks(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """doc_id, sample, offset, pcm: each block of each FLAC stream as signed 8-bit PCM, with its first sample and its frame's byte offset.

    Every frame's checksums are verified. Blocks leave in batches of bounded size, so a long stream needs no more than itself.
    A null stream has no blocks.
    """
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if not batch.column(1)[row].is_valid:
                    continue
                for first, offsets, pcm in _frames(batch.column(1)[row].as_py()):
                    ids = batch.column(0).take(pa.array([row] * len(pcm)))
                    samples = (first + np.arange(len(pcm))) * BLOCK
                    blocks = pa.array([x.tobytes() for x in pcm], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(samples), pa.array(offsets.astype(np.int64)), blocks], ["doc_id", "sample", "offset", "pcm"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, f"doc_id {kind}, sample long, offset long, pcm binary")


SCHEMA = "n_bytes long, payload binary, media binary, feature string"


def media_column(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload as read back from the stored stream, media (the stream), feature."""
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, start = batch.column(0), batch.column(1), 0
            while start < batch.num_rows:
                raw, size, row = [], 0, start
                while row < batch.num_rows and size < AT_ONCE:
                    raw.append((texts[row].as_py() or "").encode())
                    size += len(raw[-1]) + BLOCK
                    row += 1
                media = encode_payloads([padded(x) for x in raw])
                back = decode_streams(media)
                cols = [ids.slice(start, row - start), pa.array([len(x) for x in raw], pa.int64()), pa.array(back, pa.binary()), pa.array(media, pa.binary()), pa.array(features(back))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload", "media", "feature"])
                start = row

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, " + SCHEMA)


def op8_media_column(spark, sf_dir: str) -> DataFrame:
    m = media_column(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op8_media_column": op8_media_column}
ORACLES: dict[str, str] = {}
