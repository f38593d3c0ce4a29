"""Media columns: lossless 8-bit mono FLAC streams, written and read in numpy.

The writer makes frames of BLOCK samples with a fixed linear predictor of order 0 to 4 and Rice residuals, or verbatim
samples where those are smaller, a seek table and an MD5 of the samples. The reader takes fixed and general linear
predictors, all partition orders and both Rice methods, checks the CRC-8 of each header, the CRC-16 of each frame and
the MD5, and gives PCM blocks with their sample offsets; it can start at any frame through the seek table.

Texts become UTF-8 with zero bytes up to a positive multiple of 64; a byte b is the sample b - 128. Null text counts as
empty (64 zero bytes). Equal texts give equal streams. A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BLOCK, RATE, UNIT = 4096, 8000, 64
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


@lru_cache(maxsize=1)
def _far() -> np.ndarray:
    """By distance from the end and value, what a byte adds to the CRC-16; CRCs are linear."""
    step = np.array(CRC16, np.uint16)
    out = np.empty((BLOCK + 64, 256), np.uint16)
    out[0] = step
    for d in range(1, len(out)):
        out[d] = (out[d - 1] << np.uint16(8)) ^ step[out[d - 1] >> np.uint16(8)]
    return out.ravel()


def crc16(data: bytes) -> int:
    far, c, size = _far(), 0, BLOCK + 64
    for a in range(0, len(data), size):
        x = np.frombuffer(data[a : a + size], np.uint8).astype(np.int64)
        if len(x) == 1:
            c = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ int(x[0])]
            continue
        x[0] ^= c >> 8
        x[1] ^= c & 255
        c = int(np.bitwise_xor.reduce(far[(np.arange(len(x) - 1, -1, -1) << 8) + x]))
    return c


def _coded(n: int) -> bytes:
    """A number in FLAC's longer UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more, out = 1, []
    while n >= 1 << (6 - more + 6 * more):
        more += 1
    for i in range(more):
        out.append(0x80 | ((n >> (6 * i)) & 63))
    return bytes([((0xFF00 >> (more + 1)) & 0xFF) | (n >> (6 * more)), *reversed(out)])


def _bits(value: int, size: int) -> np.ndarray:
    return (value >> np.arange(size - 1, -1, -1)) & 1


def _rice(u: np.ndarray, k: int) -> np.ndarray:
    """The bits of Rice codes: unary quotient, stop bit, k low bits."""
    q = u >> k
    stop = np.cumsum(q + 1 + k) - 1 - k
    out = np.zeros(int(stop[-1]) + 1 + k if len(u) else 0, np.uint8)
    out[stop] = 1
    for j in range(k):
        out[stop + 1 + j] = (u >> (k - 1 - j)) & 1
    return out


def _parameter(u: np.ndarray) -> tuple[int, int]:
    """Bits and Rice parameter of the shortest coding."""
    n, s = len(u), int(u.sum())
    near = max(0, (s // n).bit_length() - 1) if n else 0
    return min((n * (1 + k) + int((u >> k).sum()), k) for k in range(max(0, near - 1), min(14, near + 1) + 1))


def subframe(x: np.ndarray, partitions: int = 0) -> bytes:
    """The shortest of a constant, verbatim samples and fixed predictors; 2**partitions Rice partitions."""
    n = len(x)
    if (x == x[0]).all():
        return bytes([0, int(x[0]) & 255])
    best, r = None, x
    for order in range(min(5, n)):
        if order:
            r = np.diff(r)
        u = (r << 1) ^ (r >> 31)
        if (n >> partitions) > order and (best is None or int(u.sum()) < best[0]):
            best = (int(u.sum()), order, u)
    parts, at = [], 0
    if best is not None:
        _, order, u = best
        parts = [_bits((8 + order) << 1, 8), *(_bits(int(v) & 255, 8) for v in x[:order]), _bits(partitions, 6)]
        for p in range(1 << partitions):
            m = (n >> partitions) - (order if p == 0 else 0)
            k = _parameter(u[at : at + m])[1]
            parts += [_bits(k, 4), _rice(u[at : at + m], k)]
            at += m
    if best is None or sum(map(len, parts)) >= 8 * n + 8:
        return b"\x02" + x.astype(np.int8).tobytes()
    return np.packbits(np.concatenate(parts).astype(np.uint8)).tobytes()


def encode(payload: bytes, block: int = BLOCK, partitions: int = 0) -> bytes:
    """A FLAC stream of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    frames, seek, at = [], [], 0
    for i, a in enumerate(range(0, len(x), block)):
        part = x[a : a + block]
        head = b"\xff\xf8\x70\x02" + _coded(i) + struct.pack(">H", len(part) - 1)
        body = head + bytes([crc8(head)]) + subframe(part, partitions if len(part) % (1 << partitions) == 0 else 0)
        frames.append(body + struct.pack(">H", crc16(body)))
        seek.append(struct.pack(">QQH", a, at, len(part)))
        at += len(frames[-1])
    size = min(block, max(16, len(x)))
    sizes = [len(f) for f in frames] or [0]
    info = struct.pack(">HH", size, size) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    out = [b"fLaC", bytes([0 if len(frames) > 1 else 0x80]), len(info).to_bytes(3, "big"), info]
    if len(frames) > 1:
        table = b"".join(seek)
        out += [b"\x83", len(table).to_bytes(3, "big"), table]
    return b"".join(out + frames)


class Reader:
    """A stream's blocks, in order or from a seek point on."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        self.data, self.seek, at, last = data, [], 4, False
        while not last:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            body, at, last = data[at + 4 : at + 4 + size], at + 4 + size, bool(kind & 0x80)
            if kind & 0x7F == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.bps, self.channels = struct.unpack(">H", body[2:4])[0], ((packed >> 36) & 31) + 1, ((packed >> 41) & 7) + 1
                self.total, self.md5 = packed & ((1 << 36) - 1), body[18:34]
            elif kind & 0x7F == 3:
                self.seek = [x for x in struct.iter_unpack(">QQH", body) if x[0] != 0xFFFFFFFFFFFFFFFF]
        self.first = at
        if self.channels != 1 or self.bps != 8:
            raise ValueError("only 8-bit mono streams are read")

    def blocks(self, sample: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(sample offset, int32 samples) of each frame from the one that holds the given sample on."""
        at, offset = self.first, 0
        for start, place, _ in self.seek:
            if start <= sample:
                at, offset = self.first + place, start
        ends = sorted(self.first + p for _, p, _ in self.seek)
        while offset < self.total:
            x, at = self._frame(at, next((e for e in ends if e > at), len(self.data)))
            if offset + len(x) > sample:
                yield offset, x
            offset += len(x)

    def _frame(self, at: int, limit: int) -> tuple[np.ndarray, int]:
        d = self.data
        if d[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
            raise ValueError("no frame where one should start")
        code, more = d[at + 2] >> 4, 0 if d[at + 4] < 0x80 else 8 - (d[at + 4] ^ 0xFF).bit_length()
        end = at + 4 + max(1, more)
        if code in (6, 7):
            n, end = int.from_bytes(d[end : end + code - 5], "big") + 1, end + code - 5
        else:
            n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
        end += {12: 1, 13: 2, 14: 2}.get(d[at + 2] & 15, 0)
        if crc8(d[at:end]) != d[end]:
            raise ValueError("a frame header's checksum is wrong")
        try:
            x, used = _subframe(d[end + 1 : min(limit, end + 1 + 2 * n + 64)], n)
        except IndexError:
            x, used = _subframe(d[end + 1 :], n)
        stop = end + 1 + used
        if crc16(d[at:stop]) != int.from_bytes(d[stop : stop + 2], "big"):
            raise ValueError("a frame's checksum is wrong")
        return x, stop + 2


def _value(bits: np.ndarray, at: int, size: int) -> int:
    if at + size > len(bits):
        raise IndexError
    return int("".join(map(str, bits[at : at + size].tolist())) or "0", 2)


def _signed(value: int, size: int) -> int:
    return value - (1 << size) if size and value >> (size - 1) else value


def _subframe(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """n samples, and the whole bytes they took."""
    if not data or data[0] & 0x81:
        raise ValueError("a subframe header with wasted bits or none")
    kind = data[0] >> 1
    if kind == 0:
        return np.full(n, _signed(data[1], 8), np.int32), 2
    if kind == 1:
        return np.frombuffer(data[1 : 1 + n], np.int8).astype(np.int32), 1 + n
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if order < 0:
        raise ValueError("a reserved subframe type")
    head = np.frombuffer(data[1 : 1 + order], np.int8).astype(np.int64)
    bits, at, shift, taps = np.unpackbits(np.frombuffer(data, np.uint8)), 8 + 8 * order, 0, FIXED[order] if kind < 32 else ()
    if kind >= 32:
        precision, shift, at = _value(bits, at, 4) + 1, _signed(_value(bits, at + 4, 5), 5), at + 9
        if precision == 16 or shift < 0:
            raise ValueError("a reserved predictor")
        taps = [_signed(_value(bits, at + i * precision, precision), precision) for i in range(order)]
        at += precision * order
    residual, at = _residual(bits, at, n, order)
    if kind < 32:
        x = _fixed(head, residual, order)
    else:
        x = head.tolist()
        for r in residual.tolist():  # a general predictor feeds on its own output
            x.append(r + (sum(c * v for c, v in zip(taps, x[: -order - 1 : -1], strict=True)) >> shift))
    return np.asarray(x, np.int32), (at + 7) // 8


def _fixed(head: np.ndarray, residual: np.ndarray, order: int) -> np.ndarray:
    """Fixed predictors are differences: sums undo them, each from what the first samples' differences start with."""
    starts = [head]
    for _ in range(order - 1):
        starts.append(np.diff(starts[-1]))
    x = residual
    for s in reversed(starts[:order]):
        x = np.concatenate([s[:1], s[:1] + np.cumsum(x)]) if len(s) == 1 else np.concatenate([s, s[-1] + np.cumsum(x[len(s) - 1 :])])
    return x


def _residual(bits: np.ndarray, at: int, n: int, order: int) -> tuple[np.ndarray, int]:
    wide, parts, find, out = 4 + _value(bits, at, 2), _value(bits, at + 2, 4), bits.tobytes().find, []
    if wide > 5:
        raise ValueError("a reserved residual coding")
    at += 6
    for p in range(1 << parts):
        m, k, at = (n >> parts) - (order if p == 0 else 0), _value(bits, at, wide), at + wide
        if k == (1 << wide) - 1:
            size, at = _value(bits, at, 5), at + 5
            out.append(np.array([_signed(_value(bits, at + i * size, size), size) for i in range(m)], np.int64))
            at += m * size
            continue
        begin, stops, step = at, [], 1 + k
        for _ in range(m):
            s = find(1, at)
            if s < 0:
                raise IndexError
            stops.append(s)
            at = s + step
        if at > len(bits):
            raise IndexError
        stop = np.array(stops, np.int64)
        u = stop - np.concatenate([[begin], stop[:-1] + step])[:m]
        for j in range(k):
            u = (u << 1) | bits[stop + 1 + j]
        out.append((u >> 1) ^ -(u & 1))
    return np.concatenate(out), at


def decode(data: bytes) -> bytes:
    """The payload of a whole stream; the MD5 is checked."""
    reader = Reader(data)
    x = np.concatenate([b for _, b in reader.blocks()] or [np.zeros(0, np.int32)])
    if len(x) != reader.total or hashlib.md5(x.astype(np.int8).tobytes()).digest() != reader.md5:
        raise ValueError("the samples' MD5 is wrong")
    return (x + 128).astype(np.uint8).tobytes()


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def feature(payload: bytes) -> str:
    """Whole-number features of the samples: sum, energy, zero crossings, peak and mean step."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())};steps={int(np.abs(np.diff(x)).sum())}"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored form, a FLAC stream, of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, t in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
            yield k, len(t), encode(payload_of(t))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(_bounded(schema, each), "doc_id long, n_bytes long, media binary")


def _bounded(schema: pa.Schema, each):
    """Batches of few rows, as each row may hold a whole stream."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                yield from common.batches(schema, each(batch), 256)

    return run


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (signed 8-bit) for each block of each stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for offset, x in Reader(m).blocks():
                yield k, offset, len(x), x.astype(np.int8).tobytes()

    return media.select("doc_id", "media").mapInArrow(_bounded(schema, each), "doc_id long, sample_offset long, n_samples int, pcm binary")


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the stored streams, as digests; see the module for the columns' meaning."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p = decode(m)
            yield k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(common.by_rows(schema, each), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
