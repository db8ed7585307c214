"""Media columns as FLAC, read back as PCM blocks with seekable sample offsets.

The encoder writes mono streams of 8 bits in frames of 192 samples: each frame is the
cheapest of a constant, verbatim samples, fixed predictors of order 0 to 2 and a
quantised first-order linear predictor, with one Rice partition.  A SEEKTABLE names the
sample and byte at which every PCM block starts.  The decoder of such streams checks the
marker, the header CRC-8 and frame CRC-16 of every frame and the MD5 of all samples, and
undoes Rice codes and predictors of any order; frames of many streams are handled side
by side in arrays, one step for each sample place.  Streams of other encoders go through
read(), frame by frame: all block sizes, 1 to 8 channels with their decorrelation, 4 to
32 bits, wasted bits, Rice partitions of both methods, escaped partitions, fixed and
linear predictors of any order, with the same checks.

store() makes the media column, pcm() the column of PCM blocks behind it, seek() one
stretch of samples from the nearest seek point, and digest() reads what pcm() made.
features() is the three in one pass.  All of them take a batch in runs of about CHUNK
bytes, whatever its number of rows, and hand on a run before they begin the next.

Bytes are stored as signed samples, byte - 128.  PCM is interleaved little-endian, as in
WAV files: 8 bits and fewer unsigned, more signed.

Defined results
    null text           as the empty text
    empty text          one block of 192 blanks (payloads are padded)
    very long text      its frames are handled in chunks; no prefix is taken
    repeated rows       each gets its row; equal texts, equal values
    empty table         no rows
    a damaged stream    ValueError that names the check that failed
    extra columns       ignored
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 192
RATE = 8000
PAD = 32
#: Samples of a PCM block, at each of which a stream can be entered.
SEEK = 24 * BLOCK
#: Payload bytes that are handled at once; a longer text is a run of its own.
CHUNK = 1 << 19
SHIFT = 6  # of the linear predictor's coefficient
PRECISION = 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
            c &= (1 << bits) - 1
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, begin: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[begin:begin + length] for many ranges, one step for each byte place."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    crc = np.zeros(len(begin), np.uint32)
    active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
    for i, n in enumerate(active):
        c, b = crc[:n], data[begin[:n] + i]
        crc[:n] = table[c ^ b] if bits == 8 else ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    parts = []
    while True:
        parts.append(0x80 | n & 0x3F)
        n >>= 6
        room = 6 - len(parts)
        if n < 1 << room:
            return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(parts)])


def pad(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of the block."""
    return text + bytes([PAD]) * ((-len(text)) % BLOCK if text else BLOCK)


def _predictions(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Residuals of fixed order 0, 1, 2 and of the linear predictor, and its coefficient."""
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    f = x.astype(np.float32)
    r0, r1 = np.einsum("ij,ij->i", f[:, :-1], f[:, :-1]), np.einsum("ij,ij->i", f[:, :-1], f[:, 1:])
    a = np.clip(np.rint(r1 / np.maximum(r0, 1) * (1 << SHIFT)), -127, 127).astype(np.int16)
    lpc = x[:, 1:] - ((a[:, None] * x[:, :-1]) >> SHIFT)
    return [x, d1, d2, lpc], a


def encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of samples (frames x BLOCK, int16)."""
    n = len(samples)
    residuals, coefficient = _predictions(samples)
    orders, extra = (0, 1, 2, 1), (0, 0, 0, 4 + 5 + PRECISION)
    cost, rice = np.empty((n, 4), np.int64), np.empty((n, 4), np.int64)
    for t, r in enumerate(residuals):
        folded = (r << 1) ^ (r >> 15)
        # the parameter near log2 of the mean's ln 2 part, which is where Rice codes are shortest
        mean = folded.sum(1, dtype=np.int32) / folded.shape[1]
        k = np.clip(np.ceil(np.log2(np.maximum(mean * 0.6931, 0.5))), 0, 9).astype(np.int16)
        rice[:, t] = k
        cost[:, t] = (folded >> k[:, None]).sum(1, dtype=np.int32) + (k.astype(np.int64) + 1) * folded.shape[1] + 8 * orders[t] + extra[t] + 10
    kind = cost.argmin(1)
    kind[cost.min(1) >= 8 * BLOCK] = 4
    kind[(samples == samples[:, :1]).all(1)] = 5

    heads = [b"\xff\xf8\x14\x02" + _number(i) for i in numbers]
    lens = np.array([len(h) for h in heads])
    flat = np.frombuffer(b"".join(heads), np.uint8)
    crc8 = _crc(flat, np.cumsum(lens) - lens, lens, CRC8, 8)
    head = [h + bytes([c]) for h, c in zip(heads, crc8.tolist(), strict=True)]

    body_bits = np.where(kind == 5, 16, 8 + 8 * BLOCK)
    pick = kind < 4
    body_bits[pick] = 8 + cost[np.flatnonzero(pick), kind[pick]]
    size = lens + 1 + (body_bits + 7) // 8
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        for j in range(width):
            bits[at + j] = (values >> (width - 1 - j)) & 1
        return at + width

    at = (start + lens + 1) * 8
    for t, order in enumerate(orders):
        rows = np.flatnonzero(kind == t)
        if not len(rows):
            continue
        code = (8 + order if t < 3 else 32) << 1
        p = put(rows, at[rows], np.full(len(rows), code), 8)
        for i in range(order):
            p = put(rows, p, samples[rows, i] & 0xFF, 8)
        if t == 3:
            p = put(rows, p, np.full(len(rows), PRECISION - 1), 4)
            p = put(rows, p, np.full(len(rows), SHIFT), 5)
            p = put(rows, p, coefficient[rows] & 0xFF, PRECISION)
        k = rice[rows, t]
        p = put(rows, p, np.zeros(len(rows), np.int64), 6)
        p = put(rows, p, k, 4)
        r = residuals[t][rows]
        folded = (r << 1) ^ (r >> 15)
        k32 = k.astype(np.int32)[:, None]
        ends = np.cumsum((folded >> k.astype(np.int16)[:, None]).astype(np.int32) + (k32 + 1), axis=1, dtype=np.int32)
        stop = (p.astype(np.int32)[:, None] - k32 - 1) + ends
        bits[stop] = 1
        for width in np.unique(k).tolist():
            own = k == width
            s, low = stop[own].ravel(), folded[own].ravel()
            for j in range(width - 1, -1, -1):
                s += 1
                bits[s] = (low >> j).astype(np.uint8) & 1
    rows = np.flatnonzero(kind == 4)
    if len(rows):
        p = put(rows, at[rows], np.full(len(rows), 2), 8)
        raw = np.unpackbits((samples[rows] & 0xFF).astype(np.uint8), axis=1)
        bits[p[:, None] + np.arange(8 * BLOCK)] = raw
    rows = np.flatnonzero(kind == 5)
    if len(rows):
        put(rows, put(rows, at[rows], np.zeros(len(rows), np.int64), 8), samples[rows, 0] & 0xFF, 8)
    data = np.packbits(bits)
    first = np.repeat(start, lens + 1) + np.arange(int((lens + 1).sum())) - np.repeat(np.cumsum(lens + 1) - lens - 1, lens + 1)
    data[first] = np.frombuffer(b"".join(head), np.uint8)
    crc = _crc(data, start, size, CRC16, 16)
    whole, ends = data.tobytes(), (start + size).tolist()
    return [whole[a:b] + c for a, b, c in zip(start.tolist(), ends, map(struct.Struct(">H").pack, crc.tolist()), strict=True)]


def _stream_head(payload: bytes, sizes: list[int]) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big")
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    step, ends = SEEK // BLOCK, np.cumsum([0, *sizes])
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(ends[i]), BLOCK) for i in range(0, len(sizes), step))
    return b"fLaC\x00\x00\x00\x22" + info + hashlib.md5(signed).digest() + b"\x83" + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """Streams of payloads whose lengths are positive multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    frames: list[bytes] = []
    step = CHUNK // BLOCK
    for i in range(0, len(samples), step):
        frames += encode_frames(samples[i : i + step].astype(np.int16) - 128, numbers[i : i + step].tolist())
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        out.append(_stream_head(p, [len(f) for f in own]) + b"".join(own))
        at += c
    return out


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"FLAC stream: {what}")


def decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples of frames that lie side by side in data[begin:end]."""
    size = end - begin
    crc = _crc(data, begin, size - 2, CRC16, 16)
    _need(bool((crc == (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).all()), "frame CRC-16")
    lead = data[begin + 4]
    more = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    lens = 5 + more
    _need(bool((_crc(data, begin, lens, CRC8, 8) == data[begin + lens]).all()), "header CRC-8")
    _need(bool(((data[begin] == 0xFF) & (data[begin + 1] == 0xF8) & (data[begin + 2] == 0x14) & (data[begin + 3] == 0x02)).all()), "frame header")

    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    word = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]  # 32 bits from each byte

    def take(at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """`width` (up to 25) bits from bit places."""
        w = np.uint32(32) - np.asarray(width, np.uint32)
        got = (word[at >> 3] << (at & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)
        return np.where(w > 31, 0, got >> np.minimum(w, 31)).astype(np.int64)

    at = (begin + lens + 1) * 8
    kind = take(at, 8) >> 1
    at = at + 8
    n = len(begin)
    out = np.zeros((n, BLOCK), np.int32)
    signed = lambda v, bits: np.where(v >> (bits - 1) & 1, v - (1 << bits), v)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    out[constant] = signed(take(at[constant], 8), 8)[:, None]
    if len(verbatim):
        out[verbatim] = data[(at[verbatim] >> 3)[:, None] + np.arange(BLOCK)].astype(np.int8)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    _need(bool((fixed | linear | (kind < 2)).all()), "subframe type")
    rows = np.flatnonzero(fixed | linear)
    if not len(rows):
        return out
    order = np.where(fixed, kind - 8, kind - 31)[rows]
    p, most = at[rows], int(order.max())
    warm = np.zeros((len(rows), most), np.int32)
    for i in range(most):
        own = order > i
        warm[own, i] = signed(take(p[own], 8), 8)
        p[own] += 8
    lin = np.flatnonzero(linear[rows])
    coefficients, shifts = np.zeros((len(rows), most), np.int32), np.zeros(len(rows), np.int32)
    if len(lin):
        precision = take(p[lin], 4) + 1
        shifts[lin] = take(p[lin] + 4, 5)
        p[lin] += 9
        for i in range(int(order[lin].max())):
            own = lin[order[lin] > i]
            bits = precision[order[lin] > i]
            v = take(p[own], bits)
            coefficients[own, i] = np.where(v >> (bits - 1) & 1, v - (1 << bits), v)
            p[own] += bits
    _need(not take(p, 6).any(), "residual coding (one partition of 4-bit Rice codes is read)")
    k = take(p + 6, 4)
    _need(bool((k < 15).all()), "escaped residual")
    p = p + 10
    bits = np.unpackbits(data)
    following = np.arange(len(bits), dtype=np.int32)  # the next 1 at or after each place
    np.copyto(following, len(bits), where=bits == 0)
    np.minimum.accumulate(following[::-1], out=following[::-1])
    # The walk finds where codes begin and where their unary parts stop; values follow in bulk.
    begins, stops = np.zeros((BLOCK, len(rows)), np.int32), np.zeros((BLOCK, len(rows)), np.int32)
    place, step = p.astype(np.int32), (k + 1).astype(np.int32)
    for i in range(BLOCK):
        if i < most:
            own = np.flatnonzero(order <= i)
            begins[i, own] = place[own]
            stops[i, own] = following[place[own]]
            place[own] = stops[i, own] + step[own]
        else:
            begins[i] = place
            np.take(following, place, out=stops[i], mode="clip")
            np.add(stops[i], step, out=place)
    _need(int(place.max()) <= len(bits), "residual ends early")
    low = word[(stops + 1) >> 3] << ((stops + 1) & 7).astype(np.uint32)
    k32 = k.astype(np.uint32)
    low = np.where(k32 > 0, low >> np.minimum(32 - k32, 31), 0).astype(np.int32)
    folded = ((stops - begins) << k.astype(np.int32)) | low
    residual = (folded >> 1) ^ -(folded & 1)
    for i in range(most):
        residual[i, order > i] = 0
    result = residual.T.copy()
    for o in range(5):
        own = np.flatnonzero(fixed[rows] & (order == o))
        if len(own):
            result[own] = _undo_fixed(result[own], warm[own], o)
    if len(lin):
        x = result[lin]
        for i in range(BLOCK):
            lane = order[lin] <= i
            guess = sum(coefficients[lin, j] * x[:, i - 1 - j] for j in range(min(i, most)))
            x[:, i] = np.where(lane, x[:, i] + (guess >> shifts[lin] if i else 0), warm[lin, i] if i < most else 0)
        result[lin] = x
    out[rows] = result
    return out


def _undo_fixed(residual: np.ndarray, warm: np.ndarray, order: int) -> np.ndarray:
    """Sums of sums: the order-th difference is given, and the first of each lower one."""
    out = residual.copy()
    level = [warm[:, :order]]
    for _ in range(order - 1):
        level.append(np.diff(level[-1], axis=1))
    out[:, :order] = 0
    for o in range(order, 0, -1):
        seed = level[o - 1][:, 0]
        out[:, o - 1] = seed
        out[:, o - 1 :] = np.cumsum(out[:, o - 1 :], axis=1)
    return out


def frame_starts(stream: bytes) -> list[int]:
    """Where frames begin, and the end: at each header whose CRC-8 holds."""
    about, starts = info(stream), []
    at, count = about.frames, about.samples // BLOCK
    while len(_HEADS) < count:
        head = b"\xff\xf8\x14\x02" + _number(len(_HEADS))
        c = 0
        for b in head:
            c = int(CRC8[c ^ b])
        _HEADS.append(head + bytes([c]))
    find = stream.find
    for number, head in enumerate(_HEADS[:count]):
        found = find(head, at)
        _need(found >= 0 and (number > 0 or found == at), f"frame {number} is missing")
        starts.append(found)
        at = found + len(head)
    return [*starts, len(stream)]


#: Frame headers by number, as far as any stream needed them (6 to 11 bytes each).
_HEADS: list[bytes] = []


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams that encode() made."""
    marks = []
    for s in streams:
        about, starts = info(s), frame_starts(s)
        _need(about.own, "not of this encoder")
        _need(all(p % BLOCK == 0 and p < about.samples and starts[p // BLOCK] - about.frames == byte for p, byte in about.points), "seek point")
        marks.append(starts)
    out: list[bytes] = []
    i = 0
    pending: list[np.ndarray] = []
    while i < len(streams):
        j, held = i, 0
        while j < len(streams) and (j == i or held + len(streams[j]) <= CHUNK):
            held += len(streams[j])
            j += 1
        data = np.frombuffer(b"".join(streams[i:j]), np.uint8)
        base = np.cumsum([0, *map(len, streams[i:j])])
        begin = np.concatenate([np.array(m[:-1], np.int64) + b for m, b in zip(marks[i:j], base, strict=False)])
        end = np.concatenate([np.array(m[1:], np.int64) + b for m, b in zip(marks[i:j], base, strict=False)])
        step = CHUNK // BLOCK
        for f in range(0, len(begin), step):
            low, high = begin[f], end[min(f + step, len(begin)) - 1]
            pending.append((decode_frames(data[low:high], begin[f : f + step] - low, end[f : f + step] - low) + 128).astype(np.uint8))
        samples = np.concatenate(pending).ravel()
        pending = []
        at = 0
        for s, m in zip(streams[i:j], marks[i:j], strict=True):
            n = (len(m) - 1) * BLOCK
            payload = samples[at : at + n].tobytes()
            _need(hashlib.md5((samples[at : at + n] ^ 0x80).tobytes()).digest() == s[26:42], "MD5 of the samples")
            out.append(payload)
            at += n
        i = j
    return out


@dataclass
class Info:
    """STREAMINFO, seek points (sample, byte after the metadata) and where frames begin."""

    largest: int  # samples of a block
    longest: int  # bytes of a frame, 0 if unknown
    rate: int
    channels: int
    bits: int
    samples: int  # 0 if unknown
    md5: bytes
    points: list[tuple[int, int]]
    frames: int

    @property
    def own(self) -> bool:
        return (self.largest, self.channels, self.bits) == (BLOCK, 1, 8) and self.samples % BLOCK == 0


def info(stream: bytes) -> Info:
    _need(stream[:4] == b"fLaC" and len(stream) >= 42 and stream[4] & 0x7F == 0, "marker or STREAMINFO")
    packed, points, at = int.from_bytes(stream[18:26], "big"), [], 4
    while True:
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 3:
            found = struct.iter_unpack(">QQH", stream[at + 4 : at + 4 + n // 18 * 18])
            points = [(sample, byte) for sample, byte, _ in found if sample < (1 << 64) - 1]
        at += 4 + n
        _need(at <= len(stream), "metadata ends early")
        if last:
            break
    return Info(int.from_bytes(stream[10:12], "big"), int.from_bytes(stream[15:18], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, stream[26:42], points, at)


class EndsEarly(ValueError):
    """The bytes at hand do not hold the whole frame."""


class Bits:
    """Bits of a frame, as a string of 0 and 1, which finds and converts at C speed."""

    def __init__(self, data: bytes):
        self.text, self.at = bin(int.from_bytes(b"\1" + data, "big"))[3:], 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.text):
            raise EndsEarly("FLAC stream: frame ends early")
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        stop = self.text.find("1", self.at)
        if stop < 0:
            raise EndsEarly("FLAC stream: frame ends early")
        n, self.at = stop - self.at, stop + 1
        return n


def _residual(b: Bits, size: int, order: int) -> list[int]:
    method, parts = b.take(2), 1 << b.take(4)
    _need(method < 2 and size % parts == 0 and size // parts >= order, "residual coding")
    width, out = 4 + method, []
    for p in range(parts):
        n, k = size // parts - (order if p == 0 else 0), b.take(width)
        if k == (1 << width) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            v = b.unary() << k | b.take(k)
            out.append(v >> 1 ^ -(v & 1))
    return out


#: Weights of the samples before, nearest first, of the fixed predictors.
FIXED = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]


def _subframe(b: Bits, size: int, bits: int) -> list[int]:
    _need(b.take(1) == 0, "subframe padding")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * size
    elif kind == 1:
        x = [b.signed(bits) for _ in range(size)]
    else:
        fixed = 8 <= kind <= 12
        _need(fixed or kind >= 32, "subframe type")
        order = kind - 8 if fixed else kind - 31
        x = [b.signed(bits) for _ in range(order)]
        weights, shift = FIXED[order] if fixed else (), 0
        if not fixed:
            precision, shift = b.take(4) + 1, b.signed(5)
            _need(precision < 16 and shift >= 0, "predictor")
            weights = [b.signed(precision) for _ in range(order)]
        top = 1 << (bits - 1)
        for r in _residual(b, size, order):
            v = r + (sum(map(mul, weights, x[: -order - 1 : -1])) >> shift if order else 0)
            _need(-top <= v < top, "sample out of range")  # also keeps a damaged stream's feedback from growing
            x.append(v)
    return [v << wasted for v in x] if wasted else x


def _frame(stream: bytes, about: Info, at: int, limit: int) -> tuple[int, np.ndarray, int]:
    """First sample, samples (channels x size) and end of the frame at a byte, of which
    `limit` bytes are looked at."""
    b = Bits(stream[at : at + limit])
    _need(b.take(15) == 0x7FFC, "frame sync")
    varies, size, rate, layout, depth = b.take(1), b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    more = 0 if lead < 0x80 else f"{lead:08b}".index("0") - 1 if lead < 0xFF else 6
    number = lead if not more else lead & (0x3F >> more)
    for _ in range(more):
        number = number << 6 | b.take(8) & 0x3F
    _need(size > 0, "frame header")
    size = 192 if size == 1 else 576 << size - 2 if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << size - 8
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = np.frombuffer(stream[at : at + b.at // 8], np.uint8)
    _need(int(_crc(head, np.zeros(1, np.int64), np.array([len(head)]), CRC8, 8)[0]) == b.take(8), "header CRC-8")
    bits = [about.bits, 8, 12, 0, 16, 20, 24, 32][depth]
    _need(bits > 0 and layout < 11, "frame header")
    channels = layout + 1 if layout < 8 else 2
    x = [np.array(_subframe(b, size, bits + (c == (0 if layout == 9 else 1) and layout > 7)), np.int64) for c in range(channels)]
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[0] + x[1]
    elif layout == 10:
        twice = x[0] * 2 | x[1] & 1
        x = [twice + x[1] >> 1, twice - x[1] >> 1]
    end = at + -(-b.at // 8)
    if end + 2 > min(at + limit, len(stream)):
        raise EndsEarly("FLAC stream: frame ends early")
    whole = np.frombuffer(stream[at:end], np.uint8)
    _need(int(_crc(whole, np.zeros(1, np.int64), np.array([len(whole)]), CRC16, 16)[0]) == int.from_bytes(stream[end : end + 2], "big"), "frame CRC-16")
    return (number if varies else number * about.largest), np.stack(x), end + 2


def read_frames(stream: bytes, about: Info, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """First sample and samples (channels x size) of every frame from a byte on."""
    while at < len(stream):
        limit = about.longest or 2 * about.channels * about.largest * (about.bits + 1) // 8 + 1024
        while True:
            try:
                first, x, end = _frame(stream, about, at, limit)
                break
            except EndsEarly:
                if at + limit >= len(stream):
                    raise
                limit *= 8
        yield first, x
        at = end


def _pcm(samples: np.ndarray, bits: int, unsigned: bool = True) -> bytes:
    """Samples (channels x size) as interleaved little-endian PCM."""
    flat, width = samples.T.ravel(), -(-bits // 8)
    if width == 1 and unsigned:
        flat = flat + 128
    return flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def read(stream: bytes) -> tuple[Info, np.ndarray]:
    """What a stream of any encoder holds: its description and samples (channels x n)."""
    about, found, at = info(stream), [], 0
    for first, x in read_frames(stream, about, about.frames):
        _need(first == at and len(x) == about.channels, "frame order")
        found.append(x)
        at += x.shape[1]
    _need(about.samples in (0, at), "number of samples")
    samples = np.concatenate(found, 1) if found else np.zeros((about.channels, 0), np.int64)
    _need(not any(about.md5) or hashlib.md5(_pcm(samples, about.bits, False)).digest() == about.md5, "MD5 of the samples")
    return about, samples


def seek(stream: bytes, first: int, count: int) -> bytes:
    """PCM of `count` samples from the `first` on: frames are decoded from the seek point
    before it, and no further than needed."""
    about = info(stream)
    at = max((p for p in about.points if p[0] <= first), default=(0, 0))[1]
    parts = []
    for start, x in read_frames(stream, about, about.frames + at):
        if start >= first + count:
            break
        parts.append(x[:, max(0, first - start) : max(0, first + count - start)])
    return _pcm(np.concatenate(parts, 1), about.bits) if parts else b""


def blocks(payload: bytes, size: int = SEEK) -> Iterator[tuple[int, bytes]]:
    """PCM blocks and the sample offsets at which they start."""
    for at in range(0, len(payload), size):
        yield at, payload[at : at + size]


def block_lists(streams: list[bytes], size: int) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks of every stream, of this encoder or another."""
    own = [s for s in streams if info(s).own]
    try:
        payloads = iter(decode(own))
    except ValueError:  # like ours by its description only, or damaged, which read() finds as well
        own, payloads = [], iter(())
    ours, out = set(map(id, own)), []
    for s in streams:
        if id(s) in ours:
            out.append(list(blocks(next(payloads), size)))
        else:
            about, x = read(s)
            out.append([(at, _pcm(x[:, at : at + size], about.bits)) for at in range(0, x.shape[1], size)])
    return out


def feature(payload: bytes) -> str:
    """Facts of the samples read back: count, mean, energy, crossings of the mean."""
    x, v = np.frombuffer(payload, np.uint8), np.arange(256) - 128
    counts = sum(np.bincount(x[i : i + CHUNK], minlength=256) for i in range(0, len(x), CHUNK))
    mean = int(counts @ v) // len(x)
    energy = int(counts @ (v * v)) // len(x)
    crossings = int(np.count_nonzero(np.diff(x > mean + 128)))
    return f"samples={len(x)};mean={mean};energy={energy};crossings={crossings}"


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of every value: of texts and binaries, and of the PCM in lists of blocks."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        sums, ends = np.cumsum([0, *_sizes(column.flatten().field("pcm"))]), np.cumsum(counts)
        return sums[ends] - sums[ends - counts]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about CHUNK bytes; sizes: of its rows."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > CHUNK:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text to doc_id, n_bytes and media."""
    for batch in batches:
        for b in _runs(batch, _sizes(batch.column(1)).tolist()):
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            media = encode([pad(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (FLAC stream) of every text."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_stored, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))


def _pcm_size(head: bytes | None) -> int:
    """Bytes of PCM that a stream says it holds, by its first 26 bytes; 0 if they don't."""
    if head is None or len(head) < 26:
        return 0
    packed = int.from_bytes(head[18:], "big")
    return (packed & (1 << 36) - 1) * ((packed >> 41 & 7) + 1) * -(-((packed >> 36 & 31) + 1) // 8)


def _read_back(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches with the blocks of column `at`, a FLAC stream, as their last column."""
    for batch in batches:
        heads = pc.binary_slice(batch.column(at), 0, 26).to_pylist()
        sizes = [max(n, _pcm_size(h)) for n, h in zip(_sizes(batch.column(at)).tolist(), heads, strict=True)]
        for b in _runs(batch, sizes):
            streams = b.column(at).to_pylist()
            listed = iter(block_lists([s for s in streams if s is not None], size))
            found = [None if s is None else [{"sample_offset": o, "pcm": p} for o, p in next(listed)] for s in streams]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, BLOCKS)], names=[*b.schema.names, "blocks"])


def pcm(media: DataFrame, size: int = SEEK) -> DataFrame:
    """All columns of media (a FLAC stream in `media`) with `blocks`: the PCM blocks of the
    stream with their sample offsets, in order.  A null stream has no blocks."""
    columns = [c for c in media.columns if c != "blocks"]
    at = columns.index("media")
    slim = media.select(*[F.col(f"`{c}`") for c in columns])
    wide = T.StructType([*slim.schema.fields, T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])))])
    return slim.mapInArrow(lambda batches: _read_back(batches, at, size), wide)


def pcm_blocks(media: DataFrame, size: int = SEEK) -> DataFrame:
    """doc_id, sample_offset, pcm of every block: a table to write and seek in."""
    return pcm(media.select("doc_id", "media"), size).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.sample_offset", "b.pcm")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, media and blocks to what digest() returns."""
    for batch in batches:
        for b in _runs(batch, np.maximum(_sizes(batch.column(2)), _sizes(batch.column(3))).tolist()):
            streams, payloads = b.column(2).to_pylist(), []
            for listed in b.column(3).to_pylist():
                at = 0
                for block in listed:
                    _need(block["sample_offset"] == at, "a PCM block is missing")
                    at += len(block["pcm"])
                payloads.append(b"".join(block["pcm"] for block in listed))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    pa.array(map(len, streams), pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                    pa.array(map(feature, payloads), pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(decoded: DataFrame) -> DataFrame:
    """Of what pcm() made: doc_id, n_bytes, payload and media digests, feature.  The blocks
    must follow each other without gaps."""
    slim = decoded.select("doc_id", "n_bytes", "media", "blocks")
    return slim.mapInArrow(_digested, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SEEK) -> DataFrame:
    """digest(pcm(store(docs))) in one pass: a run of texts is stored, read back and digested
    before the next one, so streams and blocks never go through the JVM, and a task has one
    Python worker rather than three."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lambda batches: _digested(_read_back(_stored(batches), 2, size)), f"doc_id {kind}, {DIGEST}")
