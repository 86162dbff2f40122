"""FLAC media columns: 8-bit mono streams written and decoded with numpy, frames side by side.

Frames are independent, so those of many streams go through each step
together: a batch's frames are lanes, step t reads the t-th Rice code of every
lane from its own bit position. Fixed and general linear predictors are undone
by running sums or by the recurrence, CRC-8 of headers and CRC-16 of frames are
counted lane by lane, and the MD5 sum of the samples is held against the
stream's. A seek table has a point for each frame, so PCM blocks carry their
sample offsets and any of them can be decoded alone; streams without such a
table are read frame after frame.

A null text is an empty payload of 64 zero bytes; equal texts give equal
streams; rows with null keys and repeated rows stand for themselves, an empty
table gives no rows, further columns are ignored, and long texts are encoded in
chunks of ``CHUNK`` samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BLOCK, RATE, BITS = 1024, 8000, 8
#: Samples that are encoded or decoded at a time.
CHUNK = 1 << 21
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ poly) & mask if value & top else value << 1 & mask
        out.append(value)
    return np.array(out, dtype=np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


_FROM_END = [CRC16.astype(np.uint16)[None, :]]


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + size] for all lanes: the sum of what each byte gives at its distance from the end."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    longest = int(sizes.max())
    known = _FROM_END[0]
    if len(known) < longest:
        rows = [known[-1].astype(np.int64)]
        for _ in range(longest - len(known)):
            rows.append(CRC16[rows[-1] >> 8] ^ (rows[-1] << 8 & 0xFFFF))
        _FROM_END[0] = known = np.concatenate([known, np.array(rows[1:], dtype=np.uint16)])
    ends = np.repeat((starts + sizes - 1).astype(np.int32), sizes)
    firsts = np.cumsum(sizes) - sizes
    within = np.arange(len(ends), dtype=np.int32)
    place = within + np.repeat((starts - firsts).astype(np.int32), sizes)
    given = known.ravel()[(ends - place << 8) | data[place]]
    return np.bitwise_xor.reduceat(given, firsts).astype(np.int64)


def utf8_number(n: int) -> bytes:
    """The extended UTF-8 coding of frame numbers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([0xFF * limit * 2 & 0xFF | n, *reversed(tail)])


def header(number: int, size: int) -> bytes:
    code = {256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(size, 6 if size <= 256 else 7)
    extra = {6: bytes([size - 1 & 0xFF]), 7: struct.pack(">H", size - 1 & 0xFFFF)}.get(code, b"")
    out = b"\xff\xf8" + bytes([code << 4, 1 << 1]) + utf8_number(number) + extra
    return out + bytes([crc8(out)])


def differences(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of that order along rows, the values before the first counted as zero."""
    for _ in range(order):
        x = np.diff(x, axis=1, prepend=0)
    return x


def encode_frames(samples: np.ndarray, numbers: list[int], lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """Frames of the rows of samples (signed); lpc: coefficients (of 15 bits at most) and shift to predict with instead of fixed orders."""
    rows, n = samples.shape
    x = samples.astype(np.int32)
    if lpc:
        order, (coefs, shift) = np.full(rows, len(lpc[0])), lpc
        predicted = np.zeros_like(x)
        for j, c in enumerate(coefs):
            predicted[:, len(coefs) :] += c * x[:, len(coefs) - 1 - j : n - 1 - j]
        residual = x - (predicted >> shift)
    else:
        trial = [x]
        for _ in range(min(4, n - 1)):
            trial.append(np.diff(trial[-1], axis=1, prepend=0))
        order = np.stack([np.abs(t[:, 4:]).sum(axis=1) for t in trial]).argmin(axis=0)
        residual = np.empty_like(x)
        for o in np.unique(order):
            residual[order == o] = trial[o][order == o]
    folded = (residual << 1) ^ (residual >> 31)
    coded = np.arange(n)[None, :] >= order[:, None]
    mean = (folded * coded).sum(axis=1) / np.maximum(n - order, 1)
    k = np.clip(np.ceil(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int64)
    quotient = np.where(coded, folded >> k[:, None], 0).astype(np.int64)
    widths = np.where(coded, quotient + 1 + k[:, None], 0)
    extra = 4 + 5 + 15 * order if lpc else np.zeros(rows, dtype=np.int64)
    front = 8 + BITS * order + extra + 2 + 4 + 4
    total = front + widths.sum(axis=1)
    kind = np.where(total < 8 + BITS * n, 2, 1)
    kind[(x == x[:, :1]).all(axis=1)] = 0
    sizes = np.choose(kind, [2, 1 + n, (total + 7) // 8])
    heads = [header(i, n) for i in numbers]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    byte = (x & 0xFF).astype(np.uint8)
    for i in np.flatnonzero(kind == 0):
        out[starts[i] : starts[i] + 2] = CONSTANT << 1, byte[i, 0]
    for i in np.flatnonzero(kind == 1):
        out[starts[i]] = VERBATIM << 1
        out[starts[i] + 1 : starts[i] + 1 + n] = byte[i]
    rice = np.flatnonzero(kind == 2)
    if len(rice):
        first = np.concatenate([[0], np.cumsum(sizes[rice])[:-1]]) * 8
        bits = np.zeros(int(sizes[rice].sum()) * 8, dtype=np.uint8)

        def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
            for b in range(width):
                bits[at + b] = value >> (width - 1 - b) & 1

        put(first, ((LPC + order - 1) if lpc else (FIXED + order))[rice] << 1, 8)
        for o in np.unique(order[rice]):
            own = order[rice] == o
            for j in range(o):
                put(first[own] + 8 + BITS * j, byte[rice[own], j].astype(np.int64), BITS)
        if lpc:
            at = first + 8 + BITS * order[rice]
            put(at, np.full(len(rice), 14), 4)
            put(at + 4, np.full(len(rice), shift), 5)
            for j, c in enumerate(coefs):
                put(at + 9 + 15 * j, np.full(len(rice), c & 0x7FFF), 15)
        put(first + front[rice] - 4, k[rice], 4)
        at = np.cumsum(widths[rice], axis=1) - widths[rice] + (first + front[rice])[:, None]
        live, shown = coded[rice], np.broadcast_to(k[rice][:, None], at.shape)
        end, low, param = (at + quotient[rice])[live], folded[rice][live], shown[live]
        bits[end] = 1
        for b in range(int(param.max(initial=0))):
            if (some := param > b).all():
                bits[end + param - b] = low >> b & 1
            else:
                bits[(end + param - b)[some]] = (low >> b & 1)[some]
        packed = np.packbits(bits)
        for i, s in zip(rice.tolist(), (first // 8).tolist(), strict=True):
            out[starts[i] : starts[i] + sizes[i]] = packed[s : s + sizes[i]]
    whole = [h + out[s : s + z].tobytes() for h, s, z in zip(heads, starts.tolist(), sizes.tolist(), strict=True)]
    lengths = np.array([len(w) for w in whole])
    joined = np.frombuffer(b"".join(whole), dtype=np.uint8)
    sums = crc16(joined, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return [w + struct.pack(">H", s) for w, s in zip(whole, sums.tolist(), strict=True)]


def encode_all(payloads: list[bytes], block: int = BLOCK, lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """A stream for each payload: its bytes less 128 are the samples."""
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    whole: list[tuple[int, int]] = []

    def flush() -> None:
        if whole:
            x = np.frombuffer(b"".join(payloads[d][f * block : (f + 1) * block] for d, f in whole), dtype=np.uint8)
            for (d, f), data in zip(whole, encode_frames(x.reshape(-1, block).astype(np.int16) - 128, [f for _, f in whole], lpc), strict=True):
                frames[d][f] = data
            whole.clear()

    rest: dict[int, list[tuple[int, int]]] = {}
    for d, p in enumerate(payloads):
        for f in range(len(p) // block):
            whole.append((d, f))
            if len(whole) * block >= CHUNK:
                flush()
        if len(p) % block:
            rest.setdefault(len(p) % block, []).append((d, len(p) // block))
    flush()
    for size, places in sorted(rest.items()):
        x = np.frombuffer(b"".join(payloads[d][f * block :] for d, f in places), dtype=np.uint8)
        for (d, f), data in zip(places, encode_frames(x.reshape(-1, size).astype(np.int16) - 128, [f for _, f in places], lpc if lpc and size > len(lpc[0]) else None), strict=True):
            frames[d][f] = data
    return [_stream(p, own, block) for p, own in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes], block: int) -> bytes:
    sizes = [len(f) for f in frames]
    samples = np.frombuffer(payload, dtype=np.uint8) ^ 0x80  # the signed sample's byte
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points = np.zeros(len(frames), dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    points["sample"] = np.arange(len(frames)) * block
    points["offset"] = starts
    points["size"] = np.minimum(block, len(payload) - np.arange(len(frames)) * block)
    if points.nbytes < 1 << 24:
        return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x83]) + points.nbytes.to_bytes(3, "big") + points.tobytes() + b"".join(frames)
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(frames)


class Stream:
    """Metadata of a stream: samples, md5, first (place of the first frame), points (offset of each frame) or None."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.data, self.points = 4, False, data, None
        while not last:
            last, kind, size = data[at] >= 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = struct.unpack(">H", body[2:4])[0]
                packed = int.from_bytes(body[10:18], "big")
                self.samples, self.md5 = packed & (1 << 36) - 1, body[18:34]
                if packed >> 36 & 31 != BITS - 1 or packed >> 41 & 7:
                    raise ValueError("only 8-bit mono streams are read")
            elif kind == 3:
                points = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
                if len(points) == -(-self.samples // self.block):
                    self.points = points["offset"].astype(np.int64)
            at += 4 + size
        self.first = at


def _window(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number."""
    out = np.zeros(len(data), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


class Lanes:
    """Bit positions in a buffer, read together."""

    def __init__(self, window: np.ndarray, at: np.ndarray):
        self.window, self.at = window, at

    def peek(self) -> np.ndarray:
        return self.window[self.at >> 3] << (self.at & 7).astype(np.uint64)

    def read(self, width: int) -> np.ndarray:
        value = self.peek() >> np.uint64(64 - width)
        self.at += width
        return value.astype(np.int64)

    def signed(self, width: int) -> np.ndarray:
        value = self.read(width)
        return value - (value >> (width - 1) << width)

    def zeros(self) -> np.ndarray:
        """The length of each lane's run of zeros."""
        found = LEADING[(self.peek() >> np.uint64(48)).view(np.int64)]
        if found.max(initial=0) == 16:
            on = np.flatnonzero(found == 16)
            found[on] += Lanes(self.window, self.at[on] + 16).zeros()
        return found


def rice_codes(window: np.ndarray, at: np.ndarray, k: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts folded values of each lane from its bit position on, as rows of steps, and the positions behind them."""
    order = np.argsort(-counts, kind="stable")
    at, k, left = at[order], k[order], counts[order]
    keep = (63 - k).view(np.uint64)
    steps = int(left[0]) if len(left) else 0
    out = np.zeros((steps, len(at)), dtype=np.int64)
    one, top = np.uint64(1), np.uint64(48)
    for t, n in enumerate(np.searchsorted(-left, -np.arange(steps), "left").tolist()):
        here = at[:n]
        seen = window[here >> 3] << (here & 7).view(np.uint64)
        zeros = LEADING[(seen >> top).view(np.int64)]
        if zeros.max() == 16:
            lanes = Lanes(window, here)
            zeros = lanes.zeros()
            seen = Lanes(window, here + zeros).peek()
            seen = seen << one
        else:
            seen = seen << (zeros.view(np.uint64) + one)
        np.bitwise_or(zeros << k[:n], (seen >> one >> keep[:n]).view(np.int64), out=out[t, :n])
        here += zeros + k[:n] + 1
    values, ends = np.empty_like(out), np.empty_like(at)
    values[:, order], ends[order] = out, at
    return values, ends


#: Leading zeros of 16 bits.
LEADING = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Samples (signed 8-bit), end and number of the frames that start there; checks both sums of each."""
    window, n = _window(data), len(starts)
    sizes, bodies, numbers = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), []
    for i, s in enumerate(starts.tolist()):
        head = data[s : s + 16].tobytes()
        if head[:2] != b"\xff\xf8" or head[3] >> 1 != 1 or head[2] & 15:
            raise ValueError("not a frame of 8-bit mono samples")
        code, first = head[2] >> 4, head[4]
        extra = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
        number = first if not extra else first & (0x7F >> extra)
        for byte in head[5 : 4 + max(extra, 1)]:
            number = number << 6 | byte & 0x3F
        at = 4 + max(extra, 1)
        if code in (6, 7):
            sizes[i] = int.from_bytes(head[at : at + code - 5], "big") + 1
            at += code - 5
        elif code >= 8:
            sizes[i] = 256 << (code - 8)
        else:
            sizes[i] = 192 if code == 1 else 576 << (code - 2)
        if crc8(head[:at]) != head[at]:
            raise ValueError("a frame header's checksum doesn't agree")
        bodies[i] = s + at + 1
        numbers.append(number)
    kinds = data[bodies].astype(np.int64) >> 1
    if (data[bodies] & 0x81).any():
        raise ValueError("reserved bits or wasted bits in a subframe")
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    ends = np.zeros(n, dtype=np.int64)
    orders = np.where(kinds >= LPC, kinds - LPC + 1, kinds - FIXED)
    coded = np.flatnonzero(kinds > VERBATIM)
    if ((kinds[coded] > FIXED + 4) & (kinds[coded] < LPC) | (kinds[coded] < FIXED)).any():
        raise ValueError("unknown subframe type")
    fronts: dict[int, tuple] = {}
    lanes = Lanes(window, (bodies[coded] + 1) * 8)
    for kind in np.unique(kinds[coded]).tolist():
        own = np.flatnonzero(kinds[coded] == kind)
        part = Lanes(window, lanes.at[own])
        warm = np.array([part.signed(BITS) for _ in range(int(orders[coded[own[0]]]))], dtype=np.int64).reshape(-1, len(own))
        shift, coefs = None, []
        if kind >= LPC:
            precision, shift = part.read(4) + 1, part.read(5)
            if (precision != precision[0]).any():
                raise ValueError("frames with predictors of several precisions")
            coefs = [part.signed(int(precision[0])) for _ in range(len(warm))]
        fronts[kind] = (coded[own], warm, shift, coefs)
        lanes.at[own] = part.at
    method, depth = lanes.read(2), lanes.read(4)
    residuals: list[tuple[np.ndarray, np.ndarray]] = []  # lanes of coded, and their folded values in steps
    for m, d in sorted(set(zip(method.tolist(), depth.tolist(), strict=True))):
        some = np.flatnonzero((method == m) & (depth == d))
        part, pieces = Lanes(window, lanes.at[some]), []
        for p in range(1 << d):
            k = part.read(4 + m)
            if (k == (15 if m == 0 else 31)).any():
                raise ValueError("residuals without Rice codes aren't read")
            counts = (sizes[coded[some]] >> d) - (orders[coded[some]] if p == 0 else 0)
            values, part.at = rice_codes(window, part.at, k, counts)
            pieces.append((values, counts))
        lanes.at[some] = part.at
        if d == 0:
            residuals.append((some, pieces[0][0]))
        else:
            joined = np.zeros((int(sum(c for _, c in pieces).max()), len(some)), dtype=np.int64)
            filled = np.zeros(len(some), dtype=np.int64)
            for values, counts in pieces:
                for lane in range(len(some)):
                    joined[filled[lane] : filled[lane] + counts[lane], lane] = values[: counts[lane], lane]
                filled += counts
            residuals.append((some, joined))
    ends[coded] = (lanes.at + 7) // 8 + 2
    column = np.zeros(n, dtype=np.int64)
    source = np.zeros(n, dtype=np.int64)
    signed = []
    for i, (some, values) in enumerate(residuals):
        column[coded[some]], source[coded[some]] = np.arange(len(some)), i
        signed.append(((values >> 1) ^ -(values & 1)).T)
    for kind, (own, warm, shift, coefs) in fronts.items():
        order = len(warm)
        for size, i in sorted(set(zip(sizes[own].tolist(), source[own].tolist(), strict=True))):
            some = np.flatnonzero((sizes[own] == size) & (source[own] == i))
            x = np.empty((len(some), size), dtype=np.int64)
            x[:, :order] = warm[:, some].T
            x[:, order:] = signed[i][column[own[some]], : size - order]
            if kind >= LPC:
                for t in range(order, size):
                    x[:, t] += sum(c[some] * x[:, t - 1 - j] for j, c in enumerate(coefs)) >> shift[some]
            else:
                x[:, :order] = differences(x[:, :order], order)
                for _ in range(order):
                    np.cumsum(x, axis=1, out=x)
            for f, row in zip(own[some].tolist(), x.astype(np.int8), strict=True):
                out[f] = row
    for i in np.flatnonzero(kinds <= VERBATIM).tolist():
        at, size = int(bodies[i]) + 1, int(sizes[i])
        out[i] = np.repeat(data[at : at + 1], size).view(np.int8) if kinds[i] == CONSTANT else data[at : at + size].view(np.int8)
        ends[i] = at + (1 if kinds[i] == CONSTANT else size) + 2
    sums = data[ends - 2].astype(np.int64) << 8 | data[ends - 1]
    if (crc16(data, np.asarray(starts), ends - 2 - starts) != sums).any():
        raise ValueError("a frame's checksum doesn't agree")
    return out, ends, numbers


def _one_by_one(data: np.ndarray, at: int, block: int) -> Iterator[np.ndarray]:
    """Frames from a place on, where nothing tells their sizes: each is read from a piece that grows until the frame's sum agrees."""
    room = 2 * block + 256
    while at < len(data):
        try:
            rows, ends, _ = decode_frames(data[at : at + room], np.zeros(1, dtype=np.int64))
        except (ValueError, IndexError):
            if at + room >= len(data):
                raise
            room *= 2
            continue
        yield rows[0]
        at += int(ends[0])
        room = max(2 * block + 256, room // 2)


def block_at(data: bytes, number: int) -> bytes:
    """One block's samples (signed 8-bit), read from its frame alone by the seek table."""
    s = Stream(data)
    if s.points is None:
        raise ValueError("the stream has no seek table")
    first = s.first + int(s.points[number])
    stop = s.first + int(s.points[number + 1]) if number + 1 < len(s.points) else len(data)
    rows, _, numbers = decode_frames(np.frombuffer(data[first:stop], dtype=np.uint8), np.zeros(1, dtype=np.int64))
    if numbers != [number]:
        raise ValueError("the seek table names another frame")
    return rows[0].tobytes()


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream as bytes (plus 128), checked against its MD5 sum."""
    found = [Stream(s) for s in streams]
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    lot: list[tuple[int, int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if lot:
            buffer, starts, base = [], [], 0
            for d, begin, end in lot:  # runs of a stream's frames
                own = found[d].points
                starts.append(own[begin:end] - own[begin] + base)
                stop = found[d].first + int(own[end]) if end < len(own) else len(streams[d])
                buffer.append(streams[d][found[d].first + int(own[begin]) : stop])
                base += len(buffer[-1])
            rows, _, numbers = decode_frames(np.frombuffer(b"".join(buffer), dtype=np.uint8), np.concatenate(starts))
            at = 0
            for d, begin, end in lot:
                if numbers[at : at + end - begin] != list(range(begin, end)):
                    raise ValueError("frames out of order")
                blocks[d] += rows[at : at + end - begin]
                at += end - begin
            lot.clear()
            held = 0

    for d, s in enumerate(found):
        if s.points is None:
            blocks[d] += _one_by_one(np.frombuffer(streams[d], dtype=np.uint8), s.first, s.block)
            continue
        begin = 0
        while begin < len(s.points):
            end = min(len(s.points), begin + max(1, (CHUNK - held) // s.block))
            lot.append((d, begin, end))
            held += (end - begin) * s.block
            begin = end
            if held >= CHUNK:
                flush()
    flush()
    out = []
    for s, own in zip(found, blocks, strict=True):
        samples = np.concatenate(own) if own else np.zeros(0, dtype=np.int8)
        if len(samples) != s.samples or hashlib.md5(samples.tobytes()).digest() != s.md5:
            raise ValueError("a stream's samples don't agree with its sum")
        out.append(samples.view(np.uint8) ^ 0x80)
    return out


def payload_of(text: bytes) -> bytes:
    return text + bytes(64 - len(text) if not text else -len(text) % 64)


def features(samples: np.ndarray) -> str:
    """Energy, zero crossings and peak of the signed samples."""
    x = samples.astype(np.int64) - 128
    return f"energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def _lots(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    first, lot, held = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        lot.append(value.as_py())
        held += len(lot[-1])
        if held >= size:
            yield first, lot
            first, lot, held = i + 1, [], 0
    if lot:
        yield first, lot


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, payload bytes before padding, and the FLAC stream of each text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lot in _lots(batch, 1, CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lot)), pa.array([len(x) for x in lot], pa.int64()), pa.array(encode_all([payload_of(x) for x in lot]), pa.binary())], names=["k", "n_bytes", "flac"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), text_or_empty(text).cast("binary").alias("t")).mapInArrow(encoded, f"k {kind}, n_bytes long, flac binary").withColumnRenamed("k", key)


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "flac") -> DataFrame:
    """Every block of the streams: key, block, sample_offset, byte_offset (of its frame), pcm (signed 8-bit)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lot in _lots(batch, 1, CHUNK):
                for i, (data, samples) in enumerate(zip(lot, decode_all(lot), strict=True)):
                    stream, signed = Stream(data), (samples ^ 0x80).tobytes()
                    n = -(-len(signed) // stream.block)
                    offsets = (stream.points + stream.first).tolist() if stream.points is not None else [None] * n
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + i] * n)), pa.array(range(n), pa.int64()), pa.array([b * stream.block for b in range(n)], pa.int64()), pa.array(offsets, pa.int64()), pa.array([signed[b * stream.block : (b + 1) * stream.block] for b in range(n)], pa.binary())], names=[key, "block", "sample_offset", "byte_offset", "pcm"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(decoded, f"`{key}` {kind}, block long, sample_offset long, byte_offset long, pcm binary")


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What reading the stored streams back gives: sizes, sums and features of each payload."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, lot in _lots(batch, 2, CHUNK):
                for data, samples in zip(lot, decode_all(lot), strict=True):
                    payload = samples.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, *names])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "n_bytes", "flac").mapInArrow(read, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
