"""QR symbols in images: pixels of PNG files, finder patterns, modules, error correction, texts.

Numpy helpers that run on one image inside the attachment reader's Arrow pass.
An image is measured from its header before anything is unpacked, and rows are
unpacked in strips, so memory stays near one byte a pixel. A bad image gives a
reason and never raises.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import qr_layout as Q

MAX_PIXELS, MAX_SYMBOLS, MAX_CHARS = 36_000_000, 10, 4096
#: Rows that are unpacked, and pixels that are searched, at a time.
STRIP, SEARCHED = 128, 1 << 21
#: Cells of crossings and finder patterns that are combined, those with most crossings, and combinations that are tried, those that look most like a symbol.
CELLS, FINDERS, TRIED = 400, 48, 200


# pixels


def measured(data: bytes) -> tuple[int, int] | None:
    """Width and height as a PNG, GIF or JPEG header states them, None where there is none."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data.startswith(b"GIF8") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data.startswith(b"\xff\xd8\xff"):
        return _jpeg_size(data)
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """The frame header behind any other segments."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # a filling byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no length behind these
            at += 2
        elif kind in (0xD9, 0xDA):
            return None
        else:
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                if at + 9 > len(data):
                    return None
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def _by_left(how: int, line: bytes, above: bytes) -> bytearray:
    """One channel of a row whose values need their left neighbour by more than a sum: averages (3), the likeliest neighbour (4)."""
    out, left, corner = bytearray(), 0, 0
    add = out.append
    if how == 3:
        for v, up in zip(line, above, strict=True):
            left = v + (left + up >> 1) & 255
            add(left)
        return out
    for v, up in zip(line, above, strict=True):
        if up != corner:
            if left == corner:
                left = up
            else:
                a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                if a > b or a > c:
                    left = up if b <= c else corner
            corner = up
        left = left + v & 255
        add(left)
    return out


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows (rows, pixels, bytes) with their filters undone; above: the row before."""
    rows, _, size = lines.shape
    out = np.empty_like(lines)
    for y, how in enumerate(kinds.tolist()):
        line, before = lines[y], out[y - 1] if y else above
        if how < 3:
            out[y] = line.cumsum(axis=0, dtype=np.uint8) if how == 1 else line + before if how == 2 else line
            continue
        for c in range(size):
            out[y, :, c] = np.frombuffer(_by_left(how, line[:, c].tobytes(), before[:, c].tobytes()), dtype=np.uint8)
    return out


def grey(data: bytes) -> np.ndarray | None:
    """Brightness (rows, columns) of a PNG on white; None for what isn't read here (interlaced files, broken ones)."""
    chunks: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        chunks[name] = chunks.get(name, b"") + body
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][:13])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if interlaced or channels is None or depth not in (1, 2, 4, 8, 16) or (depth < 8 and channels > 1):
        return None
    pixel, line = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    machine, packed, held = zlib.decompressobj(), chunks.get(b"IDAT", b""), bytearray()
    out, above = np.empty((height, width), dtype=np.uint8), np.zeros((line // pixel, pixel), dtype=np.uint8)
    for y in range(0, height, STRIP):
        rows = min(STRIP, height - y)
        held += machine.decompress(packed, rows * (line + 1) - len(held))
        packed = machine.unconsumed_tail
        if len(held) < rows * (line + 1):
            return None
        raw = np.frombuffer(bytes(held), dtype=np.uint8).reshape(rows, line + 1)
        held = bytearray()
        if raw[:, 0].max() > 4:
            return None
        plain = _unfiltered(raw[:, 0], raw[:, 1:].reshape(rows, line // pixel, pixel), above)
        above = plain[-1]
        flat = plain.reshape(rows, line)
        if depth < 8:
            bits = np.unpackbits(flat, axis=1).reshape(rows, -1, depth)
            samples = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, :width, None]
            samples = samples if kind == 3 else samples * (255 // ((1 << depth) - 1))
        else:
            samples = flat.reshape(rows, width, channels, depth // 8)[..., 0]
        out[y : y + rows] = _bright(samples, kind, chunks)
    return out


def _bright(samples: np.ndarray, kind: int, chunks: dict[bytes, bytes]) -> np.ndarray:
    if kind == 3:
        colours = np.frombuffer(chunks[b"PLTE"], dtype=np.uint8).reshape(-1, 3) @ np.array([299, 587, 114]) // 1000
        clear = np.full(len(colours), 255)
        told = np.frombuffer(chunks.get(b"tRNS", b""), dtype=np.uint8)[: len(colours)]
        clear[: len(told)] = told
        return (255 - (255 - colours) * clear // 255)[np.minimum(samples[..., 0], len(colours) - 1)]
    light = samples[..., :3].astype(np.int32) @ np.array([299, 587, 114]) // 1000 if kind in (2, 6) else samples[..., 0].astype(np.int32)
    return 255 - (255 - light) * samples[..., -1] // 255 if kind in (4, 6) else light


def threshold(light: np.ndarray) -> int:
    """The brightness that parts dark from light best: the greatest variance between both."""
    counts = np.bincount(light.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (total[-1] * below - total * below[-1]) ** 2 / (below * (below[-1] - below))
    best = np.nan_to_num(apart, nan=-1, posinf=-1)
    return int(np.flatnonzero(best == best.max()).mean())


# symbols


def _crossings(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, module size) of runs dark, light, dark, light, dark of 1:1:3:1:1 along rows."""
    found = [(np.zeros(0),) * 3]
    step = max(1, SEARCHED // max(dark.shape[1], 1))
    for top in range(0, len(dark), step):
        flat = np.pad(dark[top : top + step], ((0, 0), (1, 1))).ravel()
        width = dark.shape[1] + 2
        edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
        if len(edges) < 6:
            continue
        runs = np.lib.stride_tricks.sliding_window_view(np.diff(edges), 5)[::2]
        start = edges[: 2 * len(runs) : 2]
        size = runs.sum(axis=1)
        module = size / 7
        fits = (start // width == (start + size) // width) & (np.abs(runs - module[:, None] * [1, 1, 3, 1, 1]) <= module[:, None] * [0.6, 0.6, 1.2, 0.6, 0.6]).all(axis=1)
        at = start[fits]
        found.append((at // width + top, at % width - 1 + runs[fits, :2].sum(axis=1) + runs[fits, 2] / 2, module[fits]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def finders(dark: np.ndarray) -> list[tuple[float, float, float]]:
    """(x, y, module size along the sides) of finder patterns: centres of runs in both directions."""
    y, x, size = _crossings(dark)
    x2, y2, size2 = _crossings(dark.T)
    key = lambda a, b: a.astype(np.int64) * (max(dark.shape) + 8) + b.astype(np.int64)
    own, other = key(y, np.floor(x)), key(np.floor(y2), x2)
    order = np.argsort(other)
    held = [np.zeros((0, 3))]
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            at = own + dy * (max(dark.shape) + 8) + dx
            spot = np.minimum(np.searchsorted(other[order], at), max(len(order) - 1, 0))
            hit = np.flatnonzero(other[order][spot] == at) if len(order) else np.zeros(0, dtype=np.int64)
            held.append(np.column_stack([x[hit], y2[order[spot[hit]]], (size[hit] + size2[order[spot[hit]]]) / 2]))
    points = np.concatenate(held)
    if not len(points):
        return []
    # crossings of one cell count together, then cells of one pattern
    cell = np.floor(points[:, :2] / 3).astype(np.int64)
    _, at, times = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
    means = np.column_stack([np.bincount(at.ravel(), points[:, c]) for c in range(3)]) / times[:, None]
    groups: list[list[float]] = []
    for i in np.argsort(-times, kind="stable")[:CELLS].tolist():
        px, py, m, n = *means[i].tolist(), int(times[i])
        own_group = next((g for g in groups if abs(g[0] / g[3] - px) < m and abs(g[1] / g[3] - py) < m), None)
        if own_group is None:
            groups.append([px * n, py * n, m * n, n])
        else:
            own_group[:] = own_group[0] + px * n, own_group[1] + py * n, own_group[2] + m * n, own_group[3] + n
    groups.sort(key=lambda g: -g[3])
    return [(g[0] / g[3], g[1] / g[3], g[2] / g[3]) for g in groups[:FINDERS]]


def _corners(found: list[tuple[float, float, float]]) -> list[tuple[int, int, int, float]]:
    """(top left, top right, bottom left, modules along a side) of patterns that may belong together, the likeliest first."""
    if len(found) < 3:
        return []
    at, size = np.array([complex(x, y) for x, y, _ in found]), np.array([m for _, _, m in found])
    i, j, k = (c.ravel() for c in np.indices((len(found),) * 3))
    apart = (i != j) & (i != k) & (j != k)
    i, j, k = i[apart], j[apart], k[apart]
    a, b = at[j] - at[i], at[k] - at[i]
    turn, sizes = a.conjugate() * b, np.stack([size[i], size[j], size[k]])
    long, short = np.maximum(abs(a), abs(b)), np.minimum(abs(a), abs(b))
    square = abs(turn.real) / np.maximum(long * short, 1e-9) + 1 - short / np.maximum(long, 1e-9)
    # runs along rows are longer where the symbol is turned
    module = sizes.mean(axis=0) * np.maximum(abs(a.real), abs(a.imag)) / np.maximum(abs(a), 1e-9)
    side = (long + short) / 2 / module + 7
    fits = np.flatnonzero((turn.imag > 0) & (sizes.max(axis=0) <= 1.5 * sizes.min(axis=0)) & (square < 0.3) & (side >= 19) & (side <= 185))
    best = fits[np.argsort(square[fits] + abs(side[fits] - 17) % 4 / 40, kind="stable")][:TRIED]
    return list(zip(i[best].tolist(), j[best].tolist(), k[best].tolist(), side[best].tolist(), strict=True))


def _sampled(dark: np.ndarray, a: tuple, b: tuple, c: tuple, n: int) -> np.ndarray | None:
    """Modules at the points that the three patterns span."""
    u = (np.arange(n) - 3) / (n - 7)
    x = a[0] + (b[0] - a[0]) * u[None, :] + (c[0] - a[0]) * u[:, None]
    y = a[1] + (b[1] - a[1]) * u[None, :] + (c[1] - a[1]) * u[:, None]
    x, y = np.floor(x).astype(int), np.floor(y).astype(int)
    if x.min() < 0 or y.min() < 0 or x.max() >= dark.shape[1] or y.max() >= len(dark):
        return None
    return dark[y, x]


def corrected(block: np.ndarray, checks: int) -> np.ndarray | None:
    """A Reed-Solomon block without its errors, None where there are too many."""
    exp, log = Q.powers()
    n = len(block)
    held = np.flatnonzero(block)
    # values of the block's polynomial at the first powers of 2
    roots = (log[block[held]][None, :] + np.arange(checks)[:, None] * (n - 1 - held)[None, :]) % 255
    syndromes = np.bitwise_xor.reduce(exp[roots], axis=1) if len(held) else np.zeros(checks, dtype=np.int64)
    if not syndromes.any():
        return block
    times = lambda a, b: int(exp[log[a] + log[b]]) if a and b else 0
    over = lambda a, b: int(exp[log[a] - log[b] + 255]) if a else 0
    # the shortest recurrence that makes the values: its coefficients locate the errors
    locator, before, size, gap, last = [1], [1], 0, 1, 1
    for r in range(checks):
        off = int(syndromes[r])
        for i in range(1, min(size, len(locator) - 1) + 1):
            off ^= times(locator[i], int(syndromes[r - i]))
        if not off:
            gap += 1
            continue
        shifted = [0] * gap + [times(over(off, last), x) for x in before]
        fresh = [x ^ y for x, y in zip(locator + [0] * (len(shifted) - len(locator)), shifted + [0] * (len(locator) - len(shifted)), strict=True)]
        if 2 * size <= r:
            before, size, last, gap = locator, r + 1 - size, off, 1
        else:
            gap += 1
        locator = fresh
    value = lambda poly, x: int(np.bitwise_xor.reduce([times(c, int(exp[x * i % 255])) for i, c in enumerate(poly)]))
    places = [p for p in range(n) if value(locator, -p % 255) == 0]
    if size > checks // 2 or len(places) != size:
        return None
    errors = [0] * checks
    for i, a in enumerate(locator):
        for j in range(checks - i):
            errors[i + j] ^= times(a, int(syndromes[j]))
    slope = [c if i % 2 else 0 for i, c in enumerate(locator)][1:]
    out = block.copy()
    for p in places:
        out[n - 1 - p] ^= times(int(exp[p]), over(value(errors, -p % 255), value(slope, -p % 255)))
    return out


def _ruled(modules: np.ndarray) -> bool:
    """Whether the modules that are the same in every symbol of that size are mostly there: timing lines and version."""
    n = len(modules)
    line = np.arange(8, n - 8) % 2 == 0
    told = [(modules[6, 8 : n - 8] == line).mean(), (modules[8 : n - 8, 6] == line).mean()]
    if max(told) < 0.8:
        return False
    want = Q.guarded((n - 17) // 4, Q.VERSION, 12)
    return n < 45 or min((sum(int(modules[p]) << i for i, p in enumerate(places)) ^ want).bit_count() for places in Q.version_places(n)) <= 3


def _format(modules: np.ndarray) -> list[tuple[str, int]]:
    """Levels and masks that the format bits may say, the nearest first."""
    n = len(modules)
    read = [sum(int(modules[p]) << i for i, p in enumerate(places)) for places in Q.format_places(n)]
    apart = sorted((min((Q.format_bits(level, mask) ^ bits).bit_count() for bits in read), level, mask) for level in Q.LEVELS for mask in range(8))
    return [(level, mask) for d, level, mask in apart if d <= 3][:1]


def text_of(modules: np.ndarray) -> str | None:
    """What a symbol's modules say, None where they aren't a symbol."""
    version = (len(modules) - 17) // 4
    if not _ruled(modules):
        return None
    y, x = Q.path(version)
    for level, mask in _format(modules):
        bits = modules[y, x] ^ Q.inverted_by(mask, y, x)
        stream = np.packbits(bits[: len(bits) // 8 * 8]).astype(np.int64)
        sizes, checks = Q.lengths(level, version), Q.check_bytes(level, version)
        blocks: list[list[int]] = [[] for _ in sizes]
        order = [j for i in range(max(sizes)) for j, size in enumerate(sizes) if i < size] + list(range(len(sizes))) * checks
        for j, byte in zip(order, stream.tolist(), strict=False):
            blocks[j].append(byte)
        whole = []
        for block in blocks:
            whole.append(corrected(np.array(block), checks))
            if whole[-1] is None:
                break
        else:
            return _said("".join(f"{v:08b}" for b, size in zip(whole, sizes, strict=True) for v in b[:size].tolist()), version)
    return None


def _said(bits: str, version: int) -> str | None:
    """The text of a symbol's segments."""
    at, out = 0, []

    def take(n: int) -> int:
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    while at + 4 <= len(bits):
        mode = take(4)
        if mode == 0:
            break
        if mode == 7:  # another character set is named; bytes are told apart below
            head = take(8)
            take(0 if head < 128 else 8 if head < 192 else 16)
            continue
        if mode in (3, 5, 9):  # a part of several symbols, or an application's mark
            take({3: 16, 5: 0, 9: 8}[mode])
            continue
        if mode not in Q.COUNT_BITS:
            return None
        n = take(Q.count_bits(mode, version))
        if mode == 1:
            parts = [3] * (n // 3) + ([n % 3] if n % 3 else [])
            out.append("".join(f"{take((4, 7, 10)[p - 1]):0{p}d}" for p in parts))
        elif mode == 2:
            pairs = [take(11) for _ in range(n // 2)]
            out.append("".join(Q.LETTERS[v // 45 % 45] + Q.LETTERS[v % 45] for v in pairs) + (Q.LETTERS[take(6) % 45] if n % 2 else ""))
        else:
            data = bytes(take(8) for _ in range(n)) if mode == 4 else b"".join(_kanji(take(13)) for _ in range(n))
            if at > len(bits):
                return None
            try:
                out.append(data.decode("utf-8" if mode == 4 else "shift_jis"))
            except UnicodeDecodeError:
                out.append(data.decode("latin-1"))
    return "".join(out)


def _kanji(value: int) -> bytes:
    code = value // 0xC0 << 8 | value % 0xC0
    return (code + (0x8140 if code + 0x8140 <= 0x9FFC else 0xC140)).to_bytes(2, "big")


def texts(dark: np.ndarray) -> list[str]:
    """What the symbols of an image say."""
    found, used, out = finders(dark), set(), []
    for i, j, k, side in _corners(found):
        if used & {i, j, k}:
            continue
        near = round((side - 17) / 4)
        for version in (near, near + 1, near - 1, near + 2, near - 2):
            if not 1 <= version <= 40:
                continue
            modules = _sampled(dark, found[i], found[j], found[k], Q.size_of(version))
            said = None if modules is None else text_of(modules)
            if said is not None:
                used |= {i, j, k}
                if said:
                    out.append(said)
                break
    return out


def read(data: bytes) -> dict:
    """status, reason, pixels and values (distinct texts) of an image."""
    state = lambda status, reason="", pixels=0, values=(): {"status": status, "reason": reason, "pixels": pixels, "values": list(values)}
    if not data:
        return state("not_evaluated", "empty")
    size = measured(data)
    if not size or not all(size):
        return state("not_evaluated", "unreadable_image")
    pixels = size[0] * size[1]
    if pixels > MAX_PIXELS:
        return state("not_evaluated", "image_too_large", pixels)
    if not data.startswith(b"\x89PNG"):
        return state("not_evaluated", "local_qr_decoder_unavailable", pixels)
    try:
        light = grey(data)
        if light is None:
            return state("not_evaluated", "decode_error", pixels)
        dark = light <= threshold(light)
        values = texts(dark) or texts(~dark)  # light modules on a dark ground
    except (zlib.error, struct.error, KeyError, ValueError, IndexError, OverflowError):
        return state("not_evaluated", "decode_error", pixels)
    return state("evaluated", "", pixels, [unicodedata.normalize("NFC", v)[:MAX_CHARS] for v in dict.fromkeys(values)][:MAX_SYMBOLS])


STATE = "struct<status:string,reason:string,pixels:bigint,values:array<string>>"


def with_codes(images: DataFrame, column: str = "content", into: str = "codes") -> DataFrame:
    """images with what the codes in a binary column say."""

    @F.arrow_udf(STATE)
    def codes(data: pa.Array) -> pa.Array:
        kind = pa.struct([("status", pa.string()), ("reason", pa.string()), ("pixels", pa.int64()), ("values", pa.list_(pa.string()))])
        return pa.array([read(x.as_py() or b"") for x in data], kind)

    return images.withColumn(into, codes(column))
