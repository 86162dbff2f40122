"""Draws QR symbols and PNG files, for samples and tests."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import qr_layout as Q


def _checks(data: list[int], n: int) -> list[int]:
    """The n check bytes of a block: what division by (x - 1)(x - 2)(x - 4)... leaves."""
    exp, log = Q.powers()
    divisor = [1]
    for i in range(n):
        divisor = [a ^ (int(exp[log[b] + i]) if b else 0) for a, b in zip([*divisor, 0], [0, *divisor], strict=True)]
    rest = [*data, *[0] * n]
    for i in range(len(data)):
        if rest[i]:
            for j, d in enumerate(divisor[1:], 1):
                rest[i + j] ^= int(exp[log[rest[i]] + log[d]]) if d else 0
    return rest[len(data) :]


def _segment(text: str, version: int) -> str:
    """Bits of a text as digits, letters or UTF-8 bytes."""
    count = lambda mode, n: f"{mode:04b}" + f"{n:0{Q.count_bits(mode, version)}b}"
    if text and set(text) <= set("0123456789"):
        parts = [text[i : i + 3] for i in range(0, len(text), 3)]
        return count(1, len(text)) + "".join(f"{int(p):0{(4, 7, 10)[len(p) - 1]}b}" for p in parts)
    if text and set(text) <= set(Q.LETTERS):
        at = [Q.LETTERS.index(c) for c in text]
        return count(2, len(at)) + "".join(f"{at[i] * 45 + at[i + 1]:011b}" if i + 1 < len(at) else f"{at[i]:06b}" for i in range(0, len(at), 2))
    data = text.encode()
    return count(4, len(data)) + "".join(f"{b:08b}" for b in data)


def symbol(text: str, level: str = "M", mask: int = 0, least: int = 1) -> np.ndarray:
    """The modules of a text's symbol (True: dark), of the smallest version from least on that holds it."""
    for version in range(least, 41):
        bits, room = _segment(text, version), 8 * sum(Q.lengths(level, version))
        if len(bits) <= room:
            break
    else:
        raise ValueError("the text is too long for a symbol")
    bits += "0" * min(4, room - len(bits))
    bits += "0" * (-len(bits) % 8)
    data = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    data += [(0xEC, 0x11)[i % 2] for i in range(room // 8 - len(data))]
    blocks, at = [], 0
    for n in Q.lengths(level, version):
        blocks.append(data[at : at + n])
        at += n
    checks = [_checks(b, Q.check_bytes(level, version)) for b in blocks]
    stream = [b[i] for i in range(max(map(len, blocks))) for b in blocks if i < len(b)] + [c[i] for i in range(len(checks[0])) for c in checks]
    n = Q.size_of(version)
    dark = np.zeros((n, n), dtype=bool)
    y, x = Q.path(version)
    flat = np.unpackbits(np.array(stream, dtype=np.uint8)).astype(bool)
    dark[y[: len(flat)], x[: len(flat)]] = flat
    dark[y, x] ^= Q.inverted_by(mask, y, x)
    distance = np.maximum(*np.abs(np.mgrid[-4:5, -4:5]))
    finder = (distance != 2) & (distance != 4)
    dark[:8, :8], dark[:8, n - 8 :], dark[n - 8 :, :8] = finder[1:, 1:], finder[1:, :8], finder[:8, 1:]
    line = np.arange(8, n - 8) % 2 == 0
    dark[6, 8 : n - 8] = dark[8 : n - 8, 6] = line
    for cy, cx in Q.alignments(version):
        dark[cy - 2 : cy + 3, cx - 2 : cx + 3] = distance[2:7, 2:7] != 1
    for i in range(15):
        for places in Q.format_places(n):
            dark[places[i]] = Q.format_bits(level, mask) >> i & 1
    dark[n - 8, 8] = True
    if version >= 7:
        for i in range(18):
            for places in Q.version_places(n):
                dark[places[i]] = Q.guarded(version, Q.VERSION, 12) >> i & 1
    return dark


def drawn(dark: np.ndarray, scale: int = 4, border: int = 4) -> np.ndarray:
    """Pixels (0 to 255) of a symbol with light modules around it."""
    return np.where(np.kron(np.pad(dark, border), np.ones((scale, scale), dtype=bool)), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray, kind: int = 0, filters: int | None = None) -> bytes:
    """A PNG file of 8-bit samples (rows, columns and, but for kind 0, channels); filters: the type of every row, else they take turns."""
    rows = pixels.reshape(len(pixels), pixels.shape[1], -1)
    before = np.zeros((3, *rows.shape), dtype=np.int64)  # left, above, above left
    before[0, :, 1:], before[1, 1:], before[2, 1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    left, above, corner = before
    p = left + above - corner
    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
    guesses = (0 * left, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner)))
    lines = []
    for y, row in enumerate(rows):
        how = y % 5 if filters is None else filters
        lines.append(bytes([how]) + ((row - guesses[how][y]) % 256).astype(np.uint8).tobytes())
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
