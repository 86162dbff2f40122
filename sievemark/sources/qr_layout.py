"""How QR symbols are laid out (ISO/IEC 18004): what the reader and the writer of symbols share."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed values of the standard, by error correction level and from version 1 on: check bytes of a block (the last number holds for all later versions), and blocks.
CHECK_BYTES = {
    "L": (7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28, 28, 28, 30, 30, 26, 28, 30),
    "M": (10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26, 26, 28),
    "Q": (13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30, 28, 30, 30, 30, 30, 28, 30),
    "H": (17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28, 30, 24, 30),
}
BLOCKS = {
    "L": (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8, 8, 9, 9, 10, 12, 12, 12, 13, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 24, 25),
    "M": (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16, 17, 17, 18, 20, 21, 23, 25, 26, 28, 29, 31, 33, 35, 37, 38, 40, 43, 45, 47, 49),
    "Q": (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20, 23, 23, 25, 27, 29, 34, 34, 35, 38, 40, 43, 45, 48, 51, 53, 56, 59, 62, 65, 68),
    "H": (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25, 25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81),
}
LEVELS = {"L": 1, "M": 0, "Q": 3, "H": 2}
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
#: Bits of the count behind a mode, for versions up to 9, up to 26 and above; by mode: digits, letters, bytes, Kanji.
COUNT_BITS = {1: (10, 12, 14), 2: (9, 11, 13), 4: (8, 16, 16), 8: (8, 10, 12)}
FIELD, FORMAT, FORMAT_MASK, VERSION = 0x11D, 0x537, 0x5412, 0x1F25


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2 in the field of 256 elements (twice, so that sums of two logarithms need no modulo), and logarithms."""
    exp, log, x = np.zeros(512, dtype=np.int64), np.zeros(256, dtype=np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (FIELD if x & 0x80 else 0)
    return exp, log


def guarded(value: int, check: int, bits: int) -> int:
    """A value with the remainder of its division by the check polynomial behind it."""
    rest = value << bits
    for i in range(value.bit_length() - 1, -1, -1):
        if rest >> (i + bits) & 1:
            rest ^= check << i
    return value << bits | rest


def size_of(version: int) -> int:
    return 17 + 4 * version


def check_bytes(level: str, version: int) -> int:
    return CHECK_BYTES[level][min(version, len(CHECK_BYTES[level])) - 1]


def count_bits(mode: int, version: int) -> int:
    return COUNT_BITS[mode][(version > 9) + (version > 26)]


@cache
def centres(version: int) -> tuple[int, ...]:
    """Where alignment patterns stand along one side: evenly, but for the first gap."""
    if version == 1:
        return ()
    n, last = version // 7 + 2, size_of(version) - 7
    step = 26 if version == 32 else -(-(last - 6) // (2 * (n - 1))) * 2
    return (6, *range(last - step * (n - 2), last + 1, step))


@cache
def reserved(version: int) -> np.ndarray:
    """Modules that hold no data."""
    n = size_of(version)
    held = np.zeros((n, n), dtype=bool)
    held[:9, :9] = held[:9, n - 8 :] = held[n - 8 :, :9] = True
    held[6, :] = held[:, 6] = True
    for y, x in alignments(version):
        held[y - 2 : y + 3, x - 2 : x + 3] = True
    if version >= 7:
        held[n - 11 : n - 8, :6] = held[:6, n - 11 : n - 8] = True
    return held


@cache
def alignments(version: int) -> tuple[tuple[int, int], ...]:
    at = centres(version)
    corners = {(at[0], at[0]), (at[0], at[-1]), (at[-1], at[0])} if at else set()
    return tuple((y, x) for y in at for x in at if (y, x) not in corners)


@cache
def path(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the data modules, in reading order: pairs of columns from the right, up and down in turn."""
    n, free, rows, columns = size_of(version), ~reserved(version), [], []
    up = True
    for right in [*range(n - 1, 6, -2), *range(5, 0, -2)]:
        y = np.repeat(np.arange(n)[::-1] if up else np.arange(n), 2)
        x = np.tile([right, right - 1], n)
        own = free[y, x]
        rows.append(y[own])
        columns.append(x[own])
        up = not up
    return np.concatenate(rows), np.concatenate(columns)


def inverted_by(mask: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modules that a mask inverts."""
    product = y * x
    rule = ((x + y) % 2, y % 2, x % 3, (x + y) % 3, (x // 3 + y // 2) % 2, product % 2 + product % 3, (product % 2 + product % 3) % 2, ((x + y) % 2 + product % 3) % 2)[mask]
    return rule == 0


def lengths(level: str, version: int) -> list[int]:
    """Data bytes of each block; each is followed by as many check bytes as the level asks for."""
    total, blocks = len(path(version)[0]) // 8, BLOCKS[level][version - 1]
    own = total // blocks - check_bytes(level, version)
    return [own + (i >= blocks - total % blocks) for i in range(blocks)]


def format_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, column) of the format's 15 bits, lowest first, in both copies."""
    first = [(i, 8) for i in range(6)] + [(7, 8), (8, 8), (8, 7)] + [(8, 14 - i) for i in range(9, 15)]
    second = [(8, n - 1 - i) for i in range(8)] + [(n - 15 + i, 8) for i in range(8, 15)]
    return first, second


def format_bits(level: str, mask: int) -> int:
    return guarded(LEVELS[level] << 3 | mask, FORMAT, 10) ^ FORMAT_MASK


def version_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    own = [(i // 3, n - 11 + i % 3) for i in range(18)]
    return own, [(x, y) for y, x in own]
