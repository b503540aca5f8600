"""Draws by hash, many at once: the first 32 bits of md5 over a seed, an iteration and each slot of a range."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
#: Bytes of a message that fits one block of md5.
_BLOCK = 55


def _first_word(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """md5 of n messages of one block each, of which words are the 16 words (a number where all have the same): the first 8 hex digits."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    mixed, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't change the first word
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=mixed)
            mixed &= x
            mixed ^= z
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            np.bitwise_not(d, out=mixed)
            mixed |= b
            mixed ^= c
        word = words[_PLACES[i]]
        if isinstance(word, int):
            a += np.uint32((_ADDED[i] + word) & 0xFFFFFFFF)
        else:
            a += word
            a += np.uint32(_ADDED[i])
        a += mixed
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=high)
        a <<= np.uint32(_SHIFTS[i])
        a |= high
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _digits(low: int, high: int) -> np.ndarray:
    """A row for each digit of low .. high - 1, which have the same number of them: its characters."""
    left, out = np.arange(low, high, dtype=np.uint64), []
    for _ in str(low):
        left, digit = np.divmod(left, np.uint64(10))
        out.append((digit + np.uint64(48)).astype(np.uint32))
    return np.stack(out[::-1])


def _words(at: int, digits: np.ndarray) -> list[np.ndarray | None]:
    """The 16 words of messages that have these digits from byte ``at`` on and nothing else."""
    out: list[np.ndarray | None] = [None] * 16
    for k, digit in enumerate(digits, at):
        placed = digit << np.uint32(8 * (k % 4))
        out[k // 4] = placed if out[k // 4] is None else out[k // 4] | placed
    return out


def hashed_slots(seed: int, iterations: range, low: int, high: int) -> np.ndarray:
    """A row for each iteration: the first 8 hex digits of md5('seed-iteration-slot'), as numbers, for the slots low .. high - 1."""
    out = np.empty((len(iterations), high - low), np.uint32)
    while low < high:
        upto = min(high, 10 ** len(str(low)))  # slots with the same number of digits
        digits, placed = _digits(low, upto), {}
        for row, it in zip(out, iterations, strict=True):
            prefix = f"{seed}-{it}-".encode()
            at, size = len(prefix), len(prefix) + len(digits)
            if size > _BLOCK:
                raise ValueError(f"a draw is named by more than {_BLOCK} bytes")
            if at not in placed:
                placed[at] = _words(at, digits)
            rest = np.frombuffer(prefix + bytes(len(digits)) + b"\x80" + bytes(_BLOCK - size) + (8 * size).to_bytes(8, "little"), "<u4").tolist()
            row[out.shape[1] - (high - low) :][: upto - low] = _first_word([r if p is None else p | np.uint32(r) for p, r in zip(placed[at], rest, strict=True)], upto - low)
        low = upto
    return out
