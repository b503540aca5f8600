"""Vectorised views on Arrow text columns, used inside ``mapInArrow`` tasks.

A batch of texts is handled as one UTF-8 byte array with row offsets. Words and other spans get 64-bit hashes without
a Python object for each; memory follows the piece size, not the batch or the longest text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)


def text_rows(batch: pa.RecordBatch, column: str | int) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 row offsets; a null counts as an empty text."""
    texts = batch.column(column).cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *after: Callable[[], object]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for ``mapInArrow`` that calls ``after`` and gives spare memory back when a task ends.

    Spark keeps its Python workers for the stages that follow, where what they hold would add up.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in after:
                f()
            release()

    return task


def release() -> None:
    """Arrow's and, where the C library can, the allocator's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_groups(at: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer text stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of more bytes are hashed one by one.
_SHORT = 64
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: equal content gives an equal hash wherever it stands.

    Up to _SHORT bytes, eight bytes after each other are mixed into the hash by a step that is not linear, for all
    spans side by side; longer spans take a cryptographic digest, so patterns in them can't cancel out.
    """
    length = (end - start).astype(np.int64)
    out = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _SEED)
    long = np.flatnonzero(length > _SHORT)
    size = np.where(length > _SHORT, 0, length)
    eight = np.zeros(len(data) + 8, np.uint8)
    eight[: len(data)] = data
    eight = np.lib.stride_tricks.sliding_window_view(eight, 8)
    todo = np.flatnonzero(size > 0)
    at = 0
    while len(todo):
        word = eight[start[todo] + at].view("<u8").ravel() & _LOW[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ word) * _STEP + np.uint64(at + 1))
        at += 8
        todo = todo[size[todo] > at]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_table(separators: set[int], lower: bool) -> np.ndarray:
    """Byte → 0 for a separator, else the byte (A-Z folded if asked). Byte 0 must be a separator or never occur in words;
    where it is none (SPACES), it stands as 0xFF, which UTF-8 doesn't hold."""
    table = np.arange(256).astype(np.uint8)
    table[0] = 0xFF
    if lower:
        table[ord("A") : ord("Z") + 1] += np.uint8(32)
    table[list(separators)] = 0
    return table


#: Separators of words as the contract writes them: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACES = {0x20, *range(0x09, 0x0E)}
NOT_ALNUM = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
SPACED_WORDS = word_table(SPACES, lower=True)
ALNUM_WORDS = word_table(NOT_ALNUM - {*range(ord("A"), ord("Z") + 1)}, lower=True)


def byte_pieces(breaks: np.ndarray, data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts right after a break byte, about every ``size`` bytes, so that no word is divided."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + size)
        if hi < n:
            found = np.flatnonzero(breaks[data[lo:hi]])
            if len(found):
                hi = lo + int(found[-1]) + 1
            else:
                while hi < n:
                    found = np.flatnonzero(breaks[data[hi : hi + size]])
                    if len(found):
                        hi += int(found[0]) + 1
                        break
                    hi = min(n, hi + size)
        yield lo, hi
        lo = hi


def _spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, folded bytes, word starts, word ends) of pieces that no word crosses."""
    row_start = at[:-1]
    for lo, hi in byte_pieces(table == 0, data, PIECE):
        low = table[data[lo:hi]]
        inside = low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = row_start[np.searchsorted(row_start, lo) : np.searchsorted(row_start, hi)] - lo
        first[own] = inside[own]
        goes_on = np.zeros(len(low), bool)
        goes_on[:-1] = inside[1:] & ~first[1:]
        yield lo, low, np.flatnonzero(first), np.flatnonzero(inside & ~goes_on) + 1


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, start and end of every word in them, and the index of each row's first word (n + 1 entries)."""
    low, start, end = [np.empty(0, np.uint8)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, part, s, e in _spans(data, at, table):
        low.append(part)
        start.append(s + lo)
        end.append(e + lo)
    every = np.concatenate(start)
    return np.concatenate(low), every, np.concatenate(end), np.searchsorted(every, at)


def word_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the index of each row's first word (n + 1 entries)."""
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo, low, s, e in _spans(data, at, table):
        hashes.append(span_hashes(low, s, e))
        starts.append(s + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


_COMBINE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, rows not regarded; k up to 64."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += words[j : j + n] * _COMBINE[j]
    return mix(total)


def take_ranges(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] for every i, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]
