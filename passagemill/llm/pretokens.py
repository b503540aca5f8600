"""Pre-tokens of byte-level BPE as byte spans, cut by vectorised class changes.

The classes of code points (letter, number, space, other) are read from the tokenizer library itself, so both always
agree about Unicode. Rules: a run of one class is a pre-token; one plain space before a run belongs to it; of a run of
white space before other text only the last character stands apart; an apostrophe with s, t, m, d, re, ve or ll is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .arrowtext import PIECE, span_hashes

LETTER, NUMBER, OTHER, SPACE, SPECIAL = range(5)


@lru_cache(maxsize=4)
def code_point_classes(path: str) -> np.ndarray:
    """The class of each code point, by probing the library's pre-tokenizer: whole blocks first, then single ones."""
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    classes = np.full(0x110000, OTHER, np.uint8)

    def whole(text: str) -> bool:
        return len(cut(text)) == 1

    def probe(lo: int, hi: int) -> None:
        text = "".join(map(chr, range(lo, hi)))
        if whole(f"!{text}!"):
            return
        for kind, frame in ((LETTER, "a"), (NUMBER, "1")):
            if whole(f"{frame}{text}{frame}"):
                classes[lo:hi] = kind
                return
        if hi - lo == 1:
            classes[lo] = SPACE
            return
        mid = (lo + hi) // 2
        probe(lo, mid)
        probe(mid, hi)

    for lo in range(0, 0x110000, 256):
        if not 0xD800 <= lo < 0xE000:
            probe(lo, lo + 256)
    return classes


#: ASCII signs before which a word may be cut off: no contraction and no special string begins or goes on with one.
_PLAIN_SIGNS = [ord(c) for c in ".,;:!?()\""]
#: Bytes that are decoded at a time in search of a cut.
_WINDOW = 1 << 14


def _cuts(part: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Bytes of ``part``, which begins with a character, at which no pre-token goes on: ascending, none at its start.

    Such places are before white space that follows something else, and between a letter or number and a sign.
    """
    cp = np.frombuffer(part.tobytes().decode("utf-8", "ignore").encode("utf-32-le"), np.uint32)
    kind = classes[cp]
    at = np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))[:-1]
    before, after, sign = kind[:-1], kind[1:], cp[1:]
    word = (before == LETTER) | (before == NUMBER)
    return at[((after == SPACE) & (before != SPACE)) | (word & (after == OTHER) & ((sign > 0x7F) | np.isin(sign, _PLAIN_SIGNS)))]


def safe_pieces(data: np.ndarray, at: np.ndarray, classes: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts about every ``size`` bytes, at row starts or at places that no pre-token crosses, in any script.

    The last such place of a window before the wanted size is taken, else the first one after it; every byte is looked
    at a few times at most. What is longer is one pre-token, or white space.
    """
    lo, n = 0, len(data)

    def first_byte(i: int) -> int:
        """The start of the character at i."""
        while 0 < i < n and data[i] & 0xC0 == 0x80:
            i -= 1
        return i

    while lo < n:
        goal = lo + size
        if goal >= n:
            hi = n
        else:
            row = int(at[np.searchsorted(at, goal, "right") - 1])
            a, b = first_byte(max(lo, goal - _WINDOW)), first_byte(goal)
            found = _cuts(data[a:b], classes)
            hi = max(row, a + int(found[-1]) if len(found) else lo)
            while hi <= lo:
                # the window's last character is seen again, with what follows it
                a, b = first_byte(b - 1), n if b + _WINDOW >= n else first_byte(b + _WINDOW)
                found = _cuts(data[a:b], classes)
                hi = min(int(at[np.searchsorted(at, a, "right")]), a + int(found[0]) if len(found) else n)
                if hi > b:
                    hi = lo
        yield lo, hi
        lo = hi


def pretokens(data: np.ndarray, rows: np.ndarray, classes: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every pre-token, and its 64-bit hash. rows: bytes at which a row starts.

    ``special`` is the string that the library takes as one token wherever it stands; empty: none.
    """
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF), out=at[1:])
    kind = classes[cp]
    hard = np.zeros(n + 3, bool)
    hard[np.searchsorted(at, rows)] = True
    hard[n:] = True
    found = raw.find(special) if special else -1
    while found >= 0:
        a, b = np.searchsorted(at, (found, found + len(special)))
        if not hard[a + 1 : b].any():
            kind[a:b] = SPECIAL
            hard[[a, b]] = True
            found = raw.find(special, found + len(special))
        else:
            found = raw.find(special, found + 1)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= hard[: n + 1]
    blank = kind == SPACE
    last_blank = np.flatnonzero(blank[:-1] & ~blank[1:] & ~hard[1:n]) if n else np.empty(0, np.int64)
    start[last_blank] = True
    start[last_blank[cp[last_blank] == 0x20] + 1] = False
    mark = np.flatnonzero((cp == 0x27) & start[:n] & (kind == OTHER))
    if len(mark):
        padded = np.concatenate([cp, np.zeros(3, np.uint32)])
        one, two = padded[mark + 1], padded[mark + 2]
        open1 = ~hard[mark + 1]
        open2 = open1 & ~hard[mark + 2]
        short = open1 & np.isin(one, [ord(c) for c in "stmd"])
        long = open2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    s = np.flatnonzero(start[:n])
    begin = at[s]
    end = np.append(begin[1:], at[n]) if n else begin
    return begin, end, span_hashes(data, begin, end)
