"""Operator 5: byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import lean, row_groups, take_ranges, text_rows
from .pretokens import code_point_classes, pretokens, safe_pieces

#: Pre-tokens up to this many bytes are merged many at a time in arrays, longer ones alone.
WIDE = 64
#: Pre-tokens whose ids a task keeps; beyond, its cache starts anew.
CACHE_ENTRIES = 1 << 17
#: Places of the trees that are merged side by side.
TREE_PLACES = 1 << 18
_NONE = np.iinfo(np.int64).max
#: Bits of a place in a leaf of a long pre-token's tree.
_PLACE = 40


def _byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary → byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        pieces |= {i: t for t, i in self.special.items()}
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_len = np.array([len(b) for b in ordered], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a very large number; a symbol below 0 means that there is none."""
        keys = left << 32 | right
        i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[i] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[i], _NONE)

    def encode_one(self, token: bytes) -> np.ndarray:
        """One pre-token of any length by a segment tree in flat arrays; n log n steps at most, 56 bytes a byte.

        A leaf is rank and place in one number, so that the root is the leftmost pair of the lowest rank; a way up
        ends where nothing changes.
        """
        n = len(token)
        size = 1 << max(0, n - 1).bit_length()
        none = _NONE
        start = self.byte_id[np.frombuffer(token, np.uint8)]
        ranks = self.ranks(start[:-1], start[1:])
        level = np.full(size, none)
        level[: n - 1] = np.where(ranks == none, none, ranks << _PLACE | np.arange(n - 1))
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = array("q", np.concatenate([[none], *levels[::-1]]).tobytes())
        sym, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1)))
        rank_of, made = self.rank_of, self.made
        low = (1 << _PLACE) - 1

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                value = value if value < other else other
                k >>= 1
                if tree[k] == value:
                    return
                tree[k] = value

        def leaf(i: int, j: int) -> int:
            rank = rank_of.get(sym[i] << 32 | sym[j])
            return none if rank is None else rank << _PLACE | i

        while (root := tree[1]) != none:
            i = root & low
            j = after[i]
            k = after[j]
            sym[i] = made[root >> _PLACE]
            sym[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k) if k < n else none)
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        out = np.frombuffer(sym, np.int64)
        return out[out >= 0]

    def encode_many(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and the number of ids of each."""
        length = np.array([len(t) for t in tokens], np.int64)
        out: list = [None] * len(tokens)
        for i in np.flatnonzero(length > WIDE).tolist():
            out[i] = self.encode_one(tokens[i])
        for i in np.flatnonzero(length <= WIDE).tolist():
            if tokens[i] in self.special:
                out[i] = np.array([self.special[tokens[i]]])
        width = 1
        while width < WIDE:
            width *= 2
            some = np.flatnonzero((length <= width) & (length > (width // 2 if width > 2 else 0)))
            some = some[[out[i] is None for i in some.tolist()]] if len(some) else some
            step = TREE_PLACES // width
            for lo in range(0, len(some), step):
                self._merge_rows(tokens, some[lo : lo + step], width, out)
        n = np.array([len(x) for x in out], np.int64)
        return np.concatenate([np.empty(0, np.int64), *out]), n

    def _merge_rows(self, tokens: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        """The segment trees of many pre-tokens of up to ``width`` bytes side by side, one merge of each in a step."""
        count = len(rows)
        flat = np.frombuffer(b"".join(tokens[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(count, width)
        length = np.array([len(tokens[i]) for i in rows.tolist()])
        sym = np.full((count, width + 1), -1, np.int64)
        sym[:, :width] = np.where(np.arange(width) < length[:, None], self.byte_id[flat], -1)
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (count, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (count, width + 1)).copy()
        place = np.arange(width)
        tree = np.full((count, 2 * width), _NONE)

        def leaves(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == _NONE, _NONE, rank * width + at)

        tree[:, width:] = leaves(self.ranks(sym[:, :-1], sym[:, 1:]), place)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            node = at + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            k = after[live, j]
            sym[live, i] = self.made[root // width]
            sym[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            put(live, j, _NONE)
            put(live, i, leaves(self.ranks(sym[live, i], sym[live, k]), i))
            p = before[live, i]
            some = np.flatnonzero(p >= 0)
            if len(some):
                put(live[some], p[some], leaves(self.ranks(sym[live[some], p[some]], sym[live[some], i[some]]), p[some]))
            live = live[tree[live, 1] != _NONE]
        kept = sym[:, :width] >= 0
        ids, ends = sym[:, :width][kept], np.cumsum(kept.sum(axis=1)).tolist()
        a = 0
        for row, b in zip(rows.tolist(), ends, strict=True):
            out[row] = ids[a:b]
            a = b

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return take_ranges(self.piece_bytes, self.piece_at[ids], self.piece_len[ids]).tobytes().decode("utf-8", "replace")


class _Cache:
    """Ids of pre-tokens by hash, in one growing array."""

    def __init__(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, hashes: list[int], ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * (self.used + len(ids)), np.int32)])
        if len(self.slot) + len(hashes) > len(self.at):
            grown = np.zeros(2 * (len(self.slot) + len(hashes)), np.int64)
            self.at, self.n = np.concatenate([self.at, grown]), np.concatenate([self.n, grown])
        base = len(self.slot)
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[base : base + len(n)] = self.used + np.cumsum(n) - n
        self.n[base : base + len(n)] = n
        self.used += len(ids)
        self.slot.update(zip(hashes, range(base, base + len(hashes)), strict=True))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


_caches: dict[str, _Cache] = {}


def _forget() -> None:
    _caches.clear()


def _encode_piece(bpe: ByteBpe, path: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cache = _caches.setdefault(path, _Cache())
    keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    asked = keys.tolist()
    if len(cache.slot) + len(asked) > CACHE_ENTRIES:
        cache = _caches[path] = _Cache()
    unknown = [i for i, h in enumerate(asked) if h not in cache.slot]
    if unknown:
        spans = first[unknown].tolist()
        cache.add([asked[i] for i in unknown], *bpe.encode_many([data[begin[k] : end[k]].tobytes() for k in spans]))
    slot = np.fromiter(map(cache.slot.__getitem__, asked), np.int64, len(asked))[back]
    return take_ranges(cache.ids, cache.at[slot], cache.n[slot]), cache.n[slot]


def _encoded_rows(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, path: str):
    """(ids column of the group, iterator of one array of token ids for each row)."""
    bpe, classes = byte_bpe(path), code_point_classes(path)
    special = next(iter(bpe.special), b"")
    for batch in batches:
        data, at = text_rows(batch, text_col)
        for lo, hi in row_groups(at):
            part, rows = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            ids, total = [np.empty(0, np.int32)], np.zeros(hi - lo + 1, np.int64)
            for a, b in safe_pieces(part, rows, classes):
                own = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)] - a
                begin, end, hashes = pretokens(part[a:b], own, classes, special)
                some, n = _encode_piece(bpe, path, part[a:b], begin, end, hashes)
                ids.append(some)
                row = np.searchsorted(rows, begin + a, "right") - 1
                total[1:] += np.bincount(row, weights=n, minlength=hi - lo).astype(np.int64)
            flat, cut = np.concatenate(ids), np.cumsum(total)
            yield batch.column(id_col)[lo:hi], (flat[cut[i] : cut[i + 1]] for i in range(hi - lo))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, as the library encodes without adding special tokens.

    Pre-tokens are merged by a segment tree whose root holds the leftmost pair of the lowest rank; a task keeps the
    ids of the pre-tokens it has met. The library's special string inside a text is its one id.

    Null and empty texts: an empty list. Repeated rows and null ids: one result row each. Long texts are cut into
    pieces where no pre-token crosses; a long pre-token has a tree of its own, n log n. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, rows in _encoded_rows(batches, id_col, text_col, tokenizer_path):
            yield pa.RecordBatch.from_arrays([names, pa.array(list(rows), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run, _forget), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids, special tokens kept; null and empty lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(lean(run, _forget), f"doc_id {tokens.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one task, without moving the ids.

    Cases as in ``encode``; the digest of the ids is over little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for names, rows in _encoded_rows(batches, id_col, text_col, tokenizer_path):
            out = [(len(ids), sha(ids.astype("<u4").tobytes()), sha(bpe.decode(ids).encode())) for ids in rows]
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run, _forget), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
