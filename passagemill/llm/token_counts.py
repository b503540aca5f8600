"""Operator 1: token counts by a two-tier map-side lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrowtext import lean, row_groups, text_rows
from .pretokens import code_point_classes, pretokens, safe_pieces

#: Entries of the broadcast table at most: 2^16 keys and lengths in 2^18 slots, 3 MB.
TABLE_ENTRIES = 1 << 16
#: Rows in about which frequent pre-tokens are looked for, and entries that one task may report: 2^13 x 2^9 x 20 bytes.
SAMPLE_ROWS, REPORTED = 1 << 13, 1 << 9
#: Counters of a task, and bytes of the longest pre-token that is counted; longer ones are left to the caches.
COUNTERS, LONGEST = 1 << 14, 256
#: Lengths that a worker keeps for pre-tokens outside the table; beyond, the cache starts anew.
CACHE_ENTRIES = 1 << 19


class LengthTable:
    """Open addressing in two arrays: 64-bit hash of a pre-token → number of tokens; 0 means absent."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        size = 1 << max(4, int(4 * max(1, len(hashes)) - 1).bit_length())
        self.keys, self.lengths, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.uint64(size - 1)
        for h, n in zip(hashes.tolist(), lengths.tolist(), strict=True):
            slot = h & (size - 1)
            while self.keys[slot]:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.lengths[slot] = h, n

    def get(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint32)
        todo = np.arange(len(hashes))
        slot = hashes & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = key == hashes[todo]
            out[todo[hit]] = self.lengths[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out


_tokenizers: dict[str, Tokenizer] = {}
_caches: dict[str, dict[int, int]] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def special_string(path: str) -> str:
    """The added token that the library matches inside texts; these files have one at most."""
    added = _tokenizer(path).get_added_tokens_decoder()
    if len(added) > 1:
        raise ValueError("more than one added token")
    return next((str(t.content) for t in added.values()), "")


def _encoded_lengths(path: str, texts: list[str]) -> list[int]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _batches(batches: Iterator[pa.RecordBatch], column: str, path: str):
    """For each group of rows: batch, rows, and for each piece its first byte, spans and hashes."""
    classes, special = code_point_classes(path), special_string(path).encode()
    for batch in batches:
        data, at = text_rows(batch, column)
        for lo, hi in row_groups(at):
            part, rows = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]

            def pieces(part=part, rows=rows):
                for a, b in safe_pieces(part, rows, classes):
                    own = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)] - a
                    yield a, part[a:b], pretokens(part[a:b], own, classes, special)

            yield batch, lo, hi, rows, pieces()


class Frequent:
    """Misra-Gries counters: with k of them, what makes up more than 1/k of all that came is among them at the end.

    A counter is too low by 1/k of what came at most. ``text`` is kept for the counters only.
    """

    def __init__(self, counters: int = COUNTERS) -> None:
        self.counters, self.count, self.text = counters, {}, {}

    def add(self, hashes: list[int], n: list[int], text) -> None:
        """text(i) is the pre-token of the i-th hash."""
        for i, (h, c) in enumerate(zip(hashes, n, strict=True)):
            if h in self.count:
                self.count[h] += c
            else:
                self.count[h], self.text[h] = c, text(i)
        if len(self.count) > self.counters:
            # taking the (k + 1)-th largest from all counters is so many single steps of the method at once
            spare = sorted(self.count.values(), reverse=True)[self.counters]
            self.count = {h: c - spare for h, c in self.count.items() if c > spare}
            self.text = {h: self.text[h] for h in self.count}


def frequent_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths) of frequent pre-tokens: as they stand in a sample of the rows.

    About ``sample_rows`` rows, chosen by id hash, are counted in tasks; each reports hash, count and length of its
    REPORTED most frequent pre-tokens. No pre-token moves: 20 bytes of each report go to the driver.
    """
    rows = docs.count()
    if not rows or entries <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    share = min(1.0, sample_rows / rows)
    # rows without id are told apart by their text
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent()
        for _, _, _, _, pieces in _batches(batches, text_col, path):
            for _, data, (begin, end, hashes) in pieces:
                some = end - begin <= LONGEST
                begin, end, hashes = begin[some], end[some], hashes[some]
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                seen.add(keys.tolist(), n.tolist(), lambda i, d=data, b=begin[first], e=end[first]: d[b[i] : e[i]].tobytes())
        best = sorted(seen.count, key=lambda h: (-seen.count[h], h))[:REPORTED]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(best, np.uint64).view(np.int64)), pa.array([seen.count[h] for h in best], pa.int64()), pa.array(_encoded_lengths(path, [seen.text[h].decode() for h in best]), pa.int32())], ["hash", "n", "tokens"]
        )

    found = chosen.select(text_col).mapInArrow(lean(count), "hash long, n long, tokens int").toArrow()  # within the bound of the sample
    keys, first, back = np.unique(found["hash"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    total = np.bincount(back, weights=found["n"].to_numpy(), minlength=len(keys))
    best = np.argsort(-total, kind="stable")[:entries]
    return keys[best], found["tokens"].to_numpy()[first][best].astype(np.uint32)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, entries: int = TABLE_ENTRIES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, as the library counts without added special tokens.

    Tier 1 is a broadcast table of the lengths of frequent pre-tokens (``entries`` at most, so its size is fixed),
    found in a bounded sample of rows; tier 2 is a cache in each worker, filled by the library itself. No pre-token is
    shuffled or collected. The table decides only what is looked up where, never a result. A string of the special
    token inside a text counts as one token, as it does in the library.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows, null ids: one result row each. Very long texts are cut
    into pieces at places that no pre-token crosses. Other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(LengthTable(*frequent_lengths(docs, tokenizer_path, id_col, text_col, entries)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cache = table.value, _caches.setdefault(tokenizer_path, {})
        for batch, lo, hi, rows, pieces in _batches(batches, text_col, tokenizer_path):
            tokens = np.zeros(hi - lo, np.int64)
            for a, data, (begin, end, hashes) in pieces:
                n = first.get(hashes).astype(np.int64)
                missed = np.flatnonzero(n == 0)
                if len(missed):
                    keys, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
                    asked = keys.tolist()
                    unknown = [i for i, h in enumerate(asked) if h not in cache]
                    if len(cache) + len(unknown) > CACHE_ENTRIES:
                        cache.clear()
                        unknown = range(len(asked))
                    spans = [missed[where[i]] for i in unknown]
                    found = _encoded_lengths(tokenizer_path, [data[begin[k] : end[k]].tobytes().decode() for k in spans])
                    cache.update(zip((asked[i] for i in unknown), found, strict=True))
                    n[missed] = np.array([cache[h] for h in asked], np.int64)[back]
                row = np.searchsorted(rows, begin + a, "right") - 1
                tokens += np.bincount(row, weights=n, minlength=hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col)[lo:hi], pa.array(np.diff(rows)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(lean(count), out)
