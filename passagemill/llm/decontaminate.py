"""Operator 10: benchmark decontamination by winnowed fingerprints and extension to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM_WORDS, gram_hashes, lean, row_groups, take_ranges, text_rows, word_hashes
from .shared import BITMAP_BITS, bitmap_of, has_bit, materialize, with_id

#: Words of a window, of a fingerprint's gram, and grams of which the least is kept: 8 + 6 - 1 = 13, so any shared run
#: of 13 words holds one whole run of 6 grams and with it a fingerprint that both sides keep.
WINDOW, GRAM, KEEP = 13, 8, 6
#: A test set of up to so many windows and item names of so many bytes is broadcast, in arrays of about 30 bytes a window
#: besides the names; a larger one is joined by a shuffle.
BROADCAST_WORDS, BROADCAST_NAMES = 1_000_000, 1 << 24


def winnow(grams: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Places of kept grams: the last least one of every run of KEEP grams of a row.

    grams: of all rows; first: each row's first word and the end; words: in all. Rows of fewer grams keep their least.
    """
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    count = np.maximum(np.diff(first) - GRAM + 1, 0)
    inside = np.zeros(n + KEEP, bool)
    inside[take_ranges(np.arange(words + 1), first[:-1], count)] = True
    value = np.full(n + KEEP, np.iinfo(np.uint64).max)
    value[:n] = grams
    value[~inside] = np.iinfo(np.uint64).max
    least, where = value[:n].copy(), np.arange(n)
    for step in range(1, KEEP):
        # a run that leaves its row ends there, which only adds fingerprints
        on = inside[step : n + step] & inside[:n]
        ahead = value[step : n + step]
        row_ok = on & (ahead <= least)
        least = np.where(row_ok, ahead, least)
        where = np.where(row_ok, np.arange(step, n + step), where)
    full = inside[:n]
    return np.unique(where[full])


class TestSet:
    """Fingerprints, window hashes and the items of each window; sorted arrays."""

    def __init__(self, windows: pa.Table) -> None:
        """windows(item_id, m, hash, is_print) in any order."""
        names = windows["item_id"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.items = names.dictionary.take(order)
        item = place[names.indices.to_numpy()] if len(place) else np.empty(0, np.int64)
        m, keys = windows["m"].to_numpy(), windows["hash"].to_numpy().view(np.uint64)
        is_print = windows["is_print"].to_numpy().astype(bool)
        self.fingerprints = np.unique(keys[is_print])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(m[~is_print]).tolist():
            some = ~is_print & (m == length)
            rows = np.unique(np.rec.fromarrays([keys[some], item[some]], names="key,item"))
            own, at = np.unique(rows["key"], return_index=True)
            self.by_length[length] = own, np.append(at, len(rows)), rows["item"].copy()

    def name(self, item: int) -> str:
        return self.items[item].as_py()


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[i] == x, i


def _near_windows(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold the grams at these words and stay in their row, and the gram of each."""
    row = np.searchsorted(first, at, "right") - 1
    starts = at[:, None] - np.arange(WINDOW - GRAM + 1)
    ok = (starts >= first[row][:, None]) & (starts + WINDOW <= first[row + 1][:, None])
    return starts[ok], np.broadcast_to(np.arange(len(at))[:, None], ok.shape)[ok]


def _item_windows(bench: DataFrame) -> DataFrame:
    """(item_id, m, hash, is_print): an item's window hashes by number of words, and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, "text")
            ids = batch.column("item_id").to_pylist()
            for lo, hi in row_groups(at):
                words, first = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM_WORDS)
                grams = gram_hashes(words, GRAM)
                kept = winnow(grams, first, len(words))
                row = np.searchsorted(first, kept, "right") - 1
                out = [(ids[lo + r], GRAM, int(h.astype(np.int64)), True) for r, h in zip(row.tolist(), grams[kept], strict=True) if first[r + 1] - first[r] >= WINDOW]
                for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a:
                        m = min(WINDOW, b - a)
                        out += [(ids[lo + r], m, int(h), False) for h in gram_hashes(words[a:b], m).view(np.int64)]
                cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "m", "hash", "is_print"])

    return bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null").mapInArrow(lean(run), "item_id string, m int, hash long, is_print boolean")


def _found_rows(covered: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[first[1:]] - total[first[:-1]]


_OUT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _by_broadcast(docs: DataFrame, tests: TestSet) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, at = text_rows(batch, "text")
            for lo, hi in row_groups(at):
                words, first = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM_WORDS)
                covered, hits = np.zeros(len(words) + 1, np.int64), []
                for m, (keys, span, items) in known.by_length.items():
                    grams = gram_hashes(words, m)
                    if m == WINDOW:
                        small = gram_hashes(words, GRAM)
                        kept = winnow(small, first, len(words))
                        starts, _ = _near_windows(kept[_member(known.fingerprints, small[kept])[0]], first)
                        starts = np.unique(starts)
                    else:
                        starts = take_ranges(np.arange(len(words) + 1), first[:-1], np.maximum(np.diff(first) - m + 1, 0))
                    hit, which = _member(keys, grams[starts])
                    starts, which = starts[hit], which[hit]
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + m, -1)
                    row = np.searchsorted(first, starts, "right") - 1
                    for r, w in np.unique(np.stack([row, which], axis=1), axis=0).tolist() if len(row) else ():
                        hits += [(r, i) for i in items[span[w] : span[w + 1]].tolist()]
                n_hit = _found_rows((np.cumsum(covered)[:-1] > 0).astype(np.int64), first)
                found: dict[int, set[str]] = {}
                for r, i in hits:
                    found.setdefault(r, set()).add(known.name(i))
                n_words = np.diff(first)
                names = [found.get(r, ()) for r in range(hi - lo)]
                none = _digest([])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([_digest(list(x)) if x else none for x in names]), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], _OUT
                )

    return docs.mapInArrow(lean(run), with_id(docs, "doc_id", "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))


def _by_join(docs: DataFrame, windows: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """The same over shuffles. A bitmap of the windows' hashes, of a fixed size, lets few other places through.

    One pass writes each row's number of words and the places where a window may stand; only those are joined with the
    test set, and no text moves.
    """
    tests = materialize(windows.where("not is_print").select("m", "hash", "item_id").distinct())
    lengths = sorted(r.m for r in tests.select("m").distinct().collect())  # WINDOW at most
    sieve = lambda kind: docs.sparkSession.sparkContext.broadcast(bitmap_of(windows.where(kind), F.pmod("hash", F.lit(bits)), bits))
    prints, wanted = sieve("is_print"), sieve("not is_print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = lambda bitmap, hashes: has_bit(bitmap.value, hashes.view(np.int64) % bits)
        for batch in batches:
            data, at = text_rows(batch, "text")
            for lo, hi in row_groups(at):
                words, first = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM_WORDS)
                found = []
                for m in lengths:
                    grams = gram_hashes(words, m)
                    if m == WINDOW:
                        small = gram_hashes(words, GRAM)
                        kept = winnow(small, first, len(words))
                        starts = np.unique(_near_windows(kept[maybe(prints, small[kept])], first)[0])
                    else:
                        starts = take_ranges(np.arange(len(words) + 1), first[:-1], np.maximum(np.diff(first) - m + 1, 0))
                    starts = starts[maybe(wanted, grams[starts])]
                    found.append((starts, np.full(len(starts), m), grams[starts]))
                starts, m, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
                order = np.argsort(starts, kind="stable")
                starts, m, hashes = starts[order], m[order], hashes[order]
                row = np.searchsorted(first, starts, "right") - 1
                spots = pa.StructArray.from_arrays([pa.array(starts - first[row], pa.int64()), pa.array(m.astype(np.int32)), pa.array(hashes.view(np.int64))], ["start", "m", "hash"])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spots)], ["doc_id", "n_words", "spots"])

    looked = docs.mapInArrow(lean(run), with_id(docs, "doc_id", "n_words long, spots array<struct<start:long,m:int,hash:long>>"))
    looked = materialize(looked.withColumn("row", F.monotonically_increasing_id()))
    places = looked.select("row", F.explode("spots").alias("p")).select("row", "p.start", "p.m", "p.hash")
    hits = materialize(places.join(tests, ["m", "hash"]).select("row", "start", "m", "item_id"))
    spots = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("row", "item_id").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    whole = looked.select("row", "doc_id", "n_words").join(spots, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return whole.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Windows of 13 words (or a whole shorter item) of the benchmark are looked for in every text: winnowed fingerprints
    of 8-word grams find the places, then the windows around them are compared by the hash of all their words. For
    each length of shorter items that occurs, every gram of that length is a fingerprint. A benchmark of up to
    ``broadcast_words`` windows (counted first, with the bytes of their items' names) is broadcast; a larger one is joined by shuffles.

    Null and empty texts: no words, not contaminated. Items without words or id match nothing. Repeated rows: one
    result row each; repeated items count once. Long texts are hashed in pieces. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = materialize(_item_windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))))
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("item_id")).alias("names")).first()
    if size.n <= broadcast_words and (size.names or 0) <= BROADCAST_NAMES:
        return _by_broadcast(docs, TestSet(windows.toArrow()))  # within the bounds just checked
    return _by_join(docs, windows)
