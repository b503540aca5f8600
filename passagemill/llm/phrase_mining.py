"""Operator 11: phrases whose words stand together more often than chance, counted in a prefix-free parse of all texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.bitmaps import bitmap_of, has_bit

from .arrowtext import PIECE, byte_pieces, gram_hashes, lean, mix, row_groups, span_hashes, take_ranges, text_rows
from .ranks import with_rank
from .shared import BITMAP_BITS, materialize

#: A chunk ends where the hash of the last words is a multiple of this, and after so many words at most.
TRIGGER, LONGEST_CHUNK = 32, 1 << 12
_BREAKS, _BLANKS = [*map(ord, ".,;:!?"), *range(0x0A, 0x0E)], [0x20, 0x09]
_KIND = np.zeros(256, np.uint8)
_KIND[_BLANKS], _KIND[_BREAKS] = 1, 2
_FOLD = np.arange(256).astype(np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GROUP = 1 << 20


class Words:
    """The words of a run of rows: one blank, or a line break where a piece ends, after each in ``data``."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        kind = _KIND[raw]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = at[:-1][at[:-1] < len(raw)]
        first[own] = inside[own]
        goes_on = np.zeros(len(raw), bool)
        goes_on[:-1] = inside[1:] & ~first[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(inside & ~goes_on) + 1
        self.row = np.searchsorted(at, start, "right") - 1
        self.first = np.searchsorted(start, at)
        size = end - start + 1
        self.data = take_ranges(np.append(_FOLD[raw], np.uint8(0)), start, size)
        stop = np.cumsum(size)
        self.begin, self.end = stop - size, stop - 1
        breaks = np.cumsum(np.concatenate([[0], kind == 2]))[start] if len(raw) else np.empty(0, np.int64)
        #: whether a piece starts with the word
        self.opens = np.ones(len(start), bool)
        self.opens[1:] = (breaks[1:] != breaks[:-1]) | (self.row[1:] != self.row[:-1])
        self.data[self.end] = 0x20
        self.data[self.end[:-1][self.opens[1:]]] = 0x0A

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.begin, self.end)

    def texts(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The words a .. b - 1 with what is between them, as strings."""
        start, size = self.begin[a], self.end[b - 1] - self.begin[a]
        at = np.concatenate([[0], np.cumsum(size)])
        return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(take_ranges(self.data, start, size)))


def chunk_spans(hashes: np.ndarray, first: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, last of its row) of the chunks of all rows.

    A row is cut where the hash of ``overlap`` words is a multiple of TRIGGER, and where a chunk would get longer than
    LONGEST_CHUNK; a chunk goes on to the end of the words at which the next one starts, so chunks overlap by
    ``overlap`` words. A run of up to overlap + 1 words that starts before the overlap lies in that chunk alone.
    """
    n = len(hashes)
    begin, stop = first[:-1], first[1:]
    row_end = np.repeat(stop, stop - begin)
    cut = np.zeros(n, bool)
    grams = gram_hashes(hashes, overlap)
    cut[: len(grams)] = grams % np.uint64(TRIGGER) == 0
    cut &= np.arange(n) + overlap <= row_end
    cut[begin[stop > begin]] = True
    a = np.flatnonzero(cut)
    long = np.flatnonzero(np.diff(np.append(a, n)) > LONGEST_CHUNK)
    if len(long):
        more = [np.arange(a[i] + LONGEST_CHUNK, (a[i + 1] if i + 1 < len(a) else n), LONGEST_CHUNK) for i in long.tolist()]
        more = np.concatenate(more)
        cut[more[more + overlap <= row_end[more]]] = True
        a = np.flatnonzero(cut)
    end = row_end[a] if len(a) else a
    last = np.ones(len(a), bool)
    last[:-1] = row_end[a[1:]] != end[:-1]
    end = end.copy()
    end[:-1] = np.where(last[:-1], end[:-1], a[1:] + overlap)
    return a, end, last


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of all texts and how often each stands in the parse.

    What is cut depends on the words alone, so passages that repeat give the same chunks, which become one row. ``last``
    marks those that end a text, where the overlap belongs to the chunk itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_rows(batch, text_col)
            langs = pc.fill_null(batch.column("lang"), "und")
            for lo, hi in row_groups(at, _GROUP):
                part, rows = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                # longer texts are parted where a piece ends
                for a, b in byte_pieces(_KIND == 2, part, max(PIECE, _GROUP)):
                    low, high = np.searchsorted(rows, a, "right") - 1, np.searchsorted(rows, b)
                    own = np.clip(rows[low : high + 1], a, b) - a
                    words = Words(part[a:b], own)
                    s, e, last = chunk_spans(words.hashes(), words.first, max(1, longest - 1))
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lo + low + words.row[s])), words.texts(s, e).cast(pa.string()), pa.array(last)], ["lang", "chunk", "last"])

    rows = docs.select(F.col(text_col), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(lean(run), "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("n"))


def _chunks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch, its words, a hash of each row's language, each word's chunk, and whether runs that start there are counted."""
    for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in row_groups(text_rows(b, "chunk")[1], _GROUP)):
        data, at = text_rows(batch, "chunk")
        words = Words(data, at)
        names = batch.column("lang").dictionary_encode()
        seeds = np.array([int.from_bytes(x.as_py().encode(), "little") % (1 << 64) for x in names.dictionary], np.uint64)
        own = np.diff(words.first) - np.where(batch.column("last").to_numpy(zero_copy_only=False), 0, overlap)
        counted = np.arange(len(words.row)) < (words.first[:-1] + own)[words.row]
        yield batch, words, mix(seeds)[names.indices.to_numpy()], words.row, counted


def _runs(words: Words, seeds: np.ndarray, counted: np.ndarray, m: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash with the language) of the counted runs of m words within a piece."""
    n = len(words.row) - m + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.cumsum(words.opens)
    i = np.flatnonzero(counted[:n] & (inside[:n] == inside[m - 1 :]))
    return i, mix(gram_hashes(hashes, m)[i] ^ seeds[words.row[i]])


def _word_counts(parsed: DataFrame, overlap: int) -> DataFrame:
    """(lang, phrase, n) of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, _, row, counted in _chunks(batches, overlap):
            i = np.flatnonzero(counted)
            yield _totals(batch, words, row, i, 1)

    return _summed(parsed.mapInArrow(lean(run), _PHRASES))


_PHRASES = "lang string, phrase string, n long"


def _totals(batch: pa.RecordBatch, words: Words, row: np.ndarray, i: np.ndarray, m: int) -> pa.RecordBatch:
    """Equal runs of a batch as one row with the sum of their chunks' frequencies."""
    at = pa.array(row[i])
    t = pa.table([batch.column("lang").take(at), words.texts(i, i + m), batch.column("n").take(at)], ["lang", "phrase", "n"])
    t = t.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).combine_chunks()
    t = t.set_column(1, "phrase", t["phrase"].cast(pa.string()))
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["lang", "phrase", "n"])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, least: int) -> np.ndarray:
    """A bitmap of the hashes that reach ``least``; its size is bounded, so that with many of them more others pass."""
    kept = materialize(counts.where(F.col("n") >= least).select("hash"))
    bits = max(1 << 12, min(BITMAP_BITS, 1 << (16 * kept.count()).bit_length()))
    return bitmap_of(kept, F.pmod("hash", F.lit(bits)), bits)


def _hash_counts(parsed: DataFrame, overlap: int, sizes: tuple[int, ...], part: int, parts: np.ndarray) -> DataFrame:
    """(hash, n) of runs of the given sizes, of which all runs of ``part`` words are in the bitmap ``parts``."""
    shared = parsed.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, seeds, row, counted in _chunks(batches, overlap):
            times, found = batch.column("n").to_numpy(), []
            for i, h in _passing(words, seeds, counted, sizes, part, shared.value):
                found.append((h, times[row[i]]))
            every = np.concatenate([h for h, _ in found])
            order = np.argsort(every, kind="stable")
            keys, first = np.unique(every[order], return_index=True)
            n = np.add.reduceat(np.concatenate([t for _, t in found])[order], first) if len(keys) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["hash", "n"])

    return parsed.mapInArrow(lean(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _passing(words: Words, seeds: np.ndarray, counted: np.ndarray, sizes: tuple[int, ...], part: int, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, first words and hashes of the runs of which all runs of ``part`` words are in the bitmap."""
    hashes, bits = words.hashes(), np.uint64(len(parts) * 64)
    every = np.ones(len(words.row), bool)
    known = np.zeros(len(words.row), bool)
    i, h = _runs(words, seeds, every, part, hashes)
    known[i[has_bit(parts, h % bits)]] = True
    for m in sizes:
        i, h = _runs(words, seeds, counted, m, hashes)
        on = np.ones(len(i), bool)
        for k in range(m - part + 1):
            on &= known[i + k]
        yield i[on], h[on]


def _phrase_counts(parsed: DataFrame, overlap: int, sizes: tuple[int, ...], frequent: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, n) of the runs whose hashes are in the bitmap of their size."""
    shared = parsed.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, seeds, row, counted in _chunks(batches, overlap):
            hashes = words.hashes()
            for m, bitmap in zip(sizes, shared.value, strict=True):
                i, h = _runs(words, seeds, counted, m, hashes)
                yield _totals(batch, words, row, i[has_bit(bitmap, h % np.uint64(len(bitmap) * 64))], m)

    return _summed(parsed.mapInArrow(lean(run), _PHRASES))


def phrase_counts(docs: DataFrame, least: int, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all runs of 1 .. longest words with n >= least, (lang, n) of all words).

    Runs are counted in the distinct chunks of the parse, each times the chunk's frequency; a run in an overlap is
    counted in one of both chunks. A run can't be more frequent than the runs within it, so pairs are counted where
    both words are frequent, and longer runs where all pairs are: first by hash, which may only let too many through,
    then exactly by their words.
    """
    parsed, overlap = materialize(parse(docs, text_col, lang_col, longest)), max(1, longest - 1)
    words = materialize(_word_counts(parsed, overlap))
    common = words.where(F.col("n") >= least)
    out = [common]
    if longest > 1:
        pairs = _frequent(_hash_counts(parsed, overlap, (2,), 1, _words_bitmap(common)), least)
        rest = tuple(range(3, longest + 1))
        longer = [_frequent(_hash_counts(parsed, overlap, rest, 2, pairs), least)] * len(rest) if rest else []
        out.append(_phrase_counts(parsed, overlap, (2, *rest), [pairs, *longer]).where(F.col("n") >= least))
    return materialize(reduce(DataFrame.unionByName, out)), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _words_bitmap(common: DataFrame) -> np.ndarray:
    """The bitmap of frequent words, hashed as tasks hash them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = lambda b: pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase"), pa.array(np.ones(b.num_rows, bool))], ["lang", "chunk", "last"])
        for _, words, seeds, _, counted in _chunks(map(more, batches), 0):
            _, h = _runs(words, seeds, counted, 1, words.hashes())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.ones(len(h), np.int64))], ["hash", "n"])

    return _frequent(common.select("lang", "phrase").mapInArrow(lean(run), "hash long, n long"), 1)


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    A phrase of 2 .. longest words that stands at least ``least`` times is scored at each cut by
    floor(1000 * a * n / (l * r)) with the counts of itself, both parts and all words of the language; its least score
    counts, ties to the earliest cut. Phrases that a longer candidate holds as often are dropped. Sums and products
    are decimals of 38 digits, so they are exact up to counts of 10^12. Ranks: score and a falling, then the phrase in byte order.

    Null and empty texts hold no words; rows without language are of language ``und``. Repeated rows count as often as
    they stand. Empty tables and tables without a frequent phrase give no rows. Long texts are parted where a piece
    ends. Other columns are not read. A hot text, line or phrase is added up in tasks before anything moves.
    """
    known, size = phrase_counts(docs, least, longest, text_col, lang_col)
    split = F.split("phrase", " ")
    cand = materialize(known.withColumn("words", F.size(split)).where("words > 1"))
    # of phrases that hold one just as often there is always one with a single word more
    shorter = lambda a, b: F.array_join(F.slice(split, a, b), " ")
    inner = cand.where("words > 2").select("lang", F.explode(F.array(shorter(F.lit(1), F.col("words") - 1), shorter(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("n").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    free = cand.join(inner, ["lang", "phrase"], "left").where("held is null or held < n").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("*", shorter(F.lit(1), F.col("k")).alias("left"), shorter(F.col("k") + 1, F.col("words")).alias("right"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(size), "lang")  # a row for each language
    scored = both.withColumn("score", F.expr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # a first cut in parts of each language, so that no task gets a whole one
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    some = least_cut.withColumn("place", F.row_number().over(parts)).where(F.col("place") <= top)
    order = [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")]
    return with_rank(some, order, group="lang").where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
