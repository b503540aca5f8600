"""Operator 13: resampling of documents by importance weights over hashed word n-grams of a target."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM_WORDS, lean, row_groups, take_ranges, text_rows, word_spans
from .ranks import with_rank

_GROUP = 1 << 18  # bytes of rows that are handled at once
_LONG = 64  # bytes; longer spans are taken one by one
_MAX_INT = float(1 << 32)


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of spans of bytes, a byte of all spans at a time; long spans one by one."""
    length = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    todo, at = np.flatnonzero((length > 0) & (length <= _LONG)), 0
    while len(todo):
        c = out[todo]
        out[todo] = _CRC[(c ^ data[start[todo] + at]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        at += 1
        todo = todo[length[todo] > at]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def _features(data: np.ndarray, at: np.ndarray, most: int, buckets: int, across: bool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of 1 .. most words of each row, runs of a length at a time.

    ``across``: None all runs, True only those that go over a line break.
    """
    low, start, end, first = word_spans(data, at, ALNUM_WORDS)
    n = len(start)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if most > 1:
        # words with one space after each
        size = end - start + 1
        joined = take_ranges(np.append(low, np.uint8(0)), start, size)
        stop = np.cumsum(size)
        joined[stop - 1] = 0x20
        begin, stop = stop - size, stop - 1
        line = np.cumsum(np.concatenate([[0], data == 0x0A]))[start]
    else:
        joined, begin, stop, line = low, start, end, None
    for m in range(1, most + 1):
        if n < m:
            return
        here = row[: n - m + 1] == row[m - 1 :]
        if across:
            here &= (line[: n - m + 1] != line[m - 1 :]) if m > 1 else False
        i = np.flatnonzero(here)
        yield row[i], span_crcs(joined, begin[i], stop[i + m - 1]) % np.uint32(buckets)


def _counted(rows: DataFrame, text_col: str, weight_col: str | None, most: int, buckets: int, across: bool) -> DataFrame:
    """(bucket, n): features of the rows, each row counted ``weight_col`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = text_rows(batch, text_col)
            times = batch.column(weight_col).to_numpy() if weight_col else np.ones(batch.num_rows, np.int64)
            for lo, hi in row_groups(at, _GROUP):
                for row, bucket in _features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], most, buckets, across):
                    order = np.argsort(bucket, kind="stable")
                    some, first = np.unique(bucket[order], return_index=True)
                    if len(some):
                        total[some] += np.add.reduceat(times[lo:hi][row[order]], first)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return rows.mapInArrow(lean(run), "bucket long, n long")


def bucket_counts(docs: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Line breaks part words, so texts are cut into lines: equal lines of all texts become one row with its number of
    occurrences, the features within are hashed once and multiplied. Runs of words over a line break, which there are
    for ``most`` over 1 only, are counted in their texts and added. ``buckets`` numbers come to the driver.
    """
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    found = _counted(lines, "line", "times", most, buckets, False)
    if most > 1:
        found = found.unionByName(_counted(docs.select(text_col), text_col, None, most, buckets, True))
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of both smoothed shares) of each bucket."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: weight is the floored mean of the gains of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            data, at = text_rows(batch, text_col)
            for lo, hi in row_groups(at, _GROUP):
                rows = hi - lo
                n, total, words = np.zeros(rows, np.int64), np.zeros(rows, np.int64), None
                for row, bucket in _features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], most, len(gain)):
                    one = np.bincount(row, minlength=rows)
                    words = one if words is None else words
                    n += one
                    filled = np.flatnonzero(one)
                    if len(filled):
                        total[filled] += np.add.reduceat(gain[bucket], (np.cumsum(one) - one)[filled])
                words = np.zeros(rows, np.int64) if words is None else words
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[lo:hi], pa.array(words, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Features are runs of 1 .. most words, hashed into buckets. A bucket's gain tells how much more often the target
    has it; a document's weight is the mean gain of its features. Adding Gumbel noise to log weights and taking the
    highest draws without replacement in proportion to the weights: ``percent`` of the documents of ``least_words``
    or more, ranks over the whole table by ``with_rank``.

    Null and empty texts: no features, weight 0, never drawn. Null ids: the noise of an empty id, last among ties.
    Repeated rows: one result row each. An empty target has the smoothed counts alone. No drawable row: no ranks.
    Very long texts are handled alone. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, text_col, most, buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.ln(-F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / _MAX_INT)))
    scored = weights(docs, gain, id_col, text_col, most).withColumn("score", (F.col("weight") + noise).cast("long"))
    barred = (F.col("n_words") < least_words).alias("barred")
    ranked = with_rank(scored.withColumn("barred", barred), [F.asc("barred"), F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = ranked.where("not barred").count() * percent // 100
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
