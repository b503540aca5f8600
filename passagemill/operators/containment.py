"""Quotes inside texts, without comparing every quote with every text. [C6 B10 B11]"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.bitmaps import bitmap_of, has_bit
from passagemill.functions.text import without_space
from passagemill.sources.scratch import materialize

#: Bytes of a gram: the largest that a quote can hold is used for it. Grams of a quote that stand for it by choice.
GRAMS, CHOICES = (32, 16, 8, 4, 2, 1), 4
#: Bits of the bitmap of all chosen grams: 16 MB.
BITS = 1 << 27
#: Bytes of quotes that are broadcast at most, and bytes of texts that are scanned at once.
BROADCAST_QUOTES, SCANNED = 16 << 20, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(raw: np.ndarray, sizes: tuple[int, ...] = GRAMS) -> dict[int, np.ndarray]:
    """For each size a hash of each run of so many bytes; the same bytes have the same hash anywhere.

    The hash of 2k bytes is made from those of both halves, so all sizes take six passes.
    """
    out, h, k = {}, raw.astype(np.uint64) + np.uint64(1), 1
    while True:
        if k in sizes:
            out[k] = h
        if 2 * k > max(sizes):
            return out
        h = (h[: max(0, len(h) - k)] * _BASE) ^ h[k:] if len(h) > k else h[:0]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        k *= 2


def _chosen(rows: DataFrame) -> DataFrame:
    """(quote_id, k, gram): evenly spread grams of each quote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, gram = [], [], []
            for i, q in enumerate(batch.column("q").to_pylist()):
                raw = np.frombuffer(q.encode(), np.uint8)
                k = next(k for k in GRAMS if k <= len(raw))
                hashes = _gram_hashes(raw)[k]
                some = np.unique(hashes[np.linspace(0, len(hashes) - 1, CHOICES).astype(np.int64)])
                row += [i] * len(some)
                size += [k] * len(some)
                gram.append(some)
            flat = np.concatenate(gram).view(np.int64) if gram else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("quote_id").take(pa.array(row, pa.int64())), pa.array(size, pa.int32()), pa.array(flat)], ["quote_id", "k", "gram"])

    return rows.mapInArrow(run, f"quote_id {rows.schema['quote_id'].dataType.simpleString()}, k int, gram long")


def _occurring(rows: DataFrame, sizes: list[int], wanted: np.ndarray) -> DataFrame:
    """(text_id, gram): the distinct grams of each text that the bitmap lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], [np.empty(0, np.uint64)]
            for t in batch.column("t").to_pylist():
                raw = np.frombuffer((t or "").encode(), np.uint8)
                hashes = _gram_hashes(raw, tuple(sizes)) if sizes else {}
                own = np.concatenate([np.empty(0, np.uint64), *(h[has_bit(shared.value, h % np.uint64(BITS))] for h in hashes.values())])
                found.append(np.unique(own))
                n.append(len(found[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(found).view(np.int64))], ["text_id", "gram"])

    return rows.mapInArrow(run, f"text_id {rows.schema['text_id'].dataType.simpleString()}, gram long")


class _Quotes:
    """A bounded set of quotes with the hashes of CHOICES grams of each, for a scan of texts."""

    def __init__(self, ids: pa.Array, quotes: list[str]) -> None:
        self.ids, self.raw = ids, [q.encode() for q in quotes]
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, raw in enumerate(self.raw):
            k = next(k for k in GRAMS if k <= len(raw))
            hashes = _gram_hashes(np.frombuffer(raw, np.uint8), (k,))[k]
            rows.setdefault(k, []).extend((int(hashes[p]), i, p) for p in sorted(set(np.linspace(0, len(hashes) - 1, CHOICES).astype(np.int64).tolist())))
        self.grams = {}
        for k, every in rows.items():
            every.sort()
            self.grams[k] = tuple(np.array(x, t) for x, t in zip(zip(*every, strict=True), (np.uint64, np.int64, np.int64), strict=True))

    def found(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, quote) of each quote that stands in a row of the bytes ``data`` with the offsets ``at``."""
        hashes, out, raw = _gram_hashes(data, tuple(self.grams)), set(), data.tobytes()
        for k, (keys, quote, offset) in self.grams.items():
            names = np.unique(keys)
            bits = np.zeros(1 << 16, bool)
            bits[(names & np.uint64(0xFFFF)).astype(np.int64)] = True
            spot = np.flatnonzero(bits[(hashes[k] & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(names, hashes[k][spot]), len(names) - 1)
            hit = names[place] == hashes[k][spot]
            spot, place = spot[hit], place[hit]
            order = np.argsort(place, kind="stable")
            spot, n = spot[order], np.bincount(place, minlength=len(names))
            first = np.cumsum(n) - n
            # each quote goes by the one of its grams that stands here least
            own = np.searchsorted(names, keys)
            least = np.lexsort((n[own], quote))
            least = least[np.concatenate([[True], np.diff(quote[least]) != 0])]
            for g in least[n[own[least]] > 0].tolist():
                q, size = int(quote[g]), len(self.raw[quote[g]])
                start = spot[first[own[g]] : first[own[g]] + n[own[g]]] - offset[g]
                row = np.searchsorted(at, start, "right") - 1
                whole = (start >= 0) & (start + size <= at[np.minimum(row + 1, len(at) - 1)])
                for s, r in zip(start[whole].tolist(), row[whole].tolist(), strict=True):
                    if (r, q) not in out and raw[s : s + size] == self.raw[q]:
                        out.add((r, q))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _by_scan(quotes: pa.Table, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id) of a bounded set of quotes: one scan, from which only pairs come."""
    shared = texts.sparkSession.sparkContext.broadcast(_Quotes(quotes["quote_id"].combine_chunks(), quotes["q"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t").cast(pa.large_string())
            if column.null_count:
                column = pc.fill_null(column, "")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SCANNED, "right")) - 1)
                row, quote = shared.value.found(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([shared.value.ids.take(pa.array(quote)), batch.column("text_id").take(pa.array(lo + row))], ["quote_id", "text_id"])
                lo = hi

    kind = {pa.int64(): "long", pa.int32(): "int"}.get(quotes.schema.field("quote_id").type, "string")
    return texts.mapInArrow(run, f"quote_id {kind}, text_id {texts.schema['text_id'].dataType.simpleString()}").distinct()


def containing(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id) for each text that contains a quote, both without white space.

    quotes(quote_id, quote), texts(text_id, text). Up to BROADCAST_QUOTES bytes of quotes (measured) are broadcast and
    looked for in one scan: grams lead to places, and the bytes there decide. More quotes go through a join: a few
    grams of every quote, of a length after its own, are looked for at every place of the texts behind a bitmap of
    fixed size; the one that the fewest texts hold leads from the quote to texts, and ``contains`` decides. Short quotes
    have short grams, so none is compared with every text. Blank quotes match nothing.
    """
    q = quotes.select("quote_id", without_space(F.col("quote")).alias("q")).where("q <> ''")
    t = texts.select("text_id", without_space(F.col("text")).alias("t"))
    q = materialize(q)
    # what a quote takes besides its bytes is CHOICES grams of 24 bytes
    taken = q.agg(F.sum(F.octet_length("q") + 200)).first()[0]
    if (taken or 0) <= BROADCAST_QUOTES:
        return _by_scan(q.toArrow(), t)
    return _by_join(q, t)


def _by_join(q: DataFrame, t: DataFrame) -> DataFrame:
    grams = materialize(_chosen(q))
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # as many as GRAMS at most
    spots = materialize(_occurring(t, sizes, bitmap_of(grams, F.pmod("gram", F.lit(BITS)), BITS)))
    texts_of = spots.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(texts_of, "gram", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram")).alias("x"))
    anchors = rarest.where("x.n > 0").select("quote_id", "x.gram")
    near = spots.join(anchors, "gram").select("quote_id", "text_id").distinct()
    return near.join(q, "quote_id").join(t, "text_id").where(F.contains("t", F.col("q"))).select("quote_id", "text_id").distinct()
