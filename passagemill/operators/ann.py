"""Approximate nearest neighbours by an inverted file: cells, 8-bit residual codes, exact distances of what is left. [F4]"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.vectors import dot
from passagemill.sources.scratch import materialize

from .search import BROADCAST_QUERIES, _arrow, _matrix, _ranked, dense_search

#: Rows on which cells, code ranges and the number of probes are learned, at most about so many, chosen by id hash.
SAMPLE_ROWS = 1 << 16
#: Cells at most, sampled rows for each cell at least, and held-out questions of the sample.
CELLS, ROWS_PER_CELL, HELD_OUT = 1 << 12, 24, 256
_LEVELS, _BUFFER, _CELLS_OF_PRODUCT = 255, 1 << 19, 1 << 21


@dataclass(frozen=True)
class Cells:
    """Learned on the sample: unit centers, the range of residuals in each dimension, probed cells that reach the recall."""

    centers: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int
    recall: float

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, the nearest first."""
        near = vectors @ self.centers.T
        n = min(n, len(self.centers))
        best = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)


@dataclass(frozen=True)
class AnnIndex:
    """cells, codes(cell, chunk_id, code, wide, same) in the order of cells, vectors(chunk_id, vector) of length 1."""

    cells: Cells
    codes: DataFrame
    vectors: DataFrame
    rows: int


def _assigned(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, (1 << 24) // max(1, len(centers)))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.argmax(x[lo : lo + step] @ centers.T, axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def learn_cells(vectors: DataFrame, k: int = 10, recall: float = 0.95, sample_rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 5) -> tuple[Cells, int]:
    """(Cells, number of vectors): spherical k-means on a bounded sample, with the probes that reach ``recall`` there.

    vectors(chunk_id, vector) of length 1. The number of cells grows with the square root of the table up to CELLS,
    as far as the sample fills them. Probes: held-out rows of the sample are asked, and the fewest cells are taken
    that hold the given share of their true k nearest in the sample; neighbours in the whole table are nearer, so
    they need no more.
    """
    rows = vectors.count()
    share = min(1.0, sample_rows / max(1, rows))
    own = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
    x = _matrix(own.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vector").toArrow()["vector"])  # within the bound of the sample
    if not len(x):
        return Cells(np.zeros((1, x.shape[1])), np.zeros(x.shape[1]), np.ones(x.shape[1]), 1, 1.0), rows
    n = int(max(1, min(CELLS, 2 * rows**0.5, len(x) // ROWS_PER_CELL)))
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), n, replace=False))]
    for _ in range(rounds):
        at = _assigned(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        centers = np.where((np.linalg.norm(total, axis=1) > 0)[:, None], _unit(total), centers)
    at = _assigned(x, centers)
    rest = x - centers[at]
    low, high = rest.min(axis=0), rest.max(axis=0)
    margin = 0.25 * (high - low) + 1e-6  # for vectors outside the sample; beyond, codes are cut and marked
    step = (high - low + 2 * margin) / _LEVELS
    asked = rng.choice(len(x), min(HELD_OUT, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    depth = max(1, min(k, len(x) - 1))
    true = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    order = np.argsort(np.argsort(-(x[asked] @ centers.T), axis=1), axis=1)
    place = np.sort(np.take_along_axis(order, at[true], axis=1).ravel())
    probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
    return Cells(centers, low - margin, step, probes, float((place < probes).mean())), rows


def build_ann(vectors: DataFrame, k: int = 10, recall: float = 0.95, sample_rows: int = SAMPLE_ROWS) -> AnnIndex:
    """The inverted file of all vectors: each row's cell and the 8-bit codes of what its center leaves.

    Codes take a byte a dimension, a quarter or an eighth of the vectors. They are written by ranges of (cell, id), so a
    hot cell lies in many files, and a scan for some cells passes over the others.
    """
    vectors = materialize(vectors)
    cells, rows = learn_cells(vectors, k, recall, sample_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)  # CELLS x dimensions numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = _matrix(batch.column("vector"))
            at = _assigned(x, c.centers)
            level = np.rint((x - c.centers[at] - c.low) / c.step)
            code = np.clip(level, 0, _LEVELS).astype(np.uint8)
            wide = (level != code).any(axis=1)  # a code was cut, so no bound holds: always compared by the vector
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("chunk_id"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(wide), batch.column("same")], ["cell", "chunk_id", "code", "wide", "same"])

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    codes = vectors.select("chunk_id", "vector", F.xxhash64("vector").alias("same")).mapInArrow(run, f"cell int, chunk_id {kind}, code binary, wide boolean, same long")
    return AnnIndex(cells, materialize(codes.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")), vectors, rows)


class _Near:
    """Candidates of each question within the error of the codes below its k-th best so far."""

    def __init__(self, questions: int, k: int, slack: np.ndarray) -> None:
        self.k, self.slack, self.least, self.parts, self.size = k, slack, np.full(questions, -np.inf), [], 0

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, always: np.ndarray, same: np.ndarray) -> None:
        at, q = np.nonzero((score >= self.least[who]) | always[:, None])
        self.parts.append((who[q], score[at, q], ids[at], always[at], same[at]))
        self.size += len(at)
        if self.size > _BUFFER:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, score, ids, always, same = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        # of equal vectors the k with the smallest ids can be among the k nearest; ids come in order within a cell
        order = np.lexsort((ids, same, q))
        new = np.ones(len(order), bool)
        new[1:] = (same[order[1:]] != same[order[:-1]]) | (q[order[1:]] != q[order[:-1]])
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[nth < self.k]
        order = order[np.lexsort((-score[order], q[order]))]
        q, score, ids, always, same = q[order], score[order], ids[order], always[order], same[order]
        first, n = np.searchsorted(q, np.arange(len(self.least))), np.bincount(q, minlength=len(self.least))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1] - self.slack[full])
        kept = (score >= self.least[q]) | always
        self.parts, self.size = [(q[kept], score[kept], ids[kept], always[kept], same[kept])], int(kept.sum())
        return self.parts[0]


def _candidates(queries: pa.Table, index: AnnIndex, k: int, probes: int) -> DataFrame:
    """(query_id, chunk_id, score, slack, always): what may be among the k nearest, by the codes of the probed cells."""
    names, asked = queries["query_id"].combine_chunks(), _unit(_matrix(queries["vector"]))
    near = index.cells.nearest(asked, probes)
    cell, who = near.ravel(), np.repeat(np.arange(len(asked)), near.shape[1])
    order = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(len(index.cells.centers) + 1))
    # half a step in every dimension on either side, of both scores that are compared
    slack = np.abs(asked) @ index.cells.step + 1e-9
    shared = index.codes.sparkSession.sparkContext.broadcast((names, asked, who[order], bounds, slack, index.cells))
    kind = index.codes.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", _spark(names.type)), T.StructField("chunk_id", kind), *(T.StructField(c, T.DoubleType()) for c in ("score", "slack")), T.StructField("always", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, who, bounds, slack, cells = shared.value
        best, ids, base = _Near(len(asked), k, slack), [], 0
        for batch in batches:
            at, n = batch.column("cell").to_numpy(), batch.num_rows
            ids.append(batch.column("chunk_id"))
            wide, same = batch.column("wide").to_numpy(zero_copy_only=False), batch.column("same").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
            for lo, hi in _runs(at):
                some = who[bounds[at[lo]] : bounds[at[lo] + 1]]
                step = max(1, _CELLS_OF_PRODUCT // max(1, len(some)))
                for a in range(lo, hi if len(some) else lo, step):
                    b = min(hi, a + step)
                    rebuilt = cells.centers[at[lo]] + cells.low + code[a:b] * cells.step
                    best.add(some, rebuilt @ asked[some].T, np.arange(base + a, base + b), wide[a:b], same[a:b])
            base += n
        q, score, place, always, _ = best.cut()
        every = pa.chunked_array(ids, ids[0].type) if ids else pa.chunked_array([], _arrow(kind))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), every.take(pa.array(place)).combine_chunks(), pa.array(score), pa.array(slack[q]), pa.array(always)], ["query_id", "chunk_id", "score", "slack", "always"])

    codes = index.codes
    probed = np.unique(cell)
    if len(probed) < len(index.cells.centers):
        codes = codes.where(F.col("cell").isin(probed.tolist()))
    return codes.select("cell", "chunk_id", "code", "wide", "same").mapInArrow(run, schema)


def _runs(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(cells)) + 1
    yield from zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(cells)]]).tolist(), strict=True) if len(cells) else ()


def _spark(kind: pa.DataType) -> T.DataType:
    return {pa.int64(): T.LongType(), pa.int32(): T.IntegerType()}.get(kind, T.StringType())


def ann_search(queries: DataFrame, index: AnnIndex, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest of each question by cosine within its ``probes`` nearest cells.

    queries(query_id, vector). Within the probed cells the result is exact: codes only pick who may still be among
    the k nearest, given how far a rebuilt vector may be off, and these are compared by their vectors. A question with
    fewer than k candidates of positive cosine is compared with every vector.

    Questions go in blocks of BROADCAST_QUERIES with their cells; a task reads codes in the order of cells and
    multiplies each cell with the questions that probe it. No pair moves that the codes rule out.
    """
    if not index.rows:
        return dense_search(queries, index.vectors, k)
    found = materialize(_ranked(_exact(*_survivors(queries, index, k, probes)), k))
    full = found.where(F.col("rank") == k).select("query_id")
    rest = materialize(queries.join(full, "query_id", "left_anti"))
    if rest.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(dense_search(rest, index.vectors, k))


def approximate_search(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) over an index made for this search; keep one by ``build_ann`` to ask it again."""
    return ann_search(queries, build_ann(vectors, k, recall), k, probes)


def _survivors(queries: DataFrame, index: AnnIndex, k: int, probes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs whose codes reach the k-th best of their question within the slack, with the questions and the vectors."""
    blocks = max(1, -(-queries.count() // BROADCAST_QUERIES))
    parts = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vector").toArrow()  # about a block
        if own.num_rows:
            parts.append(_candidates(own, index, k, probes or index.cells.probes))
    kind = queries.schema["query_id"].dataType.simpleString()
    none = queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id {index.codes.schema['chunk_id'].dataType.simpleString()}, score double, slack double, always boolean")
    pairs = materialize(reduce(DataFrame.unionByName, parts) if parts else none)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    least = pairs.withColumn("n", order).where(F.col("n") == k).select("query_id", (F.col("score") - F.col("slack")).alias("least"))
    kept = pairs.join(least, "query_id", "left").where("least is null or score >= least or always").select("query_id", "chunk_id")
    return kept, queries, index.vectors


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    asked = queries.select("query_id", F.col("vector").alias("asked"))
    both = pairs.join(asked, "query_id").join(vectors.select("chunk_id", "vector"), "chunk_id")
    size = F.sqrt(dot(F.col("asked"), F.col("asked")))
    score = F.when(size == 0, 0.0).otherwise(dot(F.col("asked"), F.col("vector")) / size)
    return both.select("query_id", "chunk_id", F.round(score, 12).alias("score"))


def ann_report(queries: DataFrame, vectors: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(questions, vectors, cells, probes, recall, code_share, exact_share): what the index finds and what that takes.

    ``recall`` is measured against ``dense_search`` over the same questions; ``code_share`` is the share of all pairs
    that were compared by their codes, ``exact_share`` of those that were compared by their vectors.
    """
    index = build_ann(vectors, k, recall)
    exact = dense_search(queries, index.vectors, k).select("query_id", "chunk_id")
    near = ann_search(queries, index, k).select("query_id", "chunk_id", F.lit(1).alias("found"))
    hit = exact.join(near, ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    sizes = {r.cell: r.n for r in index.codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    asked = queries.select("vector").toArrow()  # a report is for a stated set of questions
    cells = index.cells.nearest(_unit(_matrix(asked["vector"])), index.cells.probes)
    n = len(cells)
    scored = sum(sizes.get(c, 0) for c in cells.ravel().tolist()) / max(1, n * index.rows)
    survivors = _survivors(queries, index, k)[0].agg((F.count(F.lit(1)) / max(1, n * index.rows)).alias("exact_share"))
    shown = [F.lit(n).alias("questions"), F.lit(index.rows).alias("vectors"), F.lit(len(index.cells.centers)).alias("cells"), F.lit(index.cells.probes).alias("probes")]
    return hit.crossJoin(survivors).select(*shown, F.round("recall", 4).alias("recall"), F.lit(round(scored, 4)).alias("code_share"), F.round("exact_share", 4).alias("exact_share"))  # one row each
