"""Operator 12: exact top-k by inner product, dimension block by dimension block with bounds on what is left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import lean

#: Queries that are broadcast together, at 8 bytes a component; more go in blocks, each a scan of the table.
QUERY_BLOCK = 1 << 14
#: Dimensions that are added up between two bounds, and candidates that a task holds in columns at once.
DIMENSIONS, COLUMNS = 8, 1 << 13
#: Tables of more rows are first searched in a part of them, one row of PART, for thresholds.
SMALL, PART = 1 << 12, 16
_NO_ID = np.iinfo(np.int64).max
_SCHEMA = "q int, query_id long, own long, vec_id long, score long"


def whole_vectors(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components floor(scale * x) as doubles in ``width`` columns).

    Null vectors and vectors that hold a null or a number that is not finite are left out. Shorter vectors are filled
    up with zeros; components beyond ``width`` are let go, as they meet zeros.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    sound = np.bincount(row[~np.isfinite(flat)], minlength=len(lengths)) == 0
    sound &= pc.is_valid(column).to_numpy(zero_copy_only=False)
    width = int(lengths[sound].max(initial=0)) if width is None else width
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, some = np.zeros((len(lengths), width)), sound[row] & (place < width)
    out[row[some], place[some]] = np.floor(scale * flat[some])
    return np.flatnonzero(sound), out[sound]


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False)


def _exact(queries: np.ndarray, columns: np.ndarray) -> np.dtype:
    """The narrowest kind of number in which no inner product is rounded."""
    largest = max(np.abs(queries).max(initial=0), 1) * max(np.abs(columns).max(initial=0), 1) * max(1, len(columns))
    return np.dtype(np.float64) if largest < 2**53 else np.dtype(np.int64) if largest < 2**62 else np.dtype(object)


class _Block:
    """Queries with the mass that is left after each block of dimensions, and the k-th best (score, id) of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.left = _mass_left(vectors.T)
        self.own = [sum(int(x) ** 2 for x in v) for v in vectors] if np.abs(vectors).max(initial=0) >= 2**24 else (vectors**2).sum(1).astype(np.int64).tolist()
        self.least: list[tuple[int, int] | None] = [None] * len(ids)


def _mass_left(columns: np.ndarray) -> np.ndarray:
    """(blocks, n): the length of what is left of each column from the start of each block of dimensions on."""
    with np.errstate(over="ignore"):
        squares = np.add.reduceat(np.square(columns.astype(np.float64)), np.arange(0, len(columns), DIMENSIONS), axis=0) if len(columns) else np.zeros((0, columns.shape[1]))
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > 8 * k and score.dtype != object:
        kept = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[kept], ids[kept]
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-score[order], kind="stable")][:k]
    return score[order], ids[order]


def survivors(query: np.ndarray, left: np.ndarray, columns: np.ndarray, rest: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, inner products) of the columns that may reach ``least``; the others fell to a bound on the way.

    columns: (dimensions, candidates). After each block of dimensions the sum so far and the product of what is left
    of both lengths (Cauchy-Schwarz, widened against rounding) bound the inner product from above; the candidates
    under ``least`` are taken out, so later blocks are added for ever fewer.
    """
    alive = None
    total = np.zeros(columns.shape[1], columns.dtype)
    for b in range(len(rest)):
        if least > -np.inf:
            mass = rest[b] if alive is None else rest[b][alive]
            on = np.flatnonzero(np.asarray(total, np.float64) + left[b] * mass * (1 + 1e-9) + 1 >= least)
            if len(on) < len(total):
                alive, total = on if alive is None else alive[on], total[on]
        part = columns[b * DIMENSIONS : (b + 1) * DIMENSIONS]
        total = total + query[b * DIMENSIONS : (b + 1) * DIMENSIONS] @ (part if alive is None else part[:, alive])
    return np.arange(columns.shape[1]) if alive is None else alive, total


def _scan(vectors: DataFrame, block: _Block, scale: int) -> DataFrame:
    """_SCHEMA: the k best of each task for each query of the block, as far as they reach the block's thresholds."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        k, found, least = block.k, [(np.empty(0), np.empty(0, np.int64))] * len(block.ids), list(block.least)
        for batch in batches:
            for lo in range(0, batch.num_rows, COLUMNS):
                part = batch.slice(lo, COLUMNS)
                rows, matrix = whole_vectors(part.column("v"), scale, block.vectors.shape[1])
                ids, columns = _ids(part.column("id"))[rows], np.ascontiguousarray(matrix.T)
                rest, kind = _mass_left(columns), _exact(block.vectors, columns)
                columns, queries = _as(columns, kind), _as(block.vectors, kind)
                for j in range(len(queries) if len(ids) else 0):
                    near = least[j]
                    at, score = survivors(queries[j], block.left[:, j], columns, rest, -np.inf if near is None else float(near[0]) * (1 - 1e-12 * np.sign(near[0])))
                    if near is not None and len(at):
                        on = (score > near[0]) | ((score == near[0]) & (ids[at] <= near[1]))
                        at, score = at[on], score[on]
                    if len(at):
                        old = found[j]
                        found[j] = s, i = _best(np.concatenate([old[0].astype(score.dtype) if score.dtype == object else old[0], score]), np.concatenate([old[1], ids[at]]), k)
                        if len(s) == k and (near is None or (s[-1], -i[-1]) > (near[0], -near[1])):
                            least[j] = (int(s[-1]), int(i[-1]))
        q = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        score = [max(-(2**63), min(2**63 - 1, int(x))) for s, _ in found for x in s]
        ids = np.concatenate([i for _, i in found]) if found else np.empty(0, np.int64)
        own = [min(2**63 - 1, x) for x in block.own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(block.ids[q]), pa.array([own[x] for x in q], pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(score, pa.int64())], ["q", "query_id", "own", "vec_id", "score"]
        )

    return vectors.mapInArrow(lean(run), _SCHEMA)


def _as(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(values) if kind == object and values.size else values.astype(kind)


def _search(vectors: DataFrame, block: _Block, rows: int, scale: int) -> DataFrame:
    """The block's results of every task. Thresholds come from parts of the table, the smallest part first.

    A part is chosen by id hash, one row of PART of the next larger one, down to about SMALL rows. The k-th best of a
    part is a bound that the k best of all surely reach, so about k * PART rows of each query come out of a scan,
    however many tasks it has. Tasks put the k best of a part in order; the driver gets k of each query of the block.
    """
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    levels = 0
    while rows // PART**levels > SMALL:
        levels += 1
    for level in range(levels, 0, -1):
        share = PART**level
        part = vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).repartition(max(8, rows // share // SMALL))
        best = _scan(part, block, scale).withColumn("n", F.row_number().over(order)).where(F.col("n") == block.k).select("q", "score", F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"))
        for r in best.collect():  # one row of each query of the block
            if r.score > -(2**63):  # which may stand for less
                block.least[r.q] = (r.score, r.id)
    return _scan(vectors, block, scale)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every other row.

    ``queries`` are rows of ``vectors`` (a stated set; it goes in blocks of QUERY_BLOCK). Components are
    floor(scale * x). Ties go to the smaller id, null ids last. Tasks hold candidates in columns of components and
    add them up block by block of dimensions, taking out what can't reach the k-th best any more (``survivors``).

    Null vectors, and vectors with a null or not finite component, are neither query nor candidate. Each query row has
    results of its own, also where ids repeat or are null; one row that equals the query in id and score, which is
    itself, is left out. Vectors of different length meet as if the shorter one went on with zeros. Fewer than k other
    rows: all of them. Empty tables: no rows. Sums are exact; a score beyond 64 bits is shown as the nearest long, and
    ties among such go by id. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n, total = asked.count(), rows.count()
    blocks, out = max(1, -(-n // QUERY_BLOCK)), []
    deal = F.pmod(F.xxhash64("id", F.to_json("v")), F.lit(blocks))
    for b in range(blocks):
        own = asked.where(deal == b).toArrow().combine_chunks() if blocks > 1 else asked.toArrow().combine_chunks()
        column = own["v"].combine_chunks() if isinstance(own["v"], pa.ChunkedArray) else own["v"]
        at, matrix = whole_vectors(column, scale)
        ids = own["id"].to_numpy(zero_copy_only=False) if not own["id"].null_count else _ids(own["id"].combine_chunks())
        if len(at):
            out.append(_rank(_search(rows, _Block(ids[at].astype(np.int64), matrix, k + 1), total, scale), k))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The k best of what tasks found of each query, without the query's own row."""
    found = found.withColumn("query_id", F.nullif(F.col("query_id"), F.lit(_NO_ID)))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    itself = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    d = found.withColumn("n", F.count(F.lit(1)).over(order)).withColumn("before", F.count_if(itself).over(order))
    d = d.where(~(itself & (F.col("before") == 1))).withColumn("rank", (F.col("n") - F.least(F.col("before"), F.lit(1))).cast("int"))
    return d.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
