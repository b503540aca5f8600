"""Channel rankings, their fusion, expansion and reranking, for all questions at once. [C1-C4 D4-D7 E1-E3 F1-F3 G1 H5 H6 I1-I5]

A ranking is (query_id, chunk_id, score, rank). Scores are kept to 1e-12 so that the order of additions can't change
a rank: contributions are added as whole numbers of 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import collapse_space, terms
from passagemill.sources.scratch import materialize

from .index import K1, B, Index

UNIT = 1e12
#: So many questions at most are broadcast against the vectors; more go block by block.
BROADCAST_QUERIES = 50_000
#: So many bytes of asked terms at most are broadcast against the postings.
BROADCAST_TERMS = 32 << 20
#: Tasks over which a term is dealt out where the terms are not broadcast.
SALTS = 32
#: Rows of the first block of a task, and of any: the k-th best of the first ones bounds the next.
_FIRST_ROWS, _MOST_ROWS = 1 << 8, 1 << 12


@dataclass(frozen=True)
class Fusion:
    """How the dense and the sparse ranking combine. [D7]"""

    method: str = "rrf"
    dense: float = 1.0
    sparse: float = 1.0
    truncate: int | None = None
    k: int = 60


FUSIONS = {
    "rrf": Fusion(),
    "rrf-bm25-heavy": Fusion(dense=0.3, sparse=0.7),
    "rrf-truncate-5": Fusion(truncate=5),
    "convex": Fusion(method="convex"),
    "convex-bm25-heavy": Fusion(method="convex", dense=0.3, sparse=0.7),
}


def fusion(name: str) -> Fusion:
    if name not in FUSIONS:
        raise ValueError(f"unknown fusion {name!r}; known: {', '.join(sorted(FUSIONS))}")
    return FUSIONS[name]


def _ranked(scored: DataFrame, k: int | None, *ties: str) -> DataFrame:
    """Positive scores ranked within a query; the first k. [E1 F1 K1 K4]"""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("chunk_id",)))
    out = scored.where("score > 0").withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def _asked_terms(queries: DataFrame, index: Index) -> tuple[DataFrame, bool]:
    """((query_id, scope, term, idf, avgdl) of the asked terms that the index has, whether they may be broadcast)."""
    scope = F.col("scope") if "scope" in queries.columns else F.lit("all")
    asked = queries.select("query_id", scope.alias("scope"), F.explode(terms(F.col("text"))).alias("term"))
    # statistics of the asked terms only: the semi join goes below the count of documents
    stats = index.terms.join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi")
    known = materialize(asked.join(stats, ["scope", "term"]).join(F.broadcast(index.corpus.select("scope", "avgdl")), "scope").select("query_id", "scope", "term", "idf", "avgdl"))
    # 64 bytes for the numbers and what a row takes besides
    taken = known.agg(F.sum(64 + sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("query_id", "scope", "term")))).first()[0]
    return known, (taken or 0) <= BROADCAST_TERMS


def sparse_scores(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, score): BM25 over all chunks that hold a query term. [C1 C2 D4]

    queries(query_id, text[, scope]). The asked terms with their statistics are written once and measured. Up to
    BROADCAST_TERMS bytes they are broadcast: postings of other terms go in the scan, what is left is dealt out by chunk,
    and pairs are made and summed where their chunk is, so a posting moves once however many questions ask for it and no
    pair moves. Beyond that both sides meet by term and a part of the chunk's hash, so a frequent term is dealt out over
    SALTS tasks, and pairs are summed with map-side combine.
    """
    return _all_scores(*_asked_terms(queries, index), index)


def _all_scores(known: DataFrame, small: bool, index: Index) -> DataFrame:
    postings = index.postings
    if small:
        known = F.broadcast(known)
        hits = postings.join(known, ["scope", "term"], "left_semi").repartition("chunk_id").join(known, ["scope", "term"])
    else:
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
        hits = salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["scope", "term", "salt"])
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg((F.sum(F.round(part * UNIT).cast("long")) / UNIT).alias("score"))


class _Asked:
    """The asked terms as arrays: pairs of (question, term), and for each term its weight and mean length."""

    def __init__(self, known: pa.Table) -> None:
        names = known["query_id"].combine_chunks().dictionary_encode()
        self.names, self.question = names.dictionary, names.indices.to_numpy()
        key = pc.binary_join_element_wise(known["scope"].cast(pa.string()), known["term"], "\0").combine_chunks().dictionary_encode()
        self.keys, self.term = key.dictionary, key.indices.to_numpy()
        self.idf, self.avgdl = np.zeros(len(self.keys)), np.ones(len(self.keys))
        self.idf[self.term], self.avgdl[self.term] = known["idf"].to_numpy(), known["avgdl"].to_numpy()
        order = np.lexsort((self.term, self.question))
        self.question, self.term = self.question[order], self.term[order]

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, contribution in units of 1e-12) of each asked term of each row, by row and term."""
        lists = batch.column("tf")
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        held = pc.binary_join_element_wise(batch.column("scope").take(pa.array(row)), flat.field("term"), "\0")
        term = pc.index_in(held, value_set=self.keys)
        hit = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
        row, term = row[hit], pc.fill_null(term, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
        tf, dl = flat.field("tf").to_numpy(zero_copy_only=False)[hit], batch.column("dl").to_numpy(zero_copy_only=False)[row]
        part = self.idf[term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / self.avgdl[term]))
        order = np.lexsort((term, row))
        return row[order], term[order], np.floor(part * UNIT + 0.5)[order]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _block_scores(asked: _Asked, row: np.ndarray, term: np.ndarray, part: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(question, row, score, pairs made) of a block of rows: all that may reach ``least``, the k-th best of each question.

    The largest contribution of each term in the block bounds what a question can get there. Terms of a question that
    together stay below its k-th best can't bring a row in: candidates come from the other terms alone, and a question
    without any has none. Candidates then get the contributions of all terms of their question.
    """
    most = np.zeros(len(asked.keys))
    np.maximum.at(most, term, part)
    by_term = np.argsort(term, kind="stable")
    first, n = np.searchsorted(term[by_term], np.arange(len(asked.keys))), np.bincount(term, minlength=len(asked.keys))
    held = np.flatnonzero(n[asked.term] > 0)
    question, own = asked.question[held], asked.term[held]
    order = np.lexsort((most[own], question))
    question, own = question[order], own[order]
    upto = np.cumsum(most[own])
    start = np.searchsorted(question, question)
    upto -= np.where(start > 0, upto[start - 1], 0.0)
    brings = upto >= least[question]
    q, t = question[brings], own[brings]
    at = by_term[_ranges(first[t], n[t])]
    pair = np.unique(np.repeat(q, n[t]) * np.int64(1 << 32) + row[at])
    made = int(n[t].sum())
    q, r = pair >> 32, pair & ((1 << 32) - 1)
    # each candidate's terms are looked up among the row's
    low, high = np.searchsorted(asked.question, q), np.searchsorted(asked.question, q, "right")
    candidate = np.repeat(np.arange(len(pair)), high - low)
    key, wanted = row * np.int64(len(asked.keys)) + term, r[candidate] * np.int64(len(asked.keys)) + asked.term[_ranges(low, high - low)]
    place = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
    score = np.bincount(candidate, weights=np.where(key[place] == wanted, part[place], 0.0) if len(key) else None, minlength=len(pair))
    kept = score >= least[q]
    return q[kept], r[kept], score[kept], made


def _best_sparse(known: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, chunk_id, score, made, every): the k best of each task, and a row for each task with the numbers of pairs."""
    table = known.toArrow()
    asked_kind, kind = known.schema["query_id"].dataType, index.rows.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", asked_kind), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType()), T.StructField("made", T.LongType()), T.StructField("every", T.LongType())])
    if not table.num_rows:
        return known.sparkSession.createDataFrame([], schema)
    shared = known.sparkSession.sparkContext.broadcast(_Asked(table))  # within BROADCAST_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, made, every, step = _Best(len(asked.names), k), 0, 0, _FIRST_ROWS
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, step)
                row, term, impact = asked.impacts(part)
                every += int(np.bincount(term, minlength=len(asked.keys))[asked.term].sum())
                q, r, score, n = _block_scores(asked, row, term, impact, best.least)
                made += n
                best.put(q, score, part.column("chunk_id").take(pa.array(r)))
                best.cut()  # so that the next block meets the k-th best so far
                lo, step = lo + step, min(2 * step, _MOST_ROWS)
        found = best.cut()
        n = len(found)
        names = asked.names.take(pa.array(found["question"].to_numpy(np.int64)))
        numbers = lambda x: pa.array([None] * n + [x], pa.int64())
        end = lambda a, kind: pa.concat_arrays([a.cast(kind), pa.nulls(1, kind)])
        yield pa.RecordBatch.from_arrays(
            [end(names, names.type), end(_ids(found["id"], kind), _arrow(kind)), end(pa.array(found["score"].to_numpy(np.float64) / UNIT), pa.float64()), numbers(made), numbers(every)], ["query_id", "chunk_id", "score", "made", "every"]
        )

    scopes = known.select("scope").distinct()
    rows = index.rows.join(F.broadcast(scopes), "scope", "left_semi")  # within the bound of the asked terms
    return rows.select("scope", "chunk_id", "dl", "tf").mapInArrow(run, schema)


def sparse_search(queries: DataFrame, index: Index, k: int | None) -> DataFrame:
    """The k best chunks of each question by BM25, ties in chunk id order. [I1]

    Asked terms within BROADCAST_TERMS meet the tokenised rows where these lie: a task adds up block by block what may
    still reach its k best of a question, and hands these on. Without k, or with more terms, all pairs are scored.
    """
    known, small = _asked_terms(queries, index)
    if k is None or not small or index.rows is None:
        return _ranked(_all_scores(known, small, index), k)
    return _ranked(_best_sparse(known, index, k).where("made is null").select("query_id", "chunk_id", "score"), k)


def sparse_pairs(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(every, made): pairs of a question and a posting of one of its terms, and those of them that ``sparse_search`` makes."""
    known, small = _asked_terms(queries, index)
    if not small:
        raise ValueError("more asked terms than may be broadcast")
    return _best_sparse(known, index, k).agg(F.coalesce(F.sum("every"), F.lit(0)).alias("every"), F.coalesce(F.sum("made"), F.lit(0)).alias("made"))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int | None, normalized: bool = False, digits: int = 12) -> DataFrame:
    """The k best vectors of each question by cosine, rounded to ``digits``; ties in chunk id order. [C3 F3 I2]

    queries(query_id, vector), vectors(chunk_id, vector). The questions are the stated side: they are broadcast in
    blocks of BROADCAST_QUERIES, each a matrix that tasks multiply with their vectors. A task hands on the k best of
    each question. ``normalized``: both sides have length 1, so the dot product is the cosine.
    """
    return _ranked(_nearest(queries, vectors, k, normalized, digits), k)


def _matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles; lists of different length are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.list_value_length(column)
    width = pc.max(length).as_py() or 0
    if column.null_count or (len(column) and pc.min(length).as_py() != width):
        raise ValueError("vectors of different dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


class _Best:
    """The k best of each question among all that came: pairs wait in a buffer that is cut down when it is full."""

    def __init__(self, questions: int, k: int | None) -> None:
        self.k, self.least, self.parts, self.size = k, np.full(questions, -np.inf), [], 0

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        """score: (ids, questions); 0 and less is no match."""
        at, question = np.nonzero((score > 0) & (score >= self.least))
        self.parts.append(pd.DataFrame({"question": question, "score": score[at, question], "id": ids.take(pa.array(at)).to_pandas()}))
        self.size += len(at)
        if self.k is not None and self.size > _BUFFER:
            self.cut()

    def put(self, question: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Single pairs."""
        self.parts.append(pd.DataFrame({"question": question, "score": score, "id": ids.to_pandas()}))
        self.size += len(question)

    def cut(self) -> pd.DataFrame:
        every = pd.concat(self.parts) if self.parts else pd.DataFrame({"question": [], "score": [], "id": []})
        if self.k is not None:
            every = every.sort_values(["question", "score", "id"], ascending=[True, False, True]).groupby("question", sort=False).head(self.k)
            last = every.groupby("question", sort=False)["score"].agg(["size", "min"])
            full = last[last["size"] >= self.k]
            self.least[full.index.to_numpy(np.int64)] = full["min"].to_numpy()
        self.parts, self.size = [every], len(every)
        return every


#: Pairs that wait in a task, and cells of a matrix product.
_BUFFER, _CELLS = 1 << 19, 1 << 21


def _nearest(queries: DataFrame, vectors: DataFrame, k: int | None, normalized: bool, digits: int) -> DataFrame:
    """(query_id, chunk_id, score): candidates with the k best of each question."""
    n = queries.count()
    blocks = max(1, -(-n // BROADCAST_QUERIES))
    asked_kind, kind = queries.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", asked_kind), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType())])
    out = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vector").toArrow()  # about a block
        asked = _matrix(own["vector"])
        length = np.linalg.norm(asked, axis=1)
        shared = vectors.sparkSession.sparkContext.broadcast((own["query_id"].combine_chunks(), asked, length))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked, length = shared.value
            best, step = _Best(len(asked), k), max(1, _CELLS // max(1, len(asked)))
            for batch in batches:
                every = _matrix(batch.column("vector"))
                for lo in range(0, len(every) if len(asked) else 0, step):
                    own = every[lo : lo + step]
                    if own.shape[1] != asked.shape[1]:
                        raise ValueError("vectors of different dimension")
                    score = own @ asked.T
                    if not normalized:
                        size = np.linalg.norm(own, axis=1)[:, None] * length
                        score = np.where(size == 0, 0.0, score / np.where(size == 0, 1.0, size))
                    best.add(np.round(score, digits), batch.column("chunk_id").slice(lo, step))
            found = best.cut()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found["question"].to_numpy(np.int64))), _ids(found["id"], kind), pa.array(found["score"].to_numpy(np.float64))], ["query_id", "chunk_id", "score"])

        out.append(vectors.select("chunk_id", "vector").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, out)


def _ids(column: pd.Series, kind: T.DataType) -> pa.Array:
    """Ids as one Arrow array; pandas may keep strings in several chunks."""
    out = pa.array(column, _arrow(kind))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _arrow(kind: T.DataType) -> pa.DataType:
    """Arrow's type of an id."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def fuse(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, how: Fusion, k: int) -> DataFrame:
    """(query_id, chunk_id, score, best_rank, rank, page, text): both rankings combined, the first k. [C4 D5 D6 E2 E3 G1 I3]

    Page and text, which break ties, are joined to the fused candidates only.
    """
    channels = dense.select("*", F.lit(how.dense).alias("weight"), F.lit(0).alias("channel")).unionByName(sparse.select("*", F.lit(how.sparse).alias("weight"), F.lit(1).alias("channel")))
    if how.truncate:
        channels = channels.where(F.col("rank") <= how.truncate)
    if how.method == "rrf":
        part = F.col("weight") / (how.k + F.col("rank"))
    else:
        own = Window.partitionBy("query_id", "channel")
        low, high = F.min("score").over(own), F.max("score").over(own)
        part = F.col("weight") * F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))
    fused = channels.withColumn("part", part).groupBy("query_id", "chunk_id").agg((F.sum(F.round(F.col("part") * UNIT).cast("long")) / UNIT).alias("score"), F.min("rank").alias("best_rank"))
    return cut(fused, chunks, k)


def cut(fused: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Final ranks: score, best channel rank, page, text, chunk id last. [E3 K2]"""
    full = fused.join(chunks.select("chunk_id", "page", "text"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "page", "text", "chunk_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "best_rank", "rank", "page", "text")


def rerank_lexical(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """0.7 of the min-max normalised score plus 0.3 of the share of query terms in the passage; stable. [H6 K9]

    candidates(query_id, chunk_id, score, rank, page, text); queries(query_id, text) are the original questions.
    """
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    base = F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))
    asked = queries.select("query_id", terms(F.col("text")).alias("asked"))
    share = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", terms(F.col("text")))) / F.size("asked"))
    scored = candidates.join(asked, "query_id").withColumn("new", F.round(base * 0.7 + share * 0.3, 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("new"), "rank")
    out = scored.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    return out.select("query_id", "chunk_id", F.col("new").alias("score"), F.col("at").alias("rank"), "page", "text")


def rerank_with(candidates: DataFrame, scorer, k: int) -> DataFrame:
    """Order by a caller's pair scorer: pandas (question, text) → scores; ties by page and text. [M2 M4]

    candidates(query_id, question, chunk_id, score, page, text). Where the scorer returns null the retrieval score
    stands in and the row is marked degraded.
    """

    def run(frames):
        for pdf in frames:
            yield pdf.assign(own=scorer(pdf["question"], pdf["text"]))

    scored = candidates.mapInPandas(run, candidates.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", own double")
    scored = scored.withColumn("degraded", F.col("own").isNull()).withColumn("new", F.coalesce("own", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("new"), "page", "text", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("new").alias("score"), "rank", "degraded")


def embed_with(texts: DataFrame, embed, text_col: str = "text") -> DataFrame:
    """(text, vector) of the distinct texts by a caller's function list[str] → list[vector]; join back on text. [M1 G5 K21]"""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(vector=list(embed(pdf["text"].tolist())))

    return texts.select(F.col(text_col).alias("text")).where("text is not null").distinct().mapInPandas(run, "text string, vector array<double>")


MOST_RULES = 10_000


def expand(queries: DataFrame, rules: DataFrame, variants: int = 3) -> DataFrame:
    """(query_id, variant, text): the question and up to variants - 1 expansions, by rules in order. [H5 G2 M3]

    rules(seq, trigger, expansion array). Rules are few by nature (a hand-written table), questions many. The rules are
    broadcast; a table of more than ``MOST_RULES`` is refused.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} expansion rules")
    plain = queries.select("query_id", collapse_space(F.col("text")).alias("text"))
    hit = plain.join(F.broadcast(rules), F.contains(plain.text, rules.trigger))
    first = Window.partitionBy("query_id").orderBy("seq")
    more = hit.withColumn("variant", F.row_number().over(first)).where(F.col("variant") < variants).select("query_id", "variant", F.concat_ws(" ", "text", F.array_join("expansion", " ")).alias("text"))
    every = plain.select("query_id", F.lit(0).alias("variant"), "text").unionByName(more).where("text <> ''")
    return every.groupBy("query_id", "text").agg(F.min("variant").alias("variant")).select("query_id", "variant", "text")


def fuse_variants(rankings: DataFrame, chunks: DataFrame, k: int, rank_k: int = 60) -> DataFrame:
    """(query_id, ...): rankings(query_id, variant, chunk_id, score, rank) of a question's variants as one. [I4 K8]

    A single variant keeps its scores; several are fused by equal reciprocal ranks.
    """
    many = rankings.groupBy("query_id").agg((F.max("variant") > F.min("variant")).alias("several"))
    part = F.when(F.col("several"), F.round(UNIT / (rank_k + F.col("rank"))).cast("long")).otherwise(F.round(F.col("score") * UNIT).cast("long"))
    fused = rankings.join(many, "query_id").withColumn("part", part).groupBy("query_id", "chunk_id").agg((F.sum("part") / UNIT).alias("score"), F.min("rank").alias("best_rank"))
    return cut(fused, chunks, k)
