"""Corpora, questions, labels, rankings and event views over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import collapse_space
from passagemill.functions.vectors import hashed_texts
from passagemill.operators import evaluation as ev
from passagemill.operators import search
from passagemill.operators.containment import containing
from passagemill.operators.corpus import chunk_pages
from passagemill.operators.index import Index, build_index
from passagemill.sources.scratch import input_state, materialize, stored

TOP_K, DEPTH = 5, 4

#: Named settings of the experiment matrix: channel, fusion, rerank, rewrite. [I15]
CONFIGS = [
    ("sparse-bm25", "sparse", None, False, False),
    ("sparse-bm25-rerank", "sparse", None, True, False),
    ("dense-hash", "dense", None, False, False),
    ("hybrid-rrf", "hybrid", "rrf", False, False),
    ("hybrid-rrf-weighted", "hybrid", "rrf-bm25-heavy", False, False),
    ("hybrid-rrf-truncate", "hybrid", "rrf-truncate-5", False, False),
    ("hybrid-convex", "hybrid", "convex", False, False),
    ("hybrid-convex-weighted", "hybrid", "convex-bm25-heavy", False, False),
    ("hybrid-convex-weighted-rerank", "hybrid", "convex-bm25-heavy", True, False),
    ("hybrid-rrf-rerank", "hybrid", "rrf", True, False),
    ("hybrid-rrf-rerank-rewrite", "hybrid", "rrf", True, True),
]
#: Expansion rules over words that occur in the test corpus.
RULES = [(1, "th", ["tion"]), (2, "er", ["ing", "ly"]), (3, "an", ["en"]), (4, "re", ["on", "in"])]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text", F.col("source").alias("kb_id"), F.col("lang").alias("version"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_pages(pages(spark, sf), carried=("kb_id", "version"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, text): the first 12 words of each benchmark item."""
    d = table(spark, sf, "benchmark")
    return d.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(collapse_space(F.col("text")), " "), 1, 12), " ").alias("text"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "seq int, trigger string, expansion array<string>")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """(example_id, question, answer, quote, category, should_refuse, mode, hops) by quote containment."""
    items = table(spark, sf, "benchmark")
    hits = containing(items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), pages(spark, sf).select(F.col("document_id").alias("text_id"), "text"))
    asked = questions(spark, sf).select(F.col("query_id").alias("example_id"), F.col("text").alias("question"))
    found = hits.groupBy(F.col("quote_id").alias("example_id")).agg(F.array_sort(F.collect_list("text_id")).alias("docs"))
    d = items.select(F.col("item_id").alias("example_id"), F.col("text").alias("quote")).join(asked, "example_id").join(found, "example_id", "left")
    n = F.coalesce(F.size("docs"), F.lit(0))
    hops = F.coalesce(F.transform("docs", lambda x: F.struct(x.alias("document_id"), F.lit(1).alias("page"), F.col("quote").alias("quote"))), F.array().cast("array<struct<document_id:string,page:int,quote:string>>"))
    return d.select("example_id", "question", F.col("quote").alias("answer"), "quote", F.when(n == 0, "refusal").when(n == 1, "single").otherwise("equivalent").alias("category"), (n == 0).alias("should_refuse"), F.when(n > 1, "any").otherwise("all").alias("mode"), hops.alias("hops"))


def vectors(chunked: DataFrame) -> DataFrame:
    return hashed_texts(chunked, "chunk_id")


def asked_vectors(asked: DataFrame) -> DataFrame:
    return hashed_texts(asked, "query_id")


def channels(asked: DataFrame, chunked: DataFrame, index: Index, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse ranking of the same questions."""
    return search.dense_search(asked_vectors(asked), vectors(chunked), depth), search.sparse_search(asked, index, depth)


def retrieve(asked: DataFrame, chunked: DataFrame, index: Index, mode: str = "hybrid", fusion: str | None = "rrf", rerank: bool = False, rewrite: DataFrame | Callable[[DataFrame], DataFrame] | None = None, k: int = TOP_K, multiplier: int = DEPTH) -> DataFrame:
    """(query_id, chunk_id, score, rank): the whole chain for all questions in one plan. [I5 F2 K5-K9]

    Each channel gives k × multiplier candidates, fusion keeps as many, variants of a question are fused, a reranker
    sees the original question, and what is left after the cut must still score above 0. ``rewrite`` is a table of rules
    or a function from questions to (query_id, variant, text).
    """
    depth = max(k, k * multiplier)
    if rewrite is None:
        expanded = asked.withColumn("variant", F.lit(0))
    else:
        expanded = rewrite(asked) if callable(rewrite) else search.expand(asked, rewrite)
    each = expanded.withColumn("query_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    if mode == "sparse":
        got = search.sparse_search(each, index, depth)
    elif mode == "dense":
        got = search.dense_search(asked_vectors(each), vectors(chunked), depth)
    else:
        dense, sparse = channels(each, chunked, index, depth)
        got = search.fuse(dense, sparse, chunked, search.fusion(fusion or "rrf"), depth)
    parts = F.split("query_id", "#")
    single = got.select(parts[0].cast(asked.schema["query_id"].dataType).alias("query_id"), parts[1].cast("int").alias("variant"), "chunk_id", "score", "rank")
    if rewrite is not None:
        got = search.fuse_variants(single, chunked, depth)
    else:
        got = single.join(chunked.select("chunk_id", "page", "text"), "chunk_id")
    if rerank:
        got = search.rerank_lexical(asked, got, k)
    return got.where((F.col("rank") <= k) & (F.col("score") > 0)).select("query_id", "chunk_id", "score", "rank")


def retrieve_all(asked: DataFrame, chunked: DataFrame, index: Index, rule_rows: DataFrame, configs=CONFIGS, k: int = TOP_K, multiplier: int = DEPTH) -> DataFrame:
    """(config, query_id, chunk_id, score, rank) of every setting; the channels are computed once and shared. [I15]"""
    depth = k * multiplier
    dense, sparse = (materialize(d) for d in channels(asked, chunked, index, depth))
    wide = chunked.select("chunk_id", "page", "text")
    out = []
    for name, mode, how, rerank, rewrite in configs:
        if rewrite:
            got = retrieve(asked, chunked, index, mode, how, rerank, rule_rows, k, multiplier)
        else:
            got = search.fuse(dense, sparse, chunked, search.fusion(how), depth) if mode == "hybrid" else (sparse if mode == "sparse" else dense).join(wide, "chunk_id")
            got = search.rerank_lexical(asked, got, k) if rerank else got
            got = got.where((F.col("rank") <= k) & (F.col("score") > 0))
        out.append(got.select(F.lit(name).alias("config"), "query_id", "chunk_id", "score", "rank"))
    return reduce(DataFrame.unionByName, out)


def default_index(spark: SparkSession, sf: str) -> tuple[DataFrame, Index]:
    """The chunks and their index, as tables that the first query of an application on this input writes for all that follow."""

    def make(path: str) -> None:
        chunks(spark, sf).write.parquet(f"{path}/chunks")
        build_index(spark.read.parquet(f"{path}/chunks")).write(path)

    path = stored(spark, f"index {sf} {input_state(table(spark, sf, 'documents'))}", make)
    return spark.read.parquet(f"{path}/chunks"), Index.read(spark, path)


def sparse_metrics(spark: SparkSession, sf: str, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(example_id, metric, value) of BM25 top 5 over the labelled questions."""
    c, index = default_index(spark, sf)
    top = search.sparse_search(questions(spark, sf), index, TOP_K)
    lists = ev.ranked_lists(top, c).withColumnRenamed("query_id", "example_id")
    return ev.example_metrics(examples(spark, sf), lists, cutoffs)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, ts, path, status, elapsed_s) over the events: values as latency, errors as 500."""
    e = table(spark, sf, "events")
    path = F.concat(F.lit("/api/"), "event_type", F.lit("/"), (F.col("user_id") * 37).cast("string"), F.lit("/x"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), path.alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 10).alias("elapsed_s"))
