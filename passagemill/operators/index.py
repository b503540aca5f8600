"""The inverted index as tables. [D1 D2 D3 A13 I23 K10]"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import tokens
from passagemill.sources.scratch import materialize

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    """postings(scope, term, chunk_id, tf, dl), terms(scope, term, df, idf), corpus(scope, n, avgdl), rows (``tokenised``).

    ``rows`` and the counts are what is kept; postings and idf follow from them.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    rows: DataFrame | None = None

    def write(self, path: str) -> None:
        """Rows and counts as tables below ``path``; ``read`` needs nothing else."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.terms.select("scope", "term", "df").write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.select("scope", "n", "total").write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return _index(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "terms", "corpus")))


def _index(rows: DataFrame, counts: DataFrame, totals: DataFrame) -> Index:
    """An index of tokenised rows, (scope, term, df) and (scope, n, total)."""
    corpus = totals.withColumn("avgdl", F.col("total") / F.col("n"))
    return Index(postings_of(rows), _with_idf(counts, corpus), corpus, rows)


def tokenised(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, chunk_id, dl, tf array<struct<term, tf>>): each chunk's tokens, counted within its row. [D1]

    Equal terms stand side by side once the tokens are sorted, so no token is shuffled.
    """
    rows = chunks.select((F.lit("all") if scope is None else scope).cast("string").alias("scope"), "chunk_id", F.array_sort(tokens(F.col("text"))).alias("t"))
    rows = rows.withColumn("dl", F.size("t"))
    t, n = F.col("t"), F.col("dl")
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    rows = rows.withColumn("at", starts)
    counted = F.zip_with("at", F.concat(F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), F.array("dl")), lambda a, b: F.struct(F.get(t, a).alias("term"), (b - a).alias("tf")))
    # without tokens the end stands alone
    return rows.select("scope", "chunk_id", "dl", F.filter(counted, lambda x: x["tf"].isNotNull()).alias("tf"))


def postings_of(rows: DataFrame) -> DataFrame:
    """(scope, term, chunk_id, tf, dl) of tokenised rows.

    ``explode`` would let the optimizer put a test of the array's size below the counting and count anew for it; the
    outer form gives one null for a chunk without tokens, which goes after it.
    """
    return rows.select("scope", "chunk_id", "dl", F.explode_outer("tf").alias("x")).where("x is not null").select("scope", "x.term", "chunk_id", "x.tf", "dl")


def term_frequencies(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, term, chunk_id, tf, dl). [D1]"""
    return postings_of(tokenised(chunks, scope))


def corpus_stats(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, n, avgdl). [D2]"""
    rows = chunks.select((F.lit("all") if scope is None else scope).cast("string").alias("scope"), F.size(tokens(F.col("text"))).alias("dl"))
    return _stats(rows)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def _with_idf(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    sizes = corpus.select("scope", "n")
    return counts.join(F.broadcast(sizes), "scope").select("scope", "term", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def term_stats(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(scope, term, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5)). [D3]"""
    return _with_idf(_counts(postings), corpus)


def build_index(chunks: DataFrame, scope: Column | None = None) -> Index:
    """Index of chunks(chunk_id, text, ...): tokenised once, written, and read for postings and all statistics.

    Statistics are kept for each scope (one row each, so broadcast).
    """
    rows = materialize(tokenised(chunks, scope))
    return _index(rows, _counts(postings_of(rows)), _totals(rows))


def updated(index: Index, removed: DataFrame, added: DataFrame, scope: Column | None = None) -> Index:
    """The index without the chunks of removed(chunk_id) and with the chunks added(chunk_id, text, ...). [A13 I23]

    Only chunks that come or go are tokenised or taken apart: their terms count +1 and -1, their lengths are added to
    and taken from the totals, and these signed rows are summed with the counts that are there. A chunk that changes is
    removed and added. Ids that the index doesn't have are passed over; a term that no chunk holds any more goes, and a
    scope without chunks too.
    """
    ids = removed.select("chunk_id").distinct()
    gone, new = materialize(index.rows.join(ids, "chunk_id", "left_semi").select("scope", "chunk_id", "dl", "tf")), materialize(tokenised(added, scope))
    sign = lambda d, n: d.select("*", F.lit(n).cast("long").alias("sign"))
    delta = sign(gone, -1).unionByName(sign(new, 1))
    terms = delta.select("scope", F.explode_outer("tf.term").alias("term"), F.col("sign").alias("df")).where("term is not null")
    counts = index.terms.select("scope", "term", "df").unionByName(terms).groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = index.corpus.select("scope", "n", "total").unionByName(delta.select("scope", F.col("sign").alias("n"), (F.col("sign") * F.col("dl")).alias("total")))
    totals = sizes.groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    rows = index.rows.join(ids, "chunk_id", "left_anti").select("scope", "chunk_id", "dl", "tf").unionByName(new)
    return _index(rows, materialize(counts), materialize(totals))
