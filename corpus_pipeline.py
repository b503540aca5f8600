"""Cleaning of a document table in stages, each one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns what goes to the next; the last returns tokens. Stages judge rows,
not ids: rows without id, or of a repeated id, go or stay by their own text. Stages bound the session's Arrow batches,
as their results are read later; ``run`` puts the session's setting back. No stage writes the texts besides its result:
the small tables of keys and scores stay for who reads a stage's result and go when the driver ends, or in ``run`` as
soon as the result is written. ORACLE_SQL is None: learned scores, languages and tokens have no
SQL, so tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import language_id, toxicity
from passagemill.llm.byte_bpe import round_trip
from passagemill.llm.decontaminate import decontaminate
from passagemill.llm.held_out import fold
from passagemill.llm.near_duplicates import near_duplicates
from passagemill.llm.queries import tokenizer_path
from passagemill.llm.shared import bounded_batches, discard, materialize, split_by_bitmap
from passagemill.operators.quantiles import at_ranks, disc
from passagemill.sources.scratch import noted

#: Names within a stage: the whole row, and its key where rows are told apart.
ROW, KEY = "_row", "_key"
#: Share of the documents that name a language whose cosines lie at the cut or below it.
ODD = 0.001


def _with_rows(docs: DataFrame, *more: str) -> DataFrame:
    """(whole row, text, *more): operators hand the row on as the id, so that it meets its own verdict and nothing is joined."""
    return docs.select(F.struct("*").alias(ROW), "text", *more)


def _whole(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under the threshold. Labels of the fold that op9 holds out are not used."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    return _whole(toxicity.score(_with_rows(docs), toxicity.learn(docs, labels), id_col=ROW).where("predicted = 0"))


def _cuts(known: DataFrame) -> list[tuple[int, float]]:
    """(size, cut) of known(size, score), the largest size first: the cosine at ODD of each run of sizes, at least that of all rows.

    A cosine grows with the distinct n-grams it rests on, so the cosine at ODD of all rows is that of the shortest texts,
    and longer ones in no known language are above it. A run has more than 1 / ODD rows, so that no single one is its cut;
    sizes that are left, the smallest, take that of all. Sizes are powers of two, so few rows come to the driver.
    """
    starts, n = [], 0
    for r in sorted(known.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += r.n
        if n * ODD > 1:
            starts.append(r["size"])
            n = 0
    run = F.coalesce(*(F.when(F.col("size") >= at, at) for at in starts), F.lit(-1))
    both = known.select(F.explode(F.array_distinct(F.array(run, F.lit(-1)))).alias("start"), "score")
    found = {r.start: r.cut for r in at_ranks(both, "score", {"cut": disc(ODD)}, ("start",)).collect()}
    return sorted(((at, max(cut, found[-1])) for at, cut in found.items()), reverse=True)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the language that they name or, where they name none, in one of those that documents name.

    Those without a letter go. A text is in a language if its cosine is above the cut: that of the farthest ODD of the
    documents that name a language, of all and of those with as many distinct n-grams; exact order statistics over all
    of these, so single odd rows don't move them (where there are more than 1 / ODD), and wrong names don't either, as
    the nearest language counts whatever is named. Of documents that name no language those in no language go. Of those
    that name one those in another one, and not in their own, go; where the text is in none, its name is believed.
    Where no document names a language, letters alone decide.
    """
    bounded_batches(spark)
    names, _ = model = language_id.learn(docs)
    size = F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int")
    known = materialize(language_id.predict(docs.where("lang is not null"), model, id_col="lang").where("n_letters > 0").select(size.alias("size"), "score"))
    cuts = _cuts(known) if names and not known.isEmpty() else []
    judged = language_id.predict(_with_rows(docs, "lang"), model, id_col=ROW, named_col="lang").where("n_letters > 0")
    if not cuts:
        return _whole(judged)
    cut = F.coalesce(*(F.when(size >= at, value) for at, value in cuts))
    found, own = F.col("score") > cut, F.coalesce(F.col("named_score") > cut, F.lit(False))
    return _whole(judged.where(F.when(F.col("doc_id.lang").isNull(), found).otherwise(own | ~found)))


def _drop(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """The whole rows of rows(_row, _key) without those whose key is among refused(doc_id), which holds row keys here.

    Rows that the bitmap of refused keys does not let through are surely kept and don't move; the others are joined.
    """
    keys = materialize(refused.select(F.col("doc_id").alias("_refused")))
    doubtful, kept = split_by_bitmap(rows, KEY, keys, "_refused")
    return kept.unionByName(doubtful.join(keys, F.col(KEY) == F.col("_refused"), "left_anti")).select(f"{ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; rows without id come last.

    Rows are told apart by a hash of id and text, so that no text is written a second time; docs is read several times
    and has to give the same rows each time. Of rows alike in both, the first one as JSON stays.
    """
    bounded_batches(spark)
    # a digest first: texts of a pattern don't collide
    rows = docs.select(F.struct("*").alias(ROW), F.xxhash64("doc_id", F.md5(F.col("text").cast("binary"))).alias(KEY))
    with noted() as made:
        of_rows = near_duplicates(rows.select(KEY, f"{ROW}.text"), id_col=KEY).where("n_shingles > 0")
        groups = materialize(of_rows.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    discard(*(t for t in made if t is not groups))
    own = rows.groupBy(F.col(KEY).alias("key")).agg(F.min(f"{ROW}.doc_id").alias("own"))
    order = F.struct(F.col("own").isNull().alias("nameless"), "own", F.col("doc_id").alias("first"))
    named = groups.join(own, F.col("doc_id") == F.col("key"))
    first = materialize(named.groupBy("component_id").agg(F.min(order)["first"].alias("first")).select("first"))
    # by key, not by group: a large group is dealt over all tasks
    refused = groups.join(first, F.col("doc_id") == F.col("first"), "left_anti").select("doc_id")
    again = materialize(groups.where("n > 1").join(first, F.col("doc_id") == F.col("first"), "left_semi").select("doc_id"))
    kept = _drop(rows, refused.unionByName(again))
    if again.isEmpty():
        return kept
    likely, _ = split_by_bitmap(rows, KEY, again, "doc_id")
    once = likely.groupBy(KEY).agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW)).join(again, F.col(KEY) == F.col("doc_id"), "left_semi")
    return kept.unionByName(once.select(f"{ROW}.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    bounded_batches(spark)
    return _whole(decontaminate(_with_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).where("not contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left."""
    return round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again before the next, then deleted."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for _, stage in STAGES[:-1]:
            with noted() as made:
                out = materialize(stage(spark, docs, sf_dir))
            discard(docs, *(t for t in made if t is not out))
            docs = out
    finally:
        spark.conf.set(conf, before)
    return STAGES[-1][1](spark, docs, sf_dir)
