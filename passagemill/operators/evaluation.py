"""Labels to targets, rankings to metrics, metrics to run summaries. [A15-A17 C7 C10-C15 D8-D14 I6-I24]"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import metrics as M
from passagemill.functions.text import without_space, without_titles

from .quantiles import MEDIAN, disc, with_ranks


def targets(examples: DataFrame) -> DataFrame:
    """examples plus ``hops``: the listed evidence, else the single label, none for a refusal. [I6 C15]

    examples(example_id, should_refuse, evidence array<struct<document_id, page, quote>>, document_id, page, quote).
    """
    one = F.array(F.struct(F.col("document_id"), F.col("page"), F.col("quote")))
    none = F.array().cast(examples.schema["evidence"].dataType)
    hops = F.when(F.col("should_refuse"), none).when(F.size("evidence") > 0, F.col("evidence")).when(F.coalesce("document_id", F.lit("")) != "", one).otherwise(none)
    return examples.withColumn("hops", hops)


def ranked_lists(ranking: DataFrame, chunks: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(group, retrieved array<struct<rank, chunk_id, document_id, page, text, score>>) in rank order; k rows each."""
    full = ranking.select(*group, "chunk_id", "rank", "score").join(chunks.select("chunk_id", "document_id", "page", "text"), "chunk_id")
    return full.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "page", "text", "score"))).alias("retrieved"))


def example_metrics(examples: DataFrame, lists: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), key: str = "example_id") -> DataFrame:
    """(key, metric, value): every metric that applies to an answerable example, at each cutoff. [I7-I14 C7 K12-K16]

    examples(key, hops, mode), lists(key, retrieved). Examples that retrieved nothing score 0; refusals give no rows.
    """
    none = F.array().cast(lists.schema["retrieved"].dataType)
    d = examples.where(F.size("hops") > 0).join(lists, key, "left").withColumn("retrieved", F.coalesce("retrieved", none))
    d = d.withColumn("ids", F.transform("retrieved", lambda r: r["document_id"])).withColumn("wanted", F.array_distinct(F.transform("hops", lambda h: h["document_id"])))
    d = d.withColumn("ranks", M.target_ranks(F.col("ids"), F.col("wanted")))
    quotes = F.filter(F.transform("hops", lambda h: without_space(F.coalesce(h["quote"], F.lit("")))), lambda q: q != "")
    d = d.withColumn("passages", M.passage_ranks(F.transform("retrieved", lambda r: without_space(r["text"])), quotes))
    on_page = lambda r, h: (r["document_id"] == h["document_id"]) & (h["page"].isNull() | (r["page"] == h["page"]))
    page_found = F.transform("hops", lambda h: F.exists("retrieved", lambda r: on_page(r, h)))
    page = F.when(F.col("mode") == "any", F.exists(page_found, lambda x: x)).otherwise(F.forall(page_found, lambda x: x))
    ranks, mode = F.col("ranks"), F.col("mode")
    out: list[tuple[Column | str, Column]] = [("mrr", M.mrr(ranks, mode)), ("page_hit", page.cast("double"))]
    out += [("passage_hit", M.passage_hit(F.col("passages"), mode)), ("passage_at_1", M.passage_at_1(F.col("passages"), mode)), ("passage_mrr", M.passage_mrr(F.col("passages"), mode))]
    for k in cutoffs:
        name = F.when(mode == "any", F.lit(f"any_target_at_{k}")).otherwise(F.lit(f"all_targets_at_{k}"))
        out += [(f"recall_at_{k}", M.recall(ranks, mode, k)), (name, M.satisfied(ranks, mode, k)), (f"ndcg_at_{k}", M.ndcg(ranks, mode, k)), (f"precision_at_{k}", M.precision(F.col("ids"), F.col("wanted"), k))]
    rows = F.array(*(F.struct((F.lit(n) if isinstance(n, str) else n).alias("metric"), v.alias("value")) for n, v in out))
    return d.select(key, F.explode(rows).alias("m")).select(key, "m.metric", "m.value").where("value is not null")


def metric_means(long: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, metric, mean, n): each metric over the examples that carry it. [D8 K15]"""
    return long.groupBy(*group, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def run_counters(results: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Examples, completed, timed out, answerable, refusals, by mode; latency over all rows and over finished ones. [D9 D10]

    results(example_id, should_refuse, mode, timed_out, retrieved_any, latency_ms).
    """
    n = lambda c: F.count_if(c)
    done, refuse = ~F.col("timed_out"), F.col("should_refuse")
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("examples"),
        n(done).alias("completed"),
        n(~done).alias("timed_out"),
        n(~refuse).alias("answerable"),
        n(refuse).alias("refusals"),
        n(~refuse & (F.col("mode") == "all")).alias("all_mode"),
        n(~refuse & (F.col("mode") == "any")).alias("any_mode"),
        F.round(F.avg(F.when(refuse & done, F.col("retrieved_any").cast("double"))), 6).alias("negative_retrieved_rate"),
        F.round(F.avg("latency_ms"), 6).alias("latency_mean_all"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 6).alias("latency_mean_completed"),
    )


def latency_percentiles(rows: DataFrame, value: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank p50, p95, p100 and the mean. [D11 K17]"""
    one = rows.groupBy(*group).agg(F.max(value).cast("double").alias("p100"), F.round(F.avg(value), 6).alias("mean"))
    return with_ranks(one, rows, value, {"p50": disc(0.5), "p95": disc(0.95)}, group).select(*group, "p50", "p95", "p100", "mean")


def category_table(rows: DataFrame) -> DataFrame:
    """(config, category, examples, recall_at_3, page_hit, quote_hit, retrieved_rate, top_score_median). [D12 I22]

    rows(config, category, should_refuse, recall_at_3, page_hit, quote_hit, retrieved_any, top_score). One grouping-set
    pass over the answerable rows (category null: all of them), the refusals in a row of their own.
    """
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6).alias(c)
    none = lambda *names: [F.lit(None).cast("double").alias(x) for x in names]
    answered = rows.where(~F.col("should_refuse")).rollup("config", "category").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("examples"), rate("recall_at_3"), rate("page_hit"), rate("quote_hit"))
    answered = answered.where("g < 3").select("config", F.when(F.col("g") == 1, "(all)").otherwise(F.col("category")).alias("category"), "examples", "recall_at_3", "page_hit", "quote_hit", *none("retrieved_rate", "top_score_median"))
    refused = rows.where("should_refuse").groupBy("config").agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg(F.col("retrieved_any").cast("double")), 6).alias("retrieved_rate"))
    refused = with_ranks(refused, rows.where("should_refuse"), "top_score", MEDIAN, ("config",)).withColumn("top_score_median", F.round((F.col("lower") + F.col("upper")) / 2, 6))
    refused = refused.select("config", F.lit("(refusal)").alias("category"), "examples", *none("recall_at_3", "page_hit", "quote_hit"), "retrieved_rate", "top_score_median")
    return answered.unionByName(refused)


def baseline_diff(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, baseline, delta) for metrics of both runs of one tenant. [C11]

    run, baseline (tenant_id, metric, value); non-numeric metrics are null and stay out.
    """
    b = baseline.select("tenant_id", "metric", F.col("value").alias("baseline"))
    both = run.join(b, ["tenant_id", "metric"]).where("value is not null and baseline is not null")
    return both.select("metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), F.round(F.col("value") - F.col("baseline"), 6).alias("delta"))


def pending(examples: DataFrame, finished: DataFrame, fingerprint: str) -> DataFrame:
    """Examples not finished under this fingerprint. [C13 J10]"""
    return examples.join(finished.where(F.col("fingerprint") == fingerprint).select("example_id"), "example_id", "left_anti")


def report_table(means: DataFrame, metrics: list[str], digits: int = 3) -> DataFrame:
    """(config, one column of text for each metric), a dash where there is none; halves go to the even digit. [A16]"""
    pattern = "0." + "0" * digits
    wide = means.groupBy("config").pivot("metric", metrics).agg(F.first("mean"))
    return wide.select("config", *(F.coalesce(F.call_function("format_number", F.col(m), F.lit(pattern)), F.lit("—")).alias(m) for m in metrics))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kept, lost, out_of_top_5, rescued, n): what became of the first place of one ranking in another. [I19]

    before, after (example_id, rank): rank of the target document, null if absent; single-hop examples.
    """
    both = before.select("example_id", F.col("rank").alias("b")).join(after.select("example_id", F.col("rank").alias("a")), "example_id")
    first, a = F.col("b").eqNullSafe(1), F.col("a")
    return both.agg(
        F.count_if(first & a.eqNullSafe(1)).alias("kept"),
        F.count_if(first & ~a.eqNullSafe(1)).alias("lost"),
        F.count_if(first & (a.isNull() | (a > 5))).alias("out_of_top_5"),
        F.count_if(~first & a.eqNullSafe(1)).alias("rescued"),
        F.count(F.lit(1)).alias("n"),
    )


def passage_positions(rows: DataFrame, group: tuple[str, ...] = ("config",)) -> DataFrame:
    """(group, first, later, absent) of rows(group, rank of the answering passage or null). [I20]"""
    r = F.col("rank")
    return rows.groupBy(*group).agg(F.count_if(r == 1).alias("first"), F.count_if(r > 1).alias("later"), F.count_if(r.isNull() | (r == 0)).alias("absent"))


def random_draw(examples: DataFrame, draws: int = 5) -> DataFrame:
    """examples plus ``hit``: the chance that a random draw of chunks holds the targets. [I18]

    examples(…, mode, counts array<long> of chunks for each target, total long). Inclusion and exclusion: subsets of
    targets are counted by the number of chunks they have together, with the sign of their size, so that the work is
    bounded by targets times chunks of the targets. Whether a target that is listed twice counts twice is up to the
    counts that come in.
    """

    def one(counts, total: int, any_target: bool) -> float:
        if total < draws:
            return 0.0

        def miss(n: int) -> float:
            p = 1.0
            for j in range(draws):
                p *= max(0.0, (total - n - j) / (total - j))
            return p

        if any_target:
            return min(1.0, max(0.0, 1.0 - miss(sum(counts))))
        signed = {0: 1}
        for c in counts:
            for n, times in list(signed.items()):
                if n + c <= total - draws:  # beyond, every draw hits
                    signed[n + c] = signed.get(n + c, 0) - times
        return min(1.0, max(0.0, sum(times * miss(n) for n, times in signed.items())))

    @F.pandas_udf("double")
    def chance(counts: pd.Series, total: pd.Series, mode: pd.Series) -> pd.Series:
        return pd.Series([one([int(x) for x in c], int(t), m == "any") for c, t, m in zip(counts, total, mode, strict=True)], dtype=float)

    return examples.withColumn("hit", chance("counts", "total", F.coalesce("mode", F.lit("all"))))


def difficulty_delta(asked: DataFrame, measure, titles_out=None) -> DataFrame:
    """(metric, original, without_titles, delta, changed): what retrieval loses when questions don't name their document. [I21 H18]

    asked(query_id, text); measure(questions) → (example_id, metric, value) of a retrieval run; titles_out(Column) →
    Column takes the title out (bracketed titles by default). ``changed``: questions whose wording changed.
    """
    bare = asked.withColumn("bare", (titles_out or without_titles)(F.col("text")))
    changed = bare.agg(F.count_if(F.col("bare") != F.col("text")).alias("changed"))
    mean = lambda d, name: d.groupBy("metric").agg(F.avg("value").alias(name))
    both = mean(measure(asked), "original").join(mean(measure(bare.select("query_id", F.col("bare").alias("text"))), "without_titles"), "metric", "full_outer")
    shown = both.select("metric", F.round("original", 6).alias("original"), F.round("without_titles", 6).alias("without_titles"), F.round(F.col("without_titles") - F.col("original"), 6).alias("delta"))
    return shown.crossJoin(F.broadcast(changed))  # one row


def export_rows(examples: DataFrame, lists: DataFrame, long: DataFrame, latency: DataFrame, key: str = "example_id") -> DataFrame:
    """One row for each example, so that every mean can be traced to its questions; passages without their text. [I17]

    examples(key, question, category, should_refuse, mode, hops), lists(key, retrieved), long(key, metric, value),
    latency(key, latency_ms).
    """
    shown = ["recall_at_1", "recall_at_3", "recall_at_5", "all_targets_at_5", "any_target_at_5", "page_hit", "passage_hit", "passage_mrr"]
    wide = long.groupBy(key).pivot("metric", shown).agg(F.first("value"))
    none = F.array().cast(lists.schema["retrieved"].dataType)
    d = examples.join(lists, key, "left").join(wide, key, "left").join(latency, key, "left").withColumn("retrieved", F.coalesce("retrieved", none))
    sources = F.array_distinct(F.transform("hops", lambda h: h["document_id"]))
    return d.select(
        key, "question", "category", F.get("hops", F.lit(0))["document_id"].alias("source"), sources.alias("sources"), F.col("mode").alias("evidence_mode"), "should_refuse",
        F.get("hops", F.lit(0))["page"].alias("expected_page"), *shown[:6], (F.size("retrieved") > 0).alias("retrieved_something"), (F.col("passage_hit") > 0).alias("quote_hit"), "passage_mrr",
        F.round(F.coalesce(F.array_max(F.transform("retrieved", lambda r: r["score"])), F.lit(0.0)), 4).alias("top_score"), F.round("latency_ms", 1).alias("latency_ms"),
        F.transform("retrieved", lambda r: F.struct(r["document_id"].alias("document_id"), r["page"].alias("page"), F.round(r["score"], 4).alias("score"))).alias("retrieved"),
    )
