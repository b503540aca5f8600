"""Operator 6: quality rules with host verdicts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Fewest words, and the largest percentage of words in repeated windows of three.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is refused if its shrunk failure rate is over this.
HOST_RATE = 0.5
_BLANK = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``; null counts as empty.

    All arrays stay in their row: no shuffle, and nothing grows beyond the row's own words. Windows of three words
    are compared by 64-bit hash; positions are sorted with them only in rows where some hash occurs twice.
    """
    kept = docs.columns
    d = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    d = d.withColumn("_words", F.filter(F.split("_text", _BLANK), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    at = lambda i: F.get(F.col("_words"), i)
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    d = d.withColumn("_windows", windows)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines)
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("_sorted")
    same = F.zip_with(F.slice("_sorted", 1, n - 1), F.slice("_sorted", 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))
    d = d.withColumn("_places", F.when(repeated, places))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_places", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    return d.select(
        *kept,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def host_rates(rated: DataFrame, host_col: str, failed_col: str) -> DataFrame:
    """(host, n, failures, rate): failure rates shrunk by a beta prior fitted to all hosts by moments.

    With the mean m and variance v of the hosts' own rates the prior has strength m(1-m)/v - 1, at least 1 and at most
    the mean number of rows of a host; a host's rate is (failures + strength * m) / (n + strength). One row of moments
    goes to the driver. Rows without a host belong to none.
    """
    hosts = rated.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed_col).cast("long")).alias("failures"))
    own = F.col("failures") / F.col("n")
    m = hosts.agg(F.avg(own).alias("m"), F.var_pop(own).alias("v"), F.avg("n").alias("n")).first()
    mean, spread, size = m.m or 0.0, m.v or 0.0, m.n or 1.0
    strength = max(1.0, min(size, mean * (1 - mean) / spread - 1)) if spread > 0 else size
    return hosts.withColumn("rate", (F.col("failures") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    A row fails by itself with under 50 words or over half of them in repeated windows; a row that passes is kept
    unless its host is refused: hosts over ``host_rate`` after shrinking. Only refused hosts are joined back.

    Null and empty texts: all zero, failed. A null host has no verdict. Repeated rows: one result row each. Texts of
    any length are handled in their row. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_body"))
    counted = measures(rows, F.col("_body")).drop("_body")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed))
    refused = host_rates(counted, "_host", "base_failed").where(F.col("rate") > host_rate).select(F.col("host").alias("_host"), F.lit(True).alias("_refused"))
    return counted.join(refused, "_host", "left").withColumn("kept", ~F.col("base_failed") & F.col("_refused").isNull()).drop("_host", "_refused")
