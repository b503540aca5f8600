"""Answers against their evidence, and replies of models. [C8 H7-H11 A17-A19 M5]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How page markers and separators are written in citations.
PAGE = r"(?i)(?:pages?|p)\s*\.?\s*([0-9]+)|第\s*([0-9]+)\s*页"
SUFFIX = r"[:：]\s*([0-9]+)\s*$"
EDGE = r"^[ \t,;，；|·\-–—:：]+|[ \t,;，；|·\-–—:：]+$"


def context_string(passages: Column) -> Column:
    """``[document p.N] text`` of each passage, joined by blank lines. [H7]"""
    return F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["document_id"], F.lit(" p."), p["page"].cast("string"), F.lit("] "), p["text"])), "\n\n")


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, raw, document_id, page, state) of each bracket span read as a citation. [H8 C8]

    answers(answer_id, answer, evidence array<struct<document_id, page>>). A span counts if it names a document of the
    evidence or carries a page marker. State: ok, unknown (no such document), ungrounded (another page).
    """
    spans = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[([^\[\]]{1,200})\]"), F.lit(1))
    d = answers.select("answer_id", "evidence", F.posexplode(spans).alias("pos", "raw"))
    known = F.array_distinct(F.transform("evidence", lambda e: e["document_id"]))
    marker = F.coalesce(_number(F.regexp_extract("raw", PAGE, 1)), _number(F.regexp_extract("raw", PAGE, 2)))
    # only the first marker is taken out: what stands before it and after it stays
    first = F.regexp_extract("raw", PAGE, 0)
    left = F.when(F.col("first") == "", F.col("raw")).otherwise(F.concat(F.call_function("substring_index", F.col("raw"), F.col("first"), F.lit(1)), F.expr("substring(raw, instr(raw, first) + length(first))")))
    d = d.withColumn("first", first).withColumn("page", marker).withColumn("known", known)
    d = d.withColumn("body", F.regexp_replace(left, EDGE, ""))
    head = F.regexp_replace(F.regexp_replace("body", SUFFIX, ""), EDGE, "")
    by_suffix = F.col("page").isNull() & ~F.array_contains("known", F.col("body")) & F.col("body").rlike(SUFFIX) & F.array_contains("known", head)
    d = d.withColumn("document_id", F.when(by_suffix, head).otherwise(F.col("body"))).withColumn("page", F.when(by_suffix, _number(F.regexp_extract("body", SUFFIX, 1))).otherwise(F.col("page")))
    d = d.where(F.array_contains("known", F.col("document_id")) | F.col("page").isNotNull())
    grounded = F.col("page").isNull() | F.exists("evidence", lambda e: (e["document_id"] == F.col("document_id")) & (e["page"] == F.col("page")))
    state = F.when(~F.array_contains("known", F.col("document_id")), "unknown").when(~grounded, "ungrounded").otherwise("ok")
    return d.select("answer_id", "pos", "raw", "document_id", "page", state.alias("state"))


def citation_report(answers: DataFrame, must_cite: bool = False) -> DataFrame:
    """(answer_id, citations, unknown, ungrounded, usable). [H9]"""
    per = citations(answers).groupBy("answer_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state") == "ungrounded").alias("ungrounded"))
    d = answers.join(per, "answer_id", "left").na.fill(0, ["citations", "unknown", "ungrounded"])
    usable = (F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.size("evidence") > 0) & (F.col("unknown") == 0) & (F.col("ungrounded") == 0)
    if must_cite:
        usable &= F.col("citations") > 0
    return d.select("answer_id", "citations", "unknown", "ungrounded", usable.alias("usable"))


def gated_answer(answer: Column, usable: Column, refusal: str = "The retrieved evidence does not answer this question.") -> Column:
    """The answer, or the refusal text if it is not usable. [H9]"""
    return F.when(usable, answer).otherwise(F.lit(refusal))


def _braces(reply: Column, left: str, right: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.regexp_extract(clean, rf"(?s)\{left}.*\{right}", 0)


def _is_one(body: Column) -> Column:
    """Whether a string is exactly one JSON value: as the only item of a list, since readers ignore what follows a value."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1, F.lit(False))


BAD_REPLY = "judge response was not valid JSON"


def judge_reply(reply: Column) -> Column:
    """struct(correctness, faithfulness, completeness, reason) from a judge's reply; 0 and a reason if unreadable. [H10]"""
    body = _braces(reply, "{", "}")
    number = lambda name: F.get_json_object(body, f"$.{name}").try_cast("double")
    get = lambda name: F.when(number(name).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(name))))
    bad = (body == "") | ~_is_one(body)
    score = lambda name: F.when(bad, 0.0).otherwise(F.when(F.isnan(get(name)), 0.0).otherwise(get(name))).alias(name)
    reason = F.when(bad, F.lit(BAD_REPLY)).otherwise(F.substring(F.coalesce(F.get_json_object(body, "$.reason"), F.lit("")), 1, 1000))
    return F.struct(score("correctness"), score("faithfulness"), score("completeness"), reason.alias("reason"))


def list_reply(reply: Column, item: str) -> Column:
    """Items of a model's list reply as array<item schema>; empty if unreadable. [H11]"""
    body = _braces(reply, "[", "]")
    return F.when((body != "") & _is_one(body), F.coalesce(F.from_json(body, f"array<{item}>"), F.array().cast(f"array<{item}>"))).otherwise(F.array().cast(f"array<{item}>"))


def object_reply(reply: Column, schema: str) -> Column:
    """A model's object reply as a struct of the schema; null if unreadable. [H11]"""
    body = _braces(reply, "{", "}")
    return F.when((body != "") & _is_one(body), F.from_json(body, schema))


def excerpts(retrieved: Column, n: int = 3, length: int = 400) -> Column:
    """The best n passages by score, cut to ``length`` characters. [A19]"""
    ordered = F.array_sort(retrieved, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["rank"] - b["rank"]))
    return F.transform(F.slice(ordered, 1, n), lambda r: F.struct(r["document_id"].alias("document_id"), r["page"].alias("page"), F.substring(r["text"], 1, length).alias("text")))


def reviewer_template(judged: DataFrame) -> DataFrame:
    """(config, question, judge, correctness, faithfulness, completeness, note) with empty score columns. [A17]"""
    empty = [F.lit(None).cast("double").alias(c) for c in ("correctness", "faithfulness", "completeness")]
    return judged.select("config", "question", "judge", *empty, F.lit("").alias("note"))


def match_labels(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their reviewer label, and labels without a row; a key of several rows is an error. [C9]"""
    key = ["config", "question"]
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several rows for {twice[0].config} | {twice[0].question}")
    return rows.join(labels, key), labels.join(rows.select(*key), key, "left_anti")


#: Name of an evaluator → expression over (retrieved ids, expected ids). [M5]
EVALUATORS = {
    "recall": lambda ids, wanted: F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, ids)) / F.size(wanted)),
    "mrr": lambda ids, wanted: F.coalesce(1 / F.array_min(F.filter(F.transform(wanted, lambda w: F.array_position(ids, w)), lambda p: p > 0)), F.lit(0.0)),
}
