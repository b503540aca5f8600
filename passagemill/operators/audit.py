"""Label-set curation and audit. [B8-B14 C12 C14 D14-D16 E7 F5 L1-L9 H23]"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import SENTENCE_ENDS, bigram_overlap, sentences, unsupported_numbers, without_space

from .containment import containing
from .quantiles import MEDIAN, place, with_ranks

# Marks of definitions, boilerplate sentences and boilerplate questions.
DEFINITION = "所称|是指|本办法所称"
BOILERPLATE = "施行|现予公布|废止|自20|自发布之日起|本通知|特此"
BOILERPLATE_QUESTION = "生效|施行|发布日期|公布日期|发布之日"


def shared_sentences(pages: DataFrame, shortest: int = 15, longest: int = 200, join_lines_with: str = "", ends: str = SENTENCE_ENDS, boilerplate: str = BOILERPLATE, definition: str = DEFINITION) -> DataFrame:
    """(key, sentence, documents, definitional): sentences that occur in more than one document. [L6 E7 H15]

    pages(document_id, page, text); ``boilerplate`` and ``definition`` are patterns for the texts' language. Sentences are equal without white space; the wording shown is the first one in
    document and page order. Counted first per (sentence, document), so that a sentence that every document has is
    added up in tasks and never gathered.
    """
    each = pages.select("document_id", "page", F.posexplode(sentences(F.col("text"), join_lines_with, ends)).alias("pos", "sentence"))
    each = each.where(F.length("sentence").between(shortest, longest) & ~F.col("sentence").rlike(boilerplate))
    each = each.withColumn("key", F.md5(without_space(F.col("sentence"))))
    per = each.groupBy("key", "document_id").agg(F.min(F.struct("document_id", "page", "pos", "sentence")).alias("first"))
    out = per.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first")).where("documents > 1")
    return out.select("key", F.col("first.sentence").alias("sentence"), "documents", F.col("first.sentence").rlike(definition).alias("definitional"))


def quote_audit(examples: DataFrame, pages: DataFrame) -> DataFrame:
    """(example_id, outcome, other_documents, numbers): does the quote stand where the label says? [L2 C6 B10 B11 H17]

    examples(example_id, document_id, page, quote, answer), pages(document_id, page, text). Outcomes: verified,
    other_page, missing.
    """
    keyed = pages.select(F.concat_ws("#", "document_id", F.col("page").cast("string")).alias("text_id"), "document_id", "page", "text")
    hits = containing(examples.select(F.col("example_id").alias("quote_id"), "quote"), keyed.select("text_id", "text"))
    spots = hits.join(keyed.select("text_id", F.col("document_id").alias("d"), F.col("page").alias("p")), "text_id")
    labelled = examples.select(F.col("example_id").alias("quote_id"), "document_id", "page")
    seen = spots.join(labelled, "quote_id").groupBy("quote_id").agg(
        F.max((F.col("d") == F.col("document_id")) & (F.col("p") == F.col("page"))).alias("here"),
        F.max(F.col("d") == F.col("document_id")).alias("in_document"),
        F.count_distinct(F.when(F.col("d") != F.col("document_id"), F.col("d"))).alias("others"),
    )
    outcome = F.when(F.col("here"), "verified").when(F.col("in_document"), "other_page").otherwise("missing")
    full = examples.join(seen, examples.example_id == seen.quote_id, "left")
    return full.select("example_id", outcome.alias("outcome"), F.coalesce("others", F.lit(0).cast("long")).alias("other_documents"), F.array_join(unsupported_numbers(F.col("answer"), F.col("quote")), ",").alias("numbers"))


def structure_audit(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: examples, missing fields, duplicate questions, unknown sources, lengths. [L1 D14 D15 C14]

    The median is the upper one; it is found by rank, so no list of all lengths is built.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    known = documents.select("document_id").distinct().withColumn("_k", F.lit(True))
    d = examples.join(known, "document_id", "left").withColumn("n", F.length("question"))
    per = d.groupBy("question").agg(F.count(F.lit(1)).alias("c"))
    twice = per.agg(F.count_if(F.col("c") > 1).alias("duplicate_questions"), F.count(F.lit(1)).alias("unique_questions"))
    one = d.agg(F.count(F.lit(1)).alias("examples"), F.count_if(blank("question") | blank("answer") | blank("quote") | blank("category")).alias("missing_fields"), F.count_if(F.col("_k").isNull()).alias("unknown_sources"), F.min("n").cast("long").alias("shortest"), F.max("n").cast("long").alias("longest"))
    middle = with_ranks(one, d, "n", {"median": MEDIAN["upper"]}).withColumn("median", F.col("median").cast("long"))
    return middle.crossJoin(twice)  # one row each


def overlap_summary(rows: DataFrame) -> DataFrame:
    """(n, median, p90, largest) of question-quote overlap: upper median, place int(0.9 n). [D16 H16]"""
    d = rows.select(F.round(bigram_overlap(F.col("question"), F.col("quote")), 9).alias("o"))
    one = d.agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("o"))
    shown = [F.round(c, 6).alias(name) for c, name in (("median", "median"), ("p90", "p90"), ("o", "largest"))]
    return with_ranks(one, d, "o", {"median": MEDIAN["upper"], "p90": place(0.9)}).select("n", *shown)


def coverage(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, kind): documents without questions and sources that no document has. [C14 L3]"""
    unasked = documents.select("document_id").distinct().join(examples.select("document_id").distinct(), "document_id", "left_anti")
    unknown = examples.where("document_id is not null").select("document_id").distinct().join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return unasked.withColumn("kind", F.lit("without_questions")).unionByName(unknown.withColumn("kind", F.lit("unknown_source")))


def page_audit(examples: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, questions, categories, out_of_range): labels against page counts. [L3]"""
    count = pages.groupBy("document_id").agg(F.max("page").alias("pages"))
    d = examples.join(count, "document_id", "left")
    return d.groupBy("document_id").agg(F.count(F.lit(1)).alias("questions"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count_if(F.col("page") > F.col("pages")).alias("out_of_range"))


def copy_audit(source: DataFrame, bound: DataFrame) -> DataFrame:
    """(question, outcome) where two label copies differ: only one has it, or page or answer disagree. [C12 L4 G4]"""
    a = source.select("question", F.col("page").alias("p1"), F.col("answer").alias("a1"), F.lit(True).alias("s"))
    b = bound.select("question", F.col("page").alias("p2"), F.col("answer").alias("a2"), F.lit(True).alias("b"))
    both = a.join(b, "question", "full_outer")
    outcome = F.when(F.col("b").isNull(), "only_source").when(F.col("s").isNull(), "only_copy").when(~F.col("p1").eqNullSafe(F.col("p2")), "page").when(~F.col("a1").eqNullSafe(F.col("a2")), "answer")
    return both.select("question", outcome.alias("outcome")).where("outcome is not null")


def titles_of(names: DataFrame) -> DataFrame:
    """(name, title) from names like NN_class_issuer_title_year: the second last of at least three parts. [B13]"""
    parts = F.split(F.regexp_replace("name", r"\.[^.]*$", ""), "_")
    return names.select("name", F.when(F.size(parts) >= 3, F.trim(F.regexp_replace(F.get(parts, F.size(parts) - 2), "^(中华人民共和国)+", ""))).alias("title")).where(F.length("title") >= 3)


def title_leaks(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(question_id, leak): a bracketed title, else the longest known title inside the question. [B8]

    The titles of a corpus are found by a containment lookup, so titles × questions is never built.
    """
    bracketed = F.nullif(F.regexp_extract("question", "《[^》]+》", 0), F.lit(""))
    q = questions.withColumn("b", bracketed)
    hits = containing(titles.select(F.col("title").alias("quote_id"), F.col("title").alias("quote")).distinct(), questions.select(F.col("question_id").alias("text_id"), F.col("question").alias("text")))
    best = hits.groupBy(F.col("text_id").alias("question_id")).agg(F.max(F.struct(F.length("quote_id").alias("n"), F.col("quote_id").alias("t"))).alias("m"))
    return q.join(best, "question_id", "left").select("question_id", F.coalesce("b", "m.t").alias("leak")).where("leak is not null")


def candidate_gate(candidates: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(candidate_id, reason): the first reason against a generated question, null if it passes. [L7 B9 H23]

    candidates(candidate_id, question, document_id, page, quote, answer).
    """
    audit = quote_audit(candidates.withColumnRenamed("candidate_id", "example_id"), pages).select(F.col("example_id").alias("candidate_id"), "outcome", "other_documents")
    leaks = title_leaks(candidates.select(F.col("candidate_id").alias("question_id"), "question"), titles).select(F.col("question_id").alias("candidate_id"), "leak")
    first = candidates.groupBy("question").agg(F.min("candidate_id").alias("first"))
    d = candidates.join(audit, "candidate_id").join(leaks, "candidate_id", "left").join(first, "question", "left")
    reason = (
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question").when(F.col("leak").isNotNull(), "title_leak").when(F.col("outcome") != "verified", "quote_not_on_page")
        .when(F.col("question").rlike(BOILERPLATE_QUESTION), "boilerplate").when(F.col("other_documents") > 0, "shared_quote").when(F.col("first") != F.col("candidate_id"), "duplicate")
    )
    return d.select("candidate_id", reason.alias("reason"))


def hop_gate(hops: DataFrame, pages: DataFrame) -> DataFrame:
    """(candidate_id, reason) of two-hop candidates: exactly two hops, one on either side, both quotes verified. [L8]

    hops(candidate_id, side, document_id, page, quote).
    """
    keyed = hops.withColumn("answer", F.lit(""))
    keyed = keyed.withColumn("example_id", F.sha2(F.concat_ws("\x1f", F.col("candidate_id").cast("string"), "side", "document_id", F.col("page").cast("string"), "quote"), 256))
    audit = quote_audit(keyed.select("example_id", "document_id", "page", "quote", "answer").distinct(), pages)
    per = keyed.join(audit, "example_id").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("side") == "left").alias("l"), F.count_if(F.lower("side") == "right").alias("r"), F.count_if(F.col("outcome") == "verified").alias("ok"))
    reason = F.when(F.col("n") != 2, "not_two_hops").when((F.col("l") != 1) | (F.col("r") != 1), "sides").when(F.col("ok") != 2, "quote_not_on_page")
    return per.select("candidate_id", reason.alias("reason"))


def page_shortlist(pages: DataFrame, keywords: list[str], limit: int = 3) -> DataFrame:
    """(document_id, page): the first page and the ``limit`` pages with most keyword occurrences. [F5 L9]"""
    hits = lambda w: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(w), F.lit("")))) / len(w)
    score = sum((hits(w) for w in keywords), F.lit(0.0))
    own = Window.partitionBy("document_id")
    d = pages.withColumn("s", score).withColumn("at", F.row_number().over(own.orderBy(F.desc("s"), "page"))).withColumn("first", F.min("page").over(own))
    return d.where((F.col("at") <= limit) | (F.col("page") == F.col("first"))).select("document_id", "page")


def label_rejects(examples: DataFrame) -> DataFrame:
    """(example_id, reason): labels that contradict themselves. [B14]

    A refusal carries no evidence; any other example has a document or evidence; its first hop is the label's document.
    """
    hops = F.size(F.coalesce("evidence", F.array().cast(examples.schema["evidence"].dataType)))
    has = F.coalesce("document_id", F.lit("")) != ""
    reason = (
        F.when(F.col("should_refuse") & ((hops > 0) | has), "refusal_with_evidence").when(~F.col("should_refuse") & (hops == 0) & ~has, "no_label")
        .when(has & (hops > 0) & (F.get("evidence", F.lit(0))["document_id"] != F.col("document_id")), "primary_is_not_first_hop")
    )
    return examples.select("example_id", reason.alias("reason")).where("reason is not null")


def generated_set_audit(examples: DataFrame, pages: DataFrame, titles: DataFrame, comparison: DataFrame) -> DataFrame:
    """(section, item, value): everything known against a generated label set, as one table. [L5]

    examples, comparison(example_id, question, category, mode, should_refuse, hops array<struct<document_id, page,
    quote>>), pages(document_id, page, text), titles(title). Hops are verified where they claim to be; questions must
    not name a document; the overlap with the first quote is given for both sets. Sections without rows are left out.
    """
    hops = examples.select("example_id", F.posexplode("hops").alias("at", "h")).select(F.concat_ws("#", F.col("example_id").cast("string"), F.col("at").cast("string")).alias("example_id"), "h.document_id", "h.page", "h.quote", F.lit("").alias("answer"))
    checked = quote_audit(hops, pages).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    last = pages.groupBy("document_id").agg(F.max("page").alias("pages"))
    leaks = title_leaks(examples.select(F.col("example_id").alias("question_id"), "question"), titles)
    twice = examples.groupBy("question").agg(F.count(F.lit(1)).alias("c"))
    row = lambda d, section, item, value: d.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    count = F.count(F.lit(1))
    out = [
        row(examples.agg(count.alias("n")), "examples", F.lit("all"), F.col("n")),
        row(examples.agg(F.count_if("should_refuse").alias("n")), "examples", F.lit("refusals"), F.col("n")),
        row(examples.agg(F.count_if(F.size("hops") > 1).alias("n")), "examples", F.lit("multiple_hops"), F.col("n")),
        row(twice.agg(count.alias("n")), "questions", F.lit("unique"), F.col("n")),
        row(twice.agg(F.count_if(F.col("c") > 1).alias("n")), "questions", F.lit("duplicated"), F.col("n")),
        row(leaks.agg(count.alias("n")), "questions", F.lit("naming_a_document"), F.col("n")),
        row(examples.groupBy("category").agg(count.alias("n")), "categories", F.col("category"), F.col("n")),
        row(examples.where(~F.col("should_refuse")).groupBy("mode").agg(count.alias("n")), "modes", F.col("mode"), F.col("n")),
        row(checked, "hops", F.col("outcome"), F.col("n")),
        row(hops.join(last, "document_id").where(F.col("page") > F.col("pages")).agg(count.alias("n")), "hops", F.lit("page_out_of_range"), F.col("n")),
    ]
    for name, rows in (("overlap", examples), ("overlap_of_comparison", comparison)):
        first = rows.where(F.size("hops") > 0).select("question", F.get("hops", F.lit(0))["quote"].alias("quote"))
        one = overlap_summary(first).where("n > 0").select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("median", "p90", "largest")))).alias("x"))
        out.append(row(one, name, F.col("x.item"), F.col("x.value")))
    return reduce(DataFrame.unionByName, out)
