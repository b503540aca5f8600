"""Readers of corpora, label sets and artifacts; writers of tables. [A1-A3 A7-A11 A14 A15 A20]"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of readable files (container formats need a decoder of the caller's).
SUFFIXES = (".html", ".htm", ".txt", ".md")
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def corpus_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): files below a folder with a readable suffix and content; the rest with a reason. [A1 A2]

    Spark's file sources pass over files of no bytes, so those show up as rejects only in tables and streams of files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return split_files(found, suffixes)


def split_files(found: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Files(path, length, content) that can be read, and (path, reason) of those that can't. [A2]"""
    known = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    reason = F.when(~known, "unsupported_suffix").when(F.col("length") == 0, "empty")
    marked = found.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("path", "reason")


def decode(payload: bytes | None) -> str:
    """UTF-8 (with or without BOM), else GB18030, else UTF-8 with replacement characters. [A3]"""
    raw = payload or b""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with ``text`` instead of the binary column. [A3]"""
    keep = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(x) for x in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    schema = T.StructType([f for f in files.schema if f.name != content] + [T.StructField("text", T.StringType())])
    return files.select(*keep, content).mapInArrow(run, schema)


_HOP = "struct<source_filename:string,page:int,expected_page:int,evidence_quote:string,quote:string>"
_LABEL = f"question string, expected_answer string, page int, expected_page int, category string, evidence_quote string, quote string, source_filename string, should_refuse boolean, evidence_mode string, expected_evidence array<{_HOP}>"


#: Rows that are nested in one line of JSON, about.
NESTED = 1000


def nested(rows: DataFrame, by: str, name: str = "rows", most: int = NESTED) -> DataFrame:
    """(by, name array): the rows of a key nested, about ``most`` in a row; more of a key take several rows.

    Rows are dealt out by their hash over as many parts as all rows need, so a key with most of them is spread over
    all parts, and no array grows with the table.
    """
    rest = [c for c in rows.columns if c != by]
    parts = max(1, -(-rows.count() // most))
    text = F.to_json(F.struct(*rest))  # also of maps, which have no hash
    return rows.groupBy(by, F.pmod(F.xxhash64(text), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_part")


def label_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(question, answer, category, should_refuse, mode, hops) of a label file: a bare list, or an object with examples. [A7]

    Aliases page/expected_page and evidence_quote/quote are read alike; an unknown mode is ``all``. A file of another
    shape is an error. ``lines``: each line is such a list or object, as large sets are written (``nested``), and files
    are split between tasks; else a file is one.
    """
    files = spark.read.text(path, wholetext=not lines)
    body = F.trim(F.regexp_replace("value", "^﻿", ""))
    listed = files.select(F.when(body.startswith("["), F.from_json(body, f"array<struct<{_struct(_LABEL)}>>")).when(body.startswith("{"), F.from_json(body, f"struct<examples:array<struct<{_struct(_LABEL)}>>>")["examples"]).alias("rows"))
    checked = listed.select(F.explode(F.when(F.col("rows").isNull(), F.raise_error(F.lit("a label set is a list or an object with examples"))).otherwise(F.col("rows"))).alias("r")).select("r.*")
    return normal_labels(checked)


def _struct(ddl: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) for part in _split_top(ddl))


def _split_top(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


def normal_labels(rows: DataFrame) -> DataFrame:
    """Rows of either label form in one shape. [A7 C15]"""
    page = F.coalesce("page", "expected_page")
    quote = F.coalesce("evidence_quote", "quote")
    one = F.array(F.struct(F.col("source_filename").alias("source_filename"), page.alias("page"), quote.alias("quote")))
    many = F.transform("expected_evidence", lambda h: F.struct(h["source_filename"].alias("source_filename"), F.coalesce(h["page"], h["expected_page"]).alias("page"), F.coalesce(h["evidence_quote"], h["quote"]).alias("quote")))
    refuse = F.coalesce("should_refuse", F.lit(False))
    none = F.array().cast("array<struct<source_filename:string,page:int,quote:string>>")
    hops = F.when(refuse, none).when(F.size(F.coalesce("expected_evidence", F.array().cast(rows.schema["expected_evidence"].dataType))) > 0, many).when(F.col("source_filename").isNotNull(), one).otherwise(none)
    return rows.select("question", F.col("expected_answer").alias("answer"), "category", refuse.alias("should_refuse"), F.when(F.col("evidence_mode") == "any", "any").otherwise("all").alias("mode"), hops.alias("hops"))


def bind_hops(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """labels(example_id, hops of file names) with document ids instead, in hop order; unknown files get null. [C15]"""
    each = labels.select("example_id", F.posexplode_outer("hops").alias("pos", "h"))
    bound = each.join(documents.select(F.col("filename").alias("f"), "document_id"), F.col("h.source_filename") == F.col("f"), "left")
    hop = F.when(F.col("h").isNotNull(), F.struct("pos", F.struct("document_id", F.col("h.page").alias("page"), F.col("h.quote").alias("quote")).alias("hop")))
    per = bound.groupBy("example_id").agg(F.transform(F.array_sort(F.collect_list(hop)), lambda x: x["hop"]).alias("bound"))
    return labels.drop("hops").join(per, "example_id").withColumnRenamed("bound", "hops")


def label_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The flat CSV label set; a BOM before the first column name is taken off. [A8]"""
    d = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    return d.toDF(*(c.lstrip("﻿") for c in d.columns)).withColumn("page", F.col("page").try_cast("int"))


_EVIDENCE = "array<struct<document_id:string,page:int,text:string>>"
ARTIFACT = f"configs array<struct<name:string,metrics:map<string,double>,per_example:array<struct<example_id:string,question:string,category:string,should_refuse:boolean,metrics:map<string,double>,judge:struct<correctness:double,faithfulness:double,completeness:double,reason:string>,evidence:{_EVIDENCE}>>>>, dataset struct<name:string,examples:int>, corpus struct<fingerprint:string,chunks:int>"


def artifact_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(config, example_id, question, …): per-example rows of an experiment artifact with their config. [A9]

    ``lines``: each line is a part of the artifact, in the same form; else a file is one value.
    """
    d = spark.read.schema(ARTIFACT).json(path, multiLine=not lines)
    return d.select(F.explode("configs").alias("c")).select(F.col("c.name").alias("config"), F.explode("c.per_example").alias("r")).select("config", "r.*")


def reviewer_labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(config, question, correctness, faithfulness, completeness, note) of a list or an object with labels, or of one in each line. [A10]"""
    row = "struct<config:string,question:string,correctness:double,faithfulness:double,completeness:double,note:string>"
    body = F.trim("value")
    rows = F.when(body.startswith("["), F.from_json(body, f"array<{row}>")).otherwise(F.from_json(body, f"struct<labels:array<{row}>>")["labels"])
    return spark.read.text(path, wholetext=not lines).select(F.explode(rows).alias("r")).select("r.*")


def import_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(document_id, filename, size, sha256, chunks) of an import manifest, or of one in each line. [A11]"""
    d = spark.read.schema("documents array<struct<document_id:string,filename:string,size:long,sha256:string,chunks:int>>").json(path, multiLine=not lines)
    return d.select(F.explode("documents").alias("d")).select("d.*")


def schema_faults(table: DataFrame, expected: T.StructType, key: str, vector: str | None = None, dimension: int | None = None) -> list[str]:
    """What is wrong with an index table: fields, types, doubled keys, vector dimension. One row of counts is read. [A14]"""
    have, want = {f.name: f.dataType for f in table.schema}, {f.name: f.dataType for f in expected}
    faults = [f"missing {n}" for n in want if n not in have] + [f"unexpected {n}" for n in have if n not in want]
    faults += [f"type of {n}: {have[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    if key in have:
        doubled = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("x")).first().x
        faults += [f"{doubled} doubled keys"] if doubled else []
    if vector in have and dimension:
        wrong = table.agg(F.count_if(F.size(vector) != dimension).alias("x")).first().x
        faults += [f"{wrong} vectors of another dimension"] if wrong else []
    return faults


def append_run(path: str, runs: DataFrame, results: DataFrame, long: DataFrame) -> None:
    """Appends a run's row, its example results and its long metrics. [A15]"""
    for name, d in (("runs", runs), ("example_results", results), ("metrics_long", long)):
        d.write.mode("append").parquet(f"{path}/{name}")


def write_grouped_json(rows: DataFrame, path: str, by: str = "source_config") -> None:
    """JSON lines of a source config with its rows nested, about NESTED in a line. [A18]"""
    nested(rows, by).write.mode("overwrite").json(path)


def unsent(examples: DataFrame, remote: DataFrame) -> DataFrame:
    """Examples whose (question, document_id) the other side lacks. [A20]"""
    return examples.join(remote.select("question", "document_id").distinct(), ["question", "document_id"], "left_anti")
