"""Pages to chunks, and corpus-level tables. [A12 B1-B5 B7 D23 D24 E8]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import collapse_space

#: Labels of a version; no label means all versions.
VERSION = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def chunk_pages(pages: DataFrame, size: int = 800, overlap: int = 120, carried: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, document_id, ordinal, page, text, *carried) from pages(document_id, page, text). [B1]

    White space is collapsed, windows of ``size`` code points overlap by ``overlap``, the last one ends with the text,
    and ordinals run on over the pages of a document. Null and blank pages give no chunk. One shuffle of page lengths
    by document; a document of one page needs its own rows only.
    """
    if size <= overlap:
        raise ValueError("chunk size must be greater than overlap")
    clean = F.coalesce(collapse_space(F.col("text")), F.lit(""))
    count = F.when(F.length("clean") == 0, 0).when(F.length("clean") <= size, 1).otherwise(F.ceil((F.length("clean") - overlap) / (size - overlap)).cast("int"))
    d = pages.select("document_id", "page", *carried, clean.alias("clean")).withColumn("n", count)
    before = F.sum("n").over(Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")).where("n > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    ordinal = F.col("first") + F.col("i")
    return d.select(
        F.concat_ws(":", "document_id", ordinal.cast("string")).alias("chunk_id"),
        "document_id",
        ordinal.cast("int").alias("ordinal"),
        "page",
        F.substring("clean", F.col("i") * (size - overlap) + 1, F.lit(size)).alias("text"),
        *carried,
    )


def of_version(chunks: DataFrame, version: str | None) -> DataFrame:
    """Chunks of a version label; None means all versions. [B3]"""
    import re

    if version is None:
        return chunks
    if not re.match(VERSION, version):
        raise ValueError(f"not a version label: {version!r}")
    return chunks.where(F.col("version") == version)


def of_tenant(rows: DataFrame, bases: DataFrame, tenant: str | Column) -> DataFrame:
    """Rows visible to a tenant: those in one of its knowledge bases. [B4]"""
    own = bases.where(F.col("tenant_id") == (F.lit(tenant) if isinstance(tenant, str) else tenant)).select("kb_id")
    return rows.join(own, "kb_id", "left_semi")


def newest(rows: DataFrame, created: str = "created_at", key: str = "id", limit: int = 50) -> DataFrame:
    """Newest first, ties by descending key, ``limit`` rows: the listing itself is the feature. [B5 F6]"""
    return rows.orderBy(F.desc(created), F.desc(key)).limit(limit)


def document_status(pages: DataFrame) -> DataFrame:
    """(document_id, characters, status): needs_ocr if no page has any text. [B7]"""
    n = F.sum(F.length(F.trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy("document_id").agg(n.cast("long").alias("characters"), F.when(n > 0, "ready").otherwise("needs_ocr").alias("status"))


def corpus_totals(chunks: DataFrame, by: str = "kb_id") -> DataFrame:
    """Chunks, documents, chunks per document and the share of the largest document. [D24]"""
    per = chunks.groupBy(by, "document_id").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("pages"))
    return per.groupBy(by).agg(
        F.sum("n").cast("long").alias("chunks"),
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg("n"), 6).alias("chunks_per_document"),
        F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"),
        F.sum("pages").cast("long").alias("pages"),
    )


def corpus_fingerprint(chunks: DataFrame, by: str = "kb_id") -> DataFrame:
    """One digest for each group, independent of row order: a tree over the digests of documents. [D23]

    Documents are put together by the first six hex digits of their digests, those groups by the first four, then two,
    then all, so that even of ten billion documents no row lists more than some hundreds.
    """
    one = F.sha2(F.concat_ws("\x1f", "chunk_id", F.coalesce("version", F.lit("")), "text"), 256)
    digest = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256)
    level = chunks.groupBy(by, "document_id").agg(digest(one).alias("name")).select(by, "name", F.lit("").alias("digest"))
    for length in (6, 4, 2, 0):
        level = level.groupBy(by, F.substring("name", 1, length).alias("part")).agg(digest(F.concat("name", "digest")).alias("digest")).withColumnRenamed("part", "name")
    return level.select(by, F.col("digest").alias("fingerprint"))


def replace_documents(table: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Table with all rows of the changed documents replaced and removed documents left out. [A12 A13 I23]"""
    gone = changed.select(key) if removed is None else changed.select(key).union(removed.select(key))
    return table.join(gone.distinct(), key, "left_anti").unionByName(changed)


def cascade_delete(parents: DataFrame, children: list[DataFrame], history: DataFrame, removed: DataFrame, key: str = "kb_id") -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Parents and child rows of the removed keys go; history stays with a null key. [C5]"""
    ids = removed.select(key).distinct()
    kept = history.join(ids.withColumn("_gone", F.lit(True)), key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
    return parents.join(ids, key, "left_anti"), [c.join(ids, key, "left_anti") for c in children], kept
