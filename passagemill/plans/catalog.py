"""Registered queries over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import text as tx
from passagemill.functions.vectors import hash_counts, normalized
from passagemill.operators import ann, answers, audit, corpus, quantiles, rewriting, search, statistics, telemetry
from passagemill.operators import evaluation as ev
from passagemill.operators.containment import containing
from passagemill.operators.index import build_index, corpus_stats, term_frequencies, updated
from passagemill.operators.quota import quota_decisions
from passagemill.sources import cells, html, readers
from passagemill.sources.scratch import folder, materialize
from passagemill.streaming import jobs

from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks

_W = "'[a-z0-9_]+'"
_C: dict[str, str] = {
    "pg": r"SELECT doc_id::VARCHAR AS document_id, 1 AS page, text, source AS kb_id, lang AS version, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS clean FROM documents",
    "ch": "SELECT document_id || ':' || i AS chunk_id, document_id, i::INT AS ordinal, page, kb_id, version, substring(clean, i * 680 + 1, 800) AS text FROM (SELECT *, unnest(range(CASE WHEN length(clean) = 0 THEN 0 WHEN length(clean) <= 800 THEN 1 ELSE ceil((length(clean) - 120) / 680.0)::INT END)) AS i FROM pg)",
    "qs": r"SELECT item_id AS query_id, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 1, 12), ' ') AS text FROM benchmark",
    "dl": f"SELECT chunk_id, len(regexp_extract_all(lower(text), {_W})) AS dl FROM ch",
    "post": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM ch) GROUP BY ALL",
    "cs": "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl",
    "ts": "SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), cs",
    "qt": f"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM qs",
    "bm": "SELECT query_id, chunk_id, sum(round(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e12)::BIGINT) / 1e12 AS score FROM qt JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (chunk_id), cs GROUP BY ALL",
    "sp": "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0",
    "feat": f"SELECT id, unnest(CASE WHEN len(w) > 0 THEN w ELSE [t] END) AS f FROM (SELECT 'c' || chunk_id AS id, lower(text) AS t, regexp_extract_all(lower(text), {_W}) AS w FROM ch UNION ALL SELECT 'q' || query_id, lower(text), regexp_extract_all(lower(text), {_W}) FROM qs)",
    "sgn": "SELECT id, ('0x' || substr(sha256(f), 1, 8))::BIGINT % 32 AS d, CASE WHEN ('0x' || substr(sha256(f), 10, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM feat",
    "cell": "SELECT id, d, sum(s)::BIGINT AS x FROM sgn GROUP BY ALL HAVING sum(s) <> 0",
    "nrm": "SELECT id, sqrt(sum(x * x)) AS nrm FROM cell GROUP BY 1",
    "cosn": "SELECT substr(q.id, 2)::BIGINT AS query_id, substr(c.id, 2) AS chunk_id, sum(q.x * c.x)::DOUBLE AS dot, any_value(nq.nrm) * any_value(nc.nrm) AS size FROM cell q JOIN cell c ON q.d = c.d AND q.id[1] = 'q' AND c.id[1] = 'c' JOIN nrm nq ON nq.id = q.id JOIN nrm nc ON nc.id = c.id GROUP BY ALL",
    "de": "SELECT query_id, chunk_id, round(dot / size, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / size, 12) DESC, chunk_id) AS rank FROM cosn WHERE round(dot / size, 12) > 0",
    "hit": r"SELECT item_id AS example_id, document_id FROM benchmark b JOIN pg ON contains(regexp_replace(pg.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) WHERE trim(b.text) <> ''",
    "ex": "SELECT b.item_id AS example_id, b.text AS quote, qs.text AS question, count(hit.document_id) AS n, CASE WHEN count(hit.document_id) = 0 THEN 'refusal' WHEN count(hit.document_id) = 1 THEN 'single' ELSE 'equivalent' END AS category, count(hit.document_id) = 0 AS should_refuse, CASE WHEN count(hit.document_id) > 1 THEN 'any' ELSE 'all' END AS mode FROM benchmark b JOIN qs ON qs.query_id = b.item_id LEFT JOIN hit ON hit.example_id = b.item_id GROUP BY ALL",
    "top": "SELECT sp.query_id AS example_id, rank, chunk_id, document_id, ch.text, score FROM sp JOIN ch USING (chunk_id) WHERE rank <= 5",
    "tr": "SELECT hit.example_id, hit.document_id, min(rank) AS rank FROM hit LEFT JOIN top ON top.example_id = hit.example_id AND top.document_id = hit.document_id GROUP BY ALL",
    "pr": r"SELECT ex.example_id, min(rank) AS prank FROM ex LEFT JOIN top ON top.example_id = ex.example_id AND contains(regexp_replace(top.text, '\s+', '', 'g'), regexp_replace(ex.quote, '\s+', '', 'g')) GROUP BY 1",
    "mx": """SELECT tr.example_id, mode, k, count(*) AS n, count(*) FILTER (rank <= k) AS found, min(rank) AS best,
      sum(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0 END) AS inv, sum(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0) ELSE 0 END) AS gain, max(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0) ELSE 0 END) AS bestgain
      FROM tr JOIN ex USING (example_id), (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL""",
    "met": """SELECT example_id, 'mrr' AS metric, CASE WHEN mode = 'any' THEN coalesce(1.0 / best, 0) ELSE inv / n END AS value FROM mx WHERE k = 1
      UNION ALL SELECT example_id, 'recall_at_' || k, CASE WHEN mode = 'any' THEN (found > 0)::INT::DOUBLE ELSE found / n END FROM mx
      UNION ALL SELECT example_id, CASE WHEN mode = 'any' THEN 'any_target_at_' ELSE 'all_targets_at_' END || k, CASE WHEN mode = 'any' THEN (found > 0)::INT::DOUBLE ELSE (found = n)::INT::DOUBLE END FROM mx
      UNION ALL SELECT example_id, 'ndcg_at_' || k, CASE WHEN mode = 'any' THEN bestgain ELSE gain / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1.0))) END FROM mx
      UNION ALL SELECT mx.example_id, 'precision_at_' || k, (SELECT count(*) FROM top JOIN hit USING (example_id, document_id) WHERE top.example_id = mx.example_id AND top.rank <= mx.k) / k FROM mx
      UNION ALL SELECT example_id, 'page_hit', CASE WHEN mode = 'any' THEN (best IS NOT NULL)::INT::DOUBLE ELSE (count(*) FILTER (found5 = n) > 0)::INT::DOUBLE END FROM (SELECT *, count(*) OVER () AS _x, found AS found5 FROM mx WHERE k = 5) GROUP BY example_id, mode, best
      UNION ALL SELECT example_id, 'passage_hit', (prank IS NOT NULL)::INT::DOUBLE FROM pr JOIN ex USING (example_id) WHERE n > 0
      UNION ALL SELECT example_id, 'passage_at_1', (prank IS NOT NULL AND prank = 1)::INT::DOUBLE FROM pr JOIN ex USING (example_id) WHERE n > 0
      UNION ALL SELECT example_id, 'passage_mrr', coalesce(1.0 / prank, 0) FROM pr JOIN ex USING (example_id) WHERE n > 0""",
    "rq": "SELECT event_id, ts, '/api/' || event_type || '/' || (user_id * 37) || '/x' AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 10 AS elapsed_s FROM events",
}
_NEEDS = {
    "pg": [], "ch": ["pg"], "qs": [], "dl": ["ch"], "post": ["ch"], "cs": ["dl"], "ts": ["post", "cs"], "qt": ["qs"], "bm": ["qt", "post", "ts", "dl", "cs"], "sp": ["bm"],
    "feat": ["ch", "qs"], "sgn": ["feat"], "cell": ["sgn"], "nrm": ["cell"], "cosn": ["cell", "nrm"], "de": ["cosn"], "hit": ["pg"], "ex": ["qs", "hit"], "top": ["sp", "ch"],
    "tr": ["hit", "top"], "pr": ["ex", "top"], "mx": ["tr", "ex"], "met": ["mx", "pr", "top", "hit", "ex"], "rq": [],
}


def w(names: str, body: str, **extra: str) -> str:
    """WITH the named blocks and all they need, then extra blocks, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for m in _NEEDS[n]:
                add(m)
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS MATERIALIZED ({_C[n]})" for n in order] + [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}"


# ---- corpus


@query(w("ch", "SELECT chunk_id, document_id, ordinal, page, md5(text) AS digest, kb_id, version FROM ch"))
def chunk_documents(spark, sf):
    """B1 B2 E8"""
    return v.chunks(spark, sf).select("chunk_id", "document_id", "ordinal", "page", F.md5("text").alias("digest"), "kb_id", "version")


@query(w("ch", "SELECT kb_id, sum(n)::BIGINT AS chunks, count(*) AS documents, round(avg(n), 6) AS chunks_per_document, round(max(n) / sum(n), 6) AS largest_share, sum(p)::BIGINT AS pages FROM (SELECT kb_id, document_id, count(*) AS n, max(page) AS p FROM ch GROUP BY ALL) GROUP BY 1"))
def corpus_totals(spark, sf):
    """D24"""
    return corpus.corpus_totals(v.chunks(spark, sf))


def _tree(length: int, below: str) -> str:
    return f"(SELECT kb_id, substr(name, 1, {length}) AS name, sha256(string_agg(name || digest, '' ORDER BY name || digest)) AS digest FROM {below} GROUP BY ALL)"


_LEAVES = "(SELECT kb_id, sha256(string_agg(h, '' ORDER BY h)) AS name, '' AS digest FROM (SELECT kb_id, document_id, sha256(chunk_id || chr(31) || coalesce(version, '') || chr(31) || text) AS h FROM ch) GROUP BY kb_id, document_id)"


@query(w("ch", f"SELECT kb_id, digest AS fingerprint FROM {_tree(0, _tree(2, _tree(4, _tree(6, _LEAVES))))}"))
def corpus_fingerprint(spark, sf):
    """D23"""
    return corpus.corpus_fingerprint(v.chunks(spark, sf))


@query(w("ch", "SELECT version, kb_id, count(*) AS chunks FROM ch WHERE version = 'en' GROUP BY ALL"))
def version_filter(spark, sf):
    """B3 K11"""
    return corpus.of_version(v.chunks(spark, sf), "en").groupBy("version", "kb_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT source AS kb_id, count(*) AS documents FROM documents WHERE (substr(source, 4)::INT % 3) = 1 GROUP BY 1")
def tenant_scope(spark, sf):
    """B4 C5"""
    d = v.pages(spark, sf)
    bases = d.select("kb_id").distinct().withColumn("tenant_id", (F.substring("kb_id", 4, 9).cast("int") % 3).cast("string"))
    return corpus.of_tenant(d, bases, "1").groupBy("kb_id").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT doc_id::VARCHAR AS document_id, length(trim(coalesce(text, '')))::BIGINT AS characters, CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 'ready' ELSE 'needs_ocr' END AS status FROM documents")
def document_status(spark, sf):
    """B7 I24"""
    return corpus.document_status(v.pages(spark, sf))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(spark, sf):
    """B5 F6"""
    e = v.table(spark, sf, "events").where("event_type = 'error'").select("event_id", "ts", "event_type")
    return corpus.newest(e, "ts", "event_id")


@query(w("ch", "SELECT kb_id, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM ch WHERE document_id::BIGINT % 7 <> 3 GROUP BY 1"))
def replace_documents(spark, sf):
    """Chunks of documents of id 5 modulo 7 are written anew, those of 3 modulo 7 removed."""
    c = v.chunks(spark, sf)
    changed = c.where(F.col("document_id").cast("long") % 7 == 5)
    removed = c.where(F.col("document_id").cast("long") % 7 == 3)
    return corpus.replace_documents(c, changed, removed).groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"))


@query("SELECT 'documents' AS part, count(*) AS n, 0 AS nulls FROM documents WHERE source <> 'src3' UNION ALL SELECT 'history', count(*), count(*) FILTER (source = 'src3') FROM labels JOIN documents USING (doc_id)")
def cascade_delete(spark, sf):
    """Documents of a removed base go, run history stays with a null key."""
    d = v.pages(spark, sf)
    history = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id")).join(d.select("document_id", "kb_id"), "document_id")
    bases = d.select("kb_id").distinct()
    _, (kept,), runs = corpus.cascade_delete(bases, [d], history, bases.where("kb_id = 'src3'"))
    one = kept.agg(F.lit("documents").alias("part"), F.count(F.lit(1)).alias("n"), F.lit(0).alias("nulls"))
    return one.unionByName(runs.agg(F.lit("history").alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("kb_id").isNull()).alias("nulls")))


# ---- tokens and index


@query(rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), {_W}),
  flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_concat(CASE WHEN length(r) <= 8 THEN [r] ELSE [] END, list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3)))))) AS t FROM documents)""")
def tokenize_terms(spark, sf):
    """H1 H2 G2"""
    d = v.table(spark, sf, "documents").select("doc_id", tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(w("post", "SELECT chunk_id, term, tf::INT AS tf FROM post"))
def postings(spark, sf):
    """D1"""
    return term_frequencies(v.chunks(spark, sf)).select("chunk_id", "term", "tf")


@query(w("ts", "SELECT term, df, round(idf, 6) AS idf FROM ts"))
def term_stats_table(spark, sf):
    """D3"""
    return build_index(v.chunks(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(w("ch", f"SELECT kb_id AS scope, count(*) AS n, round(avg(len(regexp_extract_all(lower(text), {_W}))), 6) AS avgdl FROM ch GROUP BY 1"))
def corpus_stats_table(spark, sf):
    """D2 K10"""
    return corpus_stats(v.chunks(spark, sf), F.col("kb_id")).select("scope", "n", F.round("avgdl", 6).alias("avgdl"))


@query(w("cell", "SELECT substr(id, 2) AS chunk_id, d::INT AS place, x::DOUBLE AS value FROM cell WHERE id[1] = 'c'"))
def hash_embedding(spark, sf):
    """H3: the counts before normalisation, without zeros."""
    d = v.chunks(spark, sf).select("chunk_id", F.posexplode(hash_counts(F.col("text"))).alias("place", "value"))
    return d.where("value <> 0")


# ---- ranking

_RANK = "round(score, 6) AS score, rank::INT AS rank"


def _shown(d: DataFrame, *more: str) -> DataFrame:
    return d.select(*more, "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(w("sp", f"SELECT query_id, chunk_id, {_RANK} FROM sp WHERE rank <= 5"))
def bm25_topk(spark, sf):
    """C1 C2 D4 E1 F1 I1"""
    _, index = v.default_index(spark, sf)
    return _shown(search.sparse_search(v.questions(spark, sf), index, v.TOP_K))


@query(w("qt post", "SELECT count(*) AS every, true AS spared FROM qt JOIN post USING (term)"))
def bm25_pairs(spark, sf):
    """pairs of a question and a posting of one of its terms, and whether under half of them are made for the first five."""
    _, index = v.default_index(spark, sf)
    return search.sparse_pairs(v.questions(spark, sf), index, v.TOP_K).select("every", (F.col("made") < 0.5 * F.col("every")).alias("spared"))


_WHOLE = w("sp", f"SELECT query_id, chunk_id, {_RANK} FROM sp WHERE rank <= 5").replace(_C["qs"], "SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark")


@query(_WHOLE)
def bm25_whole_texts(spark, sf):
    """whole benchmark texts as questions."""
    _, index = v.default_index(spark, sf)
    return _shown(search.sparse_search(v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), index, v.TOP_K))


#: The corpus after documents of id 3 modulo 10 got more text and those of 4 modulo 20 went.
_CHANGED = "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || ' renewed clause of the amended law' ELSE text END AS text, source, lang FROM documents WHERE doc_id % 20 <> 4))"


def _updated_index(spark, sf):
    """The stored index brought up to the changed corpus by what changed alone."""
    c, index = v.default_index(spark, sf)
    number = F.col("document_id").cast("long")
    changed = v.pages(spark, sf).where(number % 10 == 3).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" renewed clause of the amended law")))
    new = corpus.chunk_pages(changed, carried=("kb_id", "version"))
    gone = c.where((number % 10 == 3) | (number % 20 == 4)).select("chunk_id")
    return updated(index, gone, new)


@query(w("ts", "SELECT term, df, round(idf, 6) AS idf FROM ts").replace("FROM documents)", _CHANGED, 1))
def index_delta(spark, sf):
    """Statistics after a tenth of the documents changed and a twentieth went, by signed counts."""
    return _updated_index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(w("sp", f"SELECT query_id, chunk_id, {_RANK} FROM sp WHERE rank <= 5").replace("FROM documents)", _CHANGED, 1))
def bm25_updated(spark, sf):
    """A search over the index that was brought up to date."""
    return _shown(search.sparse_search(v.questions(spark, sf), _updated_index(spark, sf), v.TOP_K))


@query(w("ch qs", f"SELECT query_id, chunk_id, {_RANK} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 5",
  d2=f"SELECT version, chunk_id, len(regexp_extract_all(lower(text), {_W})) AS dl FROM ch", c2="SELECT version, count(*) AS n, avg(dl) AS avgdl FROM d2 GROUP BY 1",
  p2=f"SELECT version, chunk_id, term, count(*) AS tf FROM (SELECT version, chunk_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM ch) GROUP BY ALL",
  t2="SELECT version, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT version, term, count(*) AS df FROM p2 GROUP BY ALL) JOIN c2 USING (version)",
  q2=f"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM qs",
  b="SELECT query_id, chunk_id, sum(round(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e12)::BIGINT) / 1e12 AS score FROM q2 JOIN p2 USING (term) JOIN t2 USING (version, term) JOIN d2 USING (version, chunk_id) JOIN c2 USING (version) WHERE version = 'en' GROUP BY ALL"))
def bm25_scoped(spark, sf):
    """Statistics of one version only."""
    index = build_index(v.chunks(spark, sf), F.col("version"))
    return _shown(search.sparse_search(v.questions(spark, sf).withColumn("scope", F.lit("en")), index, v.TOP_K))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.x, c.x), 9) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0)
  SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def cosine_topk(spark, sf):
    """Every fiftieth vector against all."""
    e = v.table(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    every = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return _shown(search.dense_search(asked, every, 10, digits=9))


def _unit_vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", normalized(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))


def _fiftieth(e):
    return e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id")


@query()
def ann_topk(spark, sf):
    """F4"""
    return _shown(ann.approximate_search(*_fiftieth(_unit_vectors(spark, sf)), 10))


def _enough(report):
    """Whether nine tenths of the exact neighbours are found, with under a third of the pairs compared even by codes."""
    return report.select(F.col("questions").cast("long").alias("questions"), F.col("vectors").cast("long").alias("vectors"), (F.col("recall") >= 0.9).alias("found"), (F.col("code_share") < 1 / 3).alias("spared"), (F.col("exact_share") < 1 / 10).alias("compared_few"))


@query("SELECT count(*) FILTER (vec_id % 50 = 0) AS questions, count(*) AS vectors, true AS found, true AS spared, true AS compared_few FROM embeddings")
def ann_clustered(spark, sf):
    """F4 over vectors with near neighbours: each given vector, halved, beside the first one of its group of label and id hash."""
    e = _unit_vectors(spark, sf).join(v.table(spark, sf, "embeddings").select("vec_id", F.struct("label", F.pmod(F.xxhash64("vec_id"), F.lit(2))).alias("g")), "vec_id")
    first = e.groupBy("g").agg(F.min_by("vector", "vec_id").alias("first"))  # two for each label
    return _enough(ann.ann_report(*_fiftieth(e.join(first, "g").select("vec_id", normalized(F.zip_with("first", "vector", lambda a, b: a + b * 0.4)).alias("vector"))), 5))


@query(w("ch qs", "SELECT (SELECT count(*) FROM qs) AS questions, (SELECT count(*) FROM ch) AS vectors, true AS found, true AS spared, true AS compared_few"))
def ann_chunks(spark, sf):
    """F4 over the hashed vectors of all chunks. Questions are shorter than chunks, so a higher recall is asked of the sample."""
    unit = lambda d, key: d.select(key, normalized(F.col("vector")).alias("vector"))
    return _enough(ann.ann_report(unit(v.asked_vectors(v.questions(spark, sf)), "query_id"), unit(v.vectors(v.chunks(spark, sf)), "chunk_id"), v.TOP_K, 0.99))


@query(w("de", f"SELECT query_id, chunk_id, {_RANK} FROM de WHERE rank <= 5"))
def dense_topk(spark, sf):
    """I2 G5"""
    c = v.chunks(spark, sf)
    return _shown(search.dense_search(v.asked_vectors(v.questions(spark, sf)), v.vectors(c), v.TOP_K))


def _fuse_blocks(how: search.Fusion, depth: int = 20) -> dict[str, str]:
    cut = min(depth, how.truncate or depth)
    if how.method == "rrf":
        part = f"w / ({how.k} + rank)"
    else:
        part = "w * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END"
    return {
        "cn": f"SELECT *, min(score) OVER (PARTITION BY query_id, c) AS lo, max(score) OVER (PARTITION BY query_id, c) AS hi FROM (SELECT query_id, chunk_id, score, rank, {how.dense}::DOUBLE AS w, 0 AS c FROM de WHERE rank <= {cut} UNION ALL SELECT query_id, chunk_id, score, rank, {how.sparse}::DOUBLE, 1 FROM sp WHERE rank <= {cut})",
        "fu": f"SELECT query_id, chunk_id, sum(round({part} * 1e12)::BIGINT) / 1e12 AS score, min(rank) AS best FROM cn GROUP BY ALL",
        "fr": "SELECT query_id, chunk_id, score, page, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, page, text, chunk_id) AS rank FROM fu JOIN ch USING (chunk_id)",
    }


def _fused(name: str):
    def run(spark, sf):
        """C4 D5 D6 D7 E2 E3 G1 I3"""
        c, index = v.default_index(spark, sf)
        return _shown(v.retrieve(v.questions(spark, sf), c, index, "hybrid", name))

    return run


for _name, _preset in (("rrf_fusion", "rrf"), ("rrf_weighted", "rrf-bm25-heavy"), ("rrf_truncated", "rrf-truncate-5"), ("convex_fusion", "convex"), ("convex_weighted", "convex-bm25-heavy")):
    QUERIES[_name] = _fused(_preset)
    SQL[_name] = w("de sp ch", f"SELECT query_id, chunk_id, {_RANK} FROM fr WHERE rank <= 5 AND score > 0", **_fuse_blocks(search.FUSIONS[_preset]))

_RR = {
    "rn": "SELECT *, min(score) OVER (PARTITION BY query_id) AS low, max(score) OVER (PARTITION BY query_id) AS high FROM cand",
    "rc": f"SELECT rn.query_id, chunk_id, rank AS prior, round(CASE WHEN high = low THEN 1.0 ELSE (score - low) / (high - low) END * 0.7 + CASE WHEN len(qq.t) = 0 THEN 0.0 ELSE len(list_intersect(qq.t, regexp_extract_all(lower(rn.text), {_W}))) / len(qq.t) END * 0.3, 12) AS score FROM rn JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(text), {_W})) AS t FROM qs) qq USING (query_id)",
    "rr": "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM rc",
}


@query(w("sp ch qs", f"SELECT query_id, chunk_id, {_RANK} FROM rr WHERE rank <= 5 AND score > 0", cand="SELECT sp.*, text FROM sp JOIN ch USING (chunk_id) WHERE rank <= 20", **_RR))
def lexical_rerank(spark, sf):
    """H6 K9 F2"""
    c, index = v.default_index(spark, sf)
    return _shown(v.retrieve(v.questions(spark, sf), c, index, "sparse", rerank=True))


@query(w("de sp ch qs", f"SELECT query_id, chunk_id, {_RANK} FROM rr WHERE rank <= 5 AND score > 0", **_fuse_blocks(search.FUSIONS["rrf"]), cand="SELECT * FROM fr WHERE rank <= 20", **_RR))
def retrieve_full(spark, sf):
    """Hybrid, fused, reranked, cut."""
    c, index = v.default_index(spark, sf)
    return _shown(v.retrieve(v.questions(spark, sf), c, index, "hybrid", "rrf", rerank=True))


_RULES = "SELECT * FROM (VALUES " + ", ".join(f"({s}, '{t}', '{' '.join(e)}')" for s, t, e in v.RULES) + ") r(seq, trig, exp)"
_EXP = {
    "rules": _RULES,
    "xp": "SELECT query_id, variant, text FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS variant, text || ' ' || exp AS text FROM qs JOIN rules ON contains(text, trig)) WHERE variant < 3 UNION ALL SELECT query_id, 0, text FROM qs WHERE text <> ''",
}


@query(w("qs", "SELECT query_id, variant::INT AS variant, text FROM xp", **_EXP))
def query_expansion(spark, sf):
    """H5 G2"""
    return search.expand(v.questions(spark, sf), v.rules(spark))


_VARIANTS = {
    "vt": f"SELECT DISTINCT query_id, variant, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM xp",
    "vb": "SELECT query_id, variant, chunk_id, sum(round(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e12)::BIGINT) / 1e12 AS score FROM vt JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (chunk_id), cs GROUP BY ALL",
    "vs": "SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_id) AS rank FROM vb WHERE score > 0",
    "vf": "SELECT query_id, chunk_id, sum(CASE WHEN several THEN round(1e12 / (60 + rank))::BIGINT ELSE round(score * 1e12)::BIGINT END) / 1e12 AS score, min(rank) AS best FROM vs JOIN (SELECT query_id, max(variant) > min(variant) AS several FROM vs WHERE rank <= 20 GROUP BY 1) USING (query_id) WHERE rank <= 20 GROUP BY ALL",
    "vr": "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, page, text, chunk_id) AS rank FROM vf JOIN ch USING (chunk_id)",
}


@query(w("post ts dl cs ch qs", "SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM vr WHERE rank <= 5", **_EXP, **_VARIANTS))
def variant_fusion(spark, sf):
    """I4 K8"""
    c, index = v.default_index(spark, sf)
    return _shown(v.retrieve(v.questions(spark, sf), c, index, "sparse", rewrite=v.rules(spark)))


_FORMS = {
    "fm": "SELECT query_id, 0 AS i, text FROM qs UNION ALL SELECT query_id, 1, array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM qs UNION ALL SELECT query_id, 2, array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) > 3), ' ') FROM qs",
    "xp": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS variant, text FROM fm WHERE text <> '' GROUP BY query_id, text",
}


def _rewritten(questions: DataFrame) -> DataFrame:
    """Forms of questions by a caller's function: its words backwards, and those of more than three letters."""

    def rewrite(text: str) -> list[str]:
        words = text.split(" ")
        return [" ".join(reversed(words)), " ".join(x for x in words if len(x) > 3)]

    rewriting.register_rewriter(questions.sparkSession, "rewrite_questions", rewrite)
    return rewriting.rewritten(questions, "rewrite_questions")


@query(w("qs", "SELECT query_id, variant::INT AS variant, text, false AS degraded FROM xp", **_FORMS))
def rewriter_hook(spark, sf):
    """M3 M4 G2"""
    return _rewritten(v.questions(spark, sf))


@query(w("post ts dl cs ch qs", "SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM vr WHERE rank <= 5", **_FORMS, **_VARIANTS))
def rewriter_retrieval(spark, sf):
    """The ranking of a question's forms as one."""
    c, index = v.default_index(spark, sf)
    return _shown(v.retrieve(v.questions(spark, sf), c, index, "sparse", rewrite=lambda asked: _rewritten(asked).drop("degraded")))


# ---- labels and metrics


@query(w("ex hit", "SELECT ex.example_id, category, should_refuse, mode, coalesce(string_agg(document_id, ',' ORDER BY document_id), '') AS documents FROM ex LEFT JOIN hit USING (example_id) GROUP BY ALL"))
def label_targets(spark, sf):
    """I6 C6 B14"""
    e = v.examples(spark, sf)
    return e.select("example_id", "category", "should_refuse", "mode", F.array_join(F.transform("hops", lambda h: h["document_id"]), ",").alias("documents"))


@query(w("hit", "SELECT example_id, document_id FROM hit"))
def quote_containment(spark, sf):
    """C6"""
    b = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    hits = containing(b, v.pages(spark, sf).select(F.col("document_id").alias("text_id"), "text"))
    return hits.select(F.col("quote_id").alias("example_id"), F.col("text_id").alias("document_id"))


def _metric(prefix: str):
    def run(spark, sf):
        """I7-I14 K12-K16"""
        return v.sparse_metrics(spark, sf).where(F.col("metric").rlike(f"^({prefix})")).select("example_id", "metric", F.round("value", 6).alias("value"))

    return run


for _name, _prefix in (("recall_at_k", "recall_at"), ("all_any_targets", "all_targets|any_target"), ("mrr", "mrr"), ("precision_at_k", "precision_at"), ("ndcg_at_k", "ndcg_at"), ("passage_metrics", "passage_"), ("page_hit", "page_hit")):
    QUERIES[_name] = _metric(_prefix)
    SQL[_name] = w("met", f"SELECT example_id, metric, round(value, 6) AS value FROM met WHERE regexp_matches(metric, '^({_prefix})')")


@query(w("met", "SELECT metric, round(avg(value), 6) AS mean, count(*) AS n FROM met GROUP BY 1"))
def metric_means(spark, sf):
    """D8 K15 I14"""
    return ev.metric_means(v.sparse_metrics(spark, sf))


def _again(blocks: dict[str, str], mark: str, names: str, **other: str) -> dict[str, str]:
    """The blocks under names with a mark, reading each other and those of ``names`` under marked names, ``other`` under others."""
    renamed = {n: n + mark for n in [*blocks, *names.split()]} | other
    return {n + mark: re.sub(r"(?<![\w.])(?<!AS )(" + "|".join(sorted(renamed, key=len, reverse=True)) + r")\b(?!\()", lambda m: renamed[m[0]], q) for n, q in blocks.items()}


def _matrix_sql(tail: str) -> str:
    """Metrics of the eleven settings, each from blocks of its own over shared channels, then ``tail`` over mm(config, metric, mean, n)."""
    pick = lambda names: {n: _C[n] for n in names.split()}
    single = {"xq": "SELECT query_id || '#' || variant AS query_id, text FROM xp"}
    blocks: dict[str, str] = {**_EXP, **single, **_again(pick("qt bm sp"), "_x", "", qs="xq")}
    wide = {n: q.replace("::BIGINT AS query_id", " AS query_id") for n, q in pick("feat sgn cell nrm cosn de").items()}
    blocks |= _again(wide, "_x", "", qs="xq")
    ends = []
    for i, (name, mode, how, rerank, rewrite) in enumerate(v.CONFIGS):
        mark = f"_{i}"
        if mode == "hybrid":
            blocks |= _again(_fuse_blocks(search.fusion(how)), mark, "", **({"de": "de_x", "sp": "sp_x"} if rewrite else {}))
            source = f"fr{mark}"
        else:
            source = {"sparse": "sp", "dense": "de"}[mode]
            blocks[f"fr{mark}"] = f"SELECT {source}.*, text FROM {source} JOIN ch USING (chunk_id)"
        if rewrite:
            blocks[f"vs{mark}"] = f"SELECT split_part(query_id, '#', 1)::BIGINT AS query_id, split_part(query_id, '#', 2)::INT AS variant, chunk_id, score, rank FROM fr{mark} WHERE rank <= 20"
            blocks |= _again({"vf": _VARIANTS["vf"], "vr": _VARIANTS["vr"].replace("score, row_number()", "score, text, row_number()")}, mark, "vs")
        last = f"vr{mark}" if rewrite else f"fr{mark}"
        if rerank:
            blocks[f"cand{mark}"] = f"SELECT * FROM {last} WHERE rank <= 20"
            blocks |= _again(_RR, mark, "cand")
            last = f"rr{mark}"
        blocks[f"out{mark}"] = f"SELECT query_id, chunk_id, score, rank FROM {last} WHERE rank <= 5 AND score > 0"
        blocks |= _again(pick("top tr pr mx met"), mark, "", sp=f"out{mark}")
        ends.append(f"SELECT '{name}' AS config, metric, round(avg(value), 6) AS mean, count(*) AS n FROM met{mark} GROUP BY metric")
    return w("de sp ch qs ex hit", tail, **blocks, mm=" UNION ALL ".join(ends))


#: Columns of the report table. [A16]
_SHOWN_METRICS = ["recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_3", "ndcg_at_5", "page_hit", "passage_at_1", "passage_mrr", "all_targets_at_5", "any_target_at_5"]


@query(_matrix_sql("SELECT config, metric, mean, n FROM mm"))
def experiment_matrix(spark, sf):
    """Means of all metrics of eleven settings, from shared channel rankings."""
    c, index = v.default_index(spark, sf)
    c = materialize(c)
    ranked = v.retrieve_all(v.questions(spark, sf), c, index, v.rules(spark))
    lists = ev.ranked_lists(ranked, c, ("config", "query_id")).withColumnRenamed("query_id", "example_id")
    keyed = lists.withColumn("key", F.concat_ws("#", "config", F.col("example_id").cast("string")))
    e = v.examples(spark, sf).join(lists.select("config").distinct()).withColumn("key", F.concat_ws("#", "config", F.col("example_id").cast("string")))
    long = ev.example_metrics(e.drop("example_id", "config"), keyed.select("key", "retrieved"), key="key")
    return ev.metric_means(long.withColumn("config", F.split("key", "#")[0]), ("config",)).select("config", "metric", "mean", "n")


@query(_matrix_sql("SELECT config, " + ", ".join(f"coalesce(printf('%.3f', max(mean) FILTER (metric = '{m}')), '—') AS {m}" for m in _SHOWN_METRICS) + " FROM mm GROUP BY config"))
def report_table(spark, sf):
    """A16"""
    return ev.report_table(experiment_matrix(spark, sf), _SHOWN_METRICS)


def _results(spark, sf) -> DataFrame:
    """One row for each example of the BM25 run; the events' values stand for latencies."""
    _, index = v.default_index(spark, sf)
    top = search.sparse_search(v.questions(spark, sf), index, v.TOP_K).groupBy("query_id").agg(F.max("score").alias("top_score"))
    lat = v.table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms"))
    e = v.examples(spark, sf).join(top.withColumnRenamed("query_id", "example_id"), "example_id", "left").join(lat.withColumnRenamed("query_id", "example_id"), "example_id", "left")
    return e.withColumn("retrieved_any", F.col("top_score").isNotNull()).withColumn("timed_out", F.col("example_id") % 10 == 9)


_RES = {"res": "SELECT ex.*, t.s AS top_score, t.s IS NOT NULL AS retrieved_any, e.value AS latency_ms, ex.example_id % 10 = 9 AS timed_out FROM ex LEFT JOIN (SELECT example_id, max(score) AS s FROM top GROUP BY 1) t ON t.example_id = ex.example_id LEFT JOIN events e ON e.event_id = ex.example_id"}


@query(w("ex top", """SELECT count(*) AS examples, count(*) FILTER (NOT timed_out) AS completed, count(*) FILTER (timed_out) AS timed_out, count(*) FILTER (NOT should_refuse) AS answerable, count(*) FILTER (should_refuse) AS refusals,
  count(*) FILTER (NOT should_refuse AND mode = 'all') AS all_mode, count(*) FILTER (NOT should_refuse AND mode = 'any') AS any_mode, round(avg(CASE WHEN should_refuse AND NOT timed_out THEN retrieved_any::INT::DOUBLE END), 6) AS negative_retrieved_rate,
  round(avg(latency_ms), 6) AS latency_mean_all, round(avg(CASE WHEN NOT timed_out THEN latency_ms END), 6) AS latency_mean_completed FROM res""", **_RES))
def run_summary(spark, sf):
    """D9 D10 I16"""
    return ev.run_counters(_results(spark, sf))


@query("SELECT event_type, quantile_disc(value, 0.5)::DOUBLE AS p50, quantile_disc(value, 0.95)::DOUBLE AS p95, max(value)::DOUBLE AS p100, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    """D11 K17"""
    return ev.latency_percentiles(v.table(spark, sf, "events"), "value", ("event_type",))


@query(w("met ex top pr", """SELECT 'bm25' AS config, category, count(*) AS examples, round(avg(coalesce(recall_at_3, 0)), 6) AS recall_at_3, round(avg(coalesce(page_hit, 0)), 6) AS page_hit, round(avg(coalesce(quote_hit, 0)), 6) AS quote_hit, NULL::DOUBLE AS retrieved_rate, NULL::DOUBLE AS top_score_median FROM ct WHERE NOT should_refuse GROUP BY 2
  UNION ALL SELECT 'bm25', '(all)', count(*), round(avg(coalesce(recall_at_3, 0)), 6), round(avg(coalesce(page_hit, 0)), 6), round(avg(coalesce(quote_hit, 0)), 6), NULL, NULL FROM ct WHERE NOT should_refuse HAVING count(*) > 0
  UNION ALL SELECT 'bm25', '(refusal)', count(*), NULL, NULL, NULL, round(avg(retrieved_any::INT::DOUBLE), 6), round(median(top_score), 6) FROM ct WHERE should_refuse HAVING count(*) > 0""", **_RES,
  ct="SELECT res.*, max(value) FILTER (metric = 'recall_at_3') AS recall_at_3, max(value) FILTER (metric = 'page_hit') AS page_hit, max(value) FILTER (metric = 'passage_hit') AS quote_hit FROM res LEFT JOIN met USING (example_id) GROUP BY ALL"))
def category_table(spark, sf):
    """D12 I22"""
    wide = v.sparse_metrics(spark, sf).groupBy("example_id").pivot("metric", ["recall_at_3", "page_hit", "passage_hit"]).agg(F.first("value"))
    rows = _results(spark, sf).join(wide, "example_id", "left").select(F.lit("bm25").alias("config"), "category", "should_refuse", "recall_at_3", "page_hit", F.col("passage_hit").alias("quote_hit"), "retrieved_any", "top_score")
    return ev.category_table(rows)


@query(w("met pr ex", "SELECT example_id, value AS reported, (prank IS NOT NULL)::INT::DOUBLE AS recomputed, abs(value - (prank IS NOT NULL)::INT) < 1e-9 AS agrees FROM met JOIN pr USING (example_id) WHERE metric = 'passage_hit'"))
def evidence_hit_rate(spark, sf):
    """Containment of the quote among retrieved passages, recomputed by a join and held against the metric."""
    c, index = v.default_index(spark, sf)
    top = search.sparse_search(v.questions(spark, sf), index, v.TOP_K).join(c.select("chunk_id", "text"), "chunk_id")
    e = v.examples(spark, sf).where(~F.col("should_refuse")).select("example_id", "quote")
    seen = top.join(e, top.query_id == e.example_id).where(F.contains(tx.without_space(F.col("text")), tx.without_space(F.col("quote")))).select("example_id").distinct().withColumn("recomputed", F.lit(1.0))
    own = v.sparse_metrics(spark, sf).where("metric = 'passage_hit'").select("example_id", F.col("value").alias("reported"))
    d = own.join(seen, "example_id", "left").withColumn("recomputed", F.coalesce("recomputed", F.lit(0.0)))
    return d.select("example_id", "reported", "recomputed", (F.abs(F.col("reported") - F.col("recomputed")) < 1e-9).alias("agrees"))


@query(w("pr ex", "SELECT 'bm25' AS config, count(*) FILTER (prank = 1) AS first, count(*) FILTER (prank > 1) AS later, count(*) FILTER (prank IS NULL) AS absent FROM pr JOIN ex USING (example_id) WHERE n > 0"))
def passage_positions(spark, sf):
    """I20 E4"""
    rows = v.sparse_metrics(spark, sf).where("metric = 'passage_mrr'").select(F.lit("bm25").alias("config"), F.when(F.col("value") > 0, F.round(1 / F.when(F.col("value") > 0, F.col("value"))).cast("int")).alias("rank"))
    return ev.passage_positions(rows)


@query(w("de sp ch hit ex", """SELECT count(*) FILTER (b = 1 AND a = 1) AS kept, count(*) FILTER (b = 1 AND (a IS NULL OR a <> 1)) AS lost, count(*) FILTER (b = 1 AND (a IS NULL OR a > 5)) AS out_of_top_5, count(*) FILTER ((b IS NULL OR b <> 1) AND a = 1) AS rescued, count(*) AS n FROM ab""", **_fuse_blocks(search.FUSIONS["rrf"]),
  ab="SELECT example_id, (SELECT min(rank) FROM sp WHERE rank <= 20 AND sp.query_id = hit.example_id AND split_part(sp.chunk_id, ':', 1) = document_id) AS b, (SELECT min(rank) FROM fr WHERE rank <= 20 AND fr.query_id = hit.example_id AND split_part(fr.chunk_id, ':', 1) = document_id) AS a FROM hit JOIN ex USING (example_id) WHERE ex.n = 1"))
def fusion_displacement(spark, sf):
    """I19"""
    c, index = v.default_index(spark, sf)
    e = v.examples(spark, sf).where("category = 'single'").select("example_id", F.col("hops")[0]["document_id"].alias("document_id"))

    def ranks(top: DataFrame) -> DataFrame:
        own = top.select(F.col("query_id").alias("example_id"), F.split("chunk_id", ":")[0].alias("document_id"), "rank").groupBy("example_id", "document_id").agg(F.min("rank").alias("rank"))
        return e.join(own, ["example_id", "document_id"], "left").select("example_id", "rank")

    q, depth = v.questions(spark, sf), v.TOP_K * v.DEPTH
    dense, sparse = v.channels(q, c, index, depth)
    return ev.displacement(ranks(sparse), ranks(search.fuse(dense, sparse, c, search.FUSIONS["rrf"], depth)))


_PER = "SELECT document_id, count(*) AS c FROM ch GROUP BY 1"


@query(w("ch hit ex", """SELECT example_id, round(greatest(0, least(1, CASE WHEN mode = 'any' THEN 1 - m ELSE CASE WHEN k = 1 THEN 1 - m END END)), 6) AS hit FROM
  (SELECT example_id, mode, k, list_product(list_transform(range(0, 5), lambda j: greatest(0.0, (total - s - j) / (total - j)))) AS m FROM rd) WHERE mode = 'any' OR k = 1""", per=_PER,
  rd="SELECT hit.example_id, any_value(mode) AS mode, sum(c) AS s, count(*) AS k, (SELECT count(*) FROM ch) AS total FROM hit JOIN ex USING (example_id) JOIN per USING (document_id) GROUP BY 1"))
def random_reference(spark, sf):
    """I18"""
    c = v.chunks(spark, sf)
    per = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("c"))
    total = c.agg(F.count(F.lit(1)).alias("total"))
    e = v.examples(spark, sf).where(~F.col("should_refuse"))
    each = e.select("example_id", "mode", F.explode(F.array_distinct(F.transform("hops", lambda h: h["document_id"]))).alias("document_id")).join(per, "document_id", "left")
    rows = each.groupBy("example_id", "mode").agg(F.collect_list(F.coalesce("c", F.lit(0).cast("long"))).alias("counts")).crossJoin(F.broadcast(total))  # one row
    return ev.random_draw(rows).select("example_id", F.round("hit", 6).alias("hit"))


@query(w("ex top", "SELECT should_refuse, count(*) AS n, round(min(top_score), 6) AS low, round(median(top_score), 6) AS mid, round(max(top_score), 6) AS high FROM res GROUP BY 1", **_RES))
def refusal_scores(spark, sf):
    """I22"""
    r = _results(spark, sf)
    one = r.groupBy("should_refuse").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("top_score"), 6).alias("low"), F.round(F.max("top_score"), 6).alias("high"))
    return quantiles.with_ranks(one, r, "top_score", quantiles.MEDIAN, ("should_refuse",)).select("should_refuse", "n", "low", F.round((F.col("lower") + F.col("upper")) / 2, 6).alias("mid"), "high")


@query(w("met", "SELECT metric, round(avg(value), 6) AS value, round(avg(value) FILTER (example_id % 2 = 0), 6) AS baseline, round(avg(value) - avg(value) FILTER (example_id % 2 = 0), 6) AS delta FROM met GROUP BY 1 HAVING count(*) FILTER (example_id % 2 = 0) > 0"))
def baseline_diff(spark, sf):
    """C11: the run against one over the even examples."""
    long = v.sparse_metrics(spark, sf)
    mean = lambda d: d.groupBy(F.lit("t0").alias("tenant_id"), "metric").agg(F.avg("value").alias("value"))
    return ev.baseline_diff(mean(long), mean(long.where("example_id % 2 = 0")))


# ---- statistics

_LONG = {
    "lg": "SELECT 'bm25' AS config, example_id, metric, value FROM met UNION ALL SELECT 'bm25-at-1', m.example_id, m.metric, x.value FROM met m JOIN met x ON x.example_id = m.example_id AND x.metric = CASE WHEN m.metric LIKE 'recall%' THEN 'recall_at_1' ELSE m.metric END WHERE m.metric LIKE 'recall%'",
    "prs": "SELECT b.config, b.metric, b.example_id, b.value - a.value AS d FROM lg a JOIN lg b ON a.config = 'bm25' AND b.config <> 'bm25' AND a.example_id = b.example_id AND a.metric = b.metric",
    "dd": "SELECT config, metric, list(d ORDER BY example_id) AS d, count(*) AS n FROM prs GROUP BY ALL",
    "it": "SELECT config, metric, n, round(list_sum(list_transform(range(0, n), lambda s: d[(('0x' || substr(md5('42-' || it || '-' || s), 1, 8))::BIGINT % n) + 1])) / n, 9) AS mean FROM dd, (SELECT unnest(range(0, 2000)) AS it)",
    "ms": "SELECT config, metric, list_sort(list(mean)) AS m FROM it GROUP BY ALL",
}


def _two_configs(spark, sf) -> DataFrame:
    long = materialize(v.sparse_metrics(spark, sf))
    at1 = long.where("metric = 'recall_at_1'").select("example_id", F.col("value").alias("v1"))
    other = long.where("metric like 'recall%'").join(at1, "example_id").select(F.lit("bm25-at-1").alias("config"), "example_id", "metric", F.col("v1").alias("value"))
    return long.select(F.lit("bm25").alias("config"), "example_id", "metric", "value").unionByName(other)


@query(w("met", """SELECT config, metric, n, round(list_sum(d) / n, 6) AS delta, round(m[51], 6) AS low, round(m[1951], 6) AS high, round(100 / n, 6) AS step_pp,
  CASE WHEN round(m[51], 6) > 0 THEN 'better' WHEN round(m[1951], 6) < 0 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM dd JOIN ms USING (config, metric)""", **_LONG))
def paired_bootstrap(spark, sf):
    """Recall cut at 1 against the run's own recalls."""
    return statistics.paired_bootstrap(statistics.pairs_of(_two_configs(spark, sf), "bm25"))


@query(w("met", "SELECT config, metric, n, round(list_sum(d) / n, 6) AS delta, round(100 / n, 6) AS step_pp, true AS around FROM dd", **{k: x for k, x in _LONG.items() if k not in ("it", "ms")}))
def bootstrap_cells(spark, sf):
    """The same differences, drawn by cells; whether the interval lies around the difference and is that of the single draws to within two steps."""
    pairs = materialize(statistics.pairs_of(_two_configs(spark, sf), "bm25"))
    single = statistics.paired_bootstrap(pairs).select("config", "metric", F.col("low").alias("l"), F.col("high").alias("h"))
    near = (F.abs(F.col("low") - F.col("l")) * 50 <= F.col("step_pp")) & (F.abs(F.col("high") - F.col("h")) * 50 <= F.col("step_pp"))
    both = statistics.cell_bootstrap(pairs).join(single, ["config", "metric"])
    return both.select("config", "metric", "n", "delta", "step_pp", ((F.col("low") <= F.col("delta")) & (F.col("delta") <= F.col("high")) & near).alias("around"))


_AG = """SELECT 'quality_toxic' AS metric, quality::DOUBLE AS judge, toxic::DOUBLE AS label FROM labels UNION ALL SELECT 'toxic_self', CASE WHEN doc_id % 11 = 0 THEN NULL ELSE toxic END, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END FROM labels"""


def _raters(spark, sf) -> DataFrame:
    d = v.table(spark, sf, "labels")
    one = d.select(F.lit("quality_toxic").alias("metric"), F.col("quality").cast("double").alias("judge"), F.col("toxic").cast("double").alias("label"))
    t = F.col("toxic").cast("double")
    two = d.select(F.lit("toxic_self").alias("metric"), F.when(F.col("doc_id") % 11 != 0, t).alias("judge"), F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 7 == 0, 1 - t).otherwise(t).alias("label"))
    return one.unionByName(two)


@query(f"""WITH r AS ({_AG}), g AS (SELECT metric, count(*) FILTER (judge IS NOT NULL AND label IS NOT NULL) AS n, count(*) FILTER (judge IS NULL) AS unscored, count(*) FILTER (judge IS NOT NULL AND label IS NULL) AS unlabelled,
  count(*) FILTER (judge >= 0.5 AND label >= 0.5) AS tp, count(*) FILTER (judge >= 0.5 AND label < 0.5) AS fp, count(*) FILTER (judge < 0.5 AND label >= 0.5) AS fn, count(*) FILTER (judge < 0.5 AND label < 0.5) AS tn, round(avg(abs(judge - label)), 6) AS mean_absolute_difference FROM r GROUP BY 1),
  h AS (SELECT *, (tp + tn) / n AS o, (tp + fp) / n AS j, (tp + fn) / n AS l FROM g), k AS (SELECT *, j * l + (1 - j) * (1 - l) AS e FROM h), z AS (SELECT *, CASE WHEN e < 1 THEN round((o - e) / (1 - e), 6) END AS kappa FROM k)
  SELECT metric, n, unscored, unlabelled, tp, fp, fn, tn, mean_absolute_difference, kappa, CASE WHEN kappa IS NULL THEN 'undefined' WHEN abs(kappa) < 0.2 THEN 'slight' WHEN abs(kappa) < 0.4 THEN 'fair' WHEN abs(kappa) < 0.6 THEN 'moderate' WHEN abs(kappa) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band,
  round(o, 6) AS agreement, round(j, 6) AS judge_rate, round(l, 6) AS label_rate FROM z""")
def kappa(spark, sf):
    """D17 S6 B15 H20"""
    return statistics.agreement(_raters(spark, sf))


@query(f"""WITH r AS ({_AG}), c AS (SELECT metric, count(*) FILTER (judge >= 0.5 AND label >= 0.5) AS a, count(*) FILTER (judge >= 0.5 AND label < 0.5) AS b, count(*) FILTER (judge < 0.5 AND label >= 0.5) AS c, count(*) AS n FROM r WHERE judge IS NOT NULL AND label IS NOT NULL GROUP BY 1),
  p AS (SELECT metric, it, a, b, c, n, ('0x' || substr(md5('42-' || it || '-' || s), 1, 8))::BIGINT % n AS p FROM (SELECT *, unnest(range(0, n)) AS s FROM c, (SELECT unnest(range(0, 2000)) AS it))),
  x AS (SELECT metric, it, n, count(*) FILTER (p < a) AS tp, count(*) FILTER (p >= a AND p < a + b) AS fp, count(*) FILTER (p >= a + b AND p < a + b + c) AS fn, count(*) FILTER (p >= a + b + c) AS tn FROM p GROUP BY ALL),
  y AS (SELECT metric, (tp + tn) / n AS o, (tp + fp) / n * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n) AS e FROM x), k AS (SELECT metric, list_sort(list(round((o - e) / (1 - e), 9))) AS k, count(*) AS m FROM y WHERE e < 1 GROUP BY 1)
  SELECT metric, round(k[greatest(0, floor(0.025 * m)::INT - 1) + 1], 6) AS low, round(k[least(m - 1, floor(0.975 * m)::INT) + 1], 6) AS high FROM k WHERE m >= 50""")
def kappa_bootstrap(spark, sf):
    """S4"""
    return statistics.kappa_interval(_raters(spark, sf))


@query(f"WITH r AS ({_AG}) SELECT metric, CASE WHEN judge >= 0.5 THEN 'judge too generous' ELSE 'judge too harsh' END AS direction, count(*) AS n FROM r WHERE judge IS NOT NULL AND label IS NOT NULL AND (judge >= 0.5) <> (label >= 0.5) GROUP BY ALL")
def rater_disagreements(spark, sf):
    """S5"""
    return statistics.disagreements(_raters(spark, sf)).groupBy("metric", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT event_type AS config, 'm' || (user_id % 5) AS metric, avg(value) AS value FROM events WHERE user_id % 5 <> 4 GROUP BY ALL), b AS (SELECT event_type AS config, 'm' || (user_id % 5) AS metric, avg(value) AS baseline FROM events WHERE user_id % 5 <> 3 AND event_id % 2 = 0 GROUP BY ALL)
  SELECT config, metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS delta, CASE WHEN baseline IS NULL THEN 'new' WHEN value IS NULL THEN 'missing' WHEN round(value - baseline, 6) < -0.5 THEN 'regression' WHEN round(value - baseline, 6) > 0.5 THEN 'improvement' ELSE 'equal' END AS outcome FROM a FULL JOIN b USING (config, metric)""")
def regression_gate(spark, sf):
    """Event means as metrics, the even events as baseline."""
    e = v.table(spark, sf, "events").withColumn("config", F.col("event_type")).withColumn("metric", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")))
    mean = lambda d: d.groupBy("config", "metric").agg(F.avg("value").alias("value"))
    return statistics.regression_gate(mean(e.where("user_id % 5 <> 4")), mean(e.where("user_id % 5 <> 3 and event_id % 2 = 0")), 0.5)


@query("""WITH a AS (UNPIVOT (SELECT 'events' AS source, count(*)::VARCHAR AS examples, min(event_id)::VARCHAR AS first, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, NULL::VARCHAR AS note FROM events) ON COLUMNS(*) INTO NAME field VALUE value),
  b AS (UNPIVOT (SELECT 'events' AS source, count(*)::VARCHAR AS examples, min(event_id)::VARCHAR AS first, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, 'without errors' AS note FROM events WHERE event_type <> 'error') ON COLUMNS(*) INTO NAME field VALUE value)
  SELECT field, a.value AS current, b.value AS baseline FROM a FULL JOIN b USING (field) WHERE a.value IS DISTINCT FROM b.value""")
def report_identity(spark, sf):
    """In what the run over all events and the one without errors are not comparable."""
    e = v.table(spark, sf, "events")

    def identity(d: DataFrame, note: Column) -> DataFrame:
        one = d.agg(F.lit("events").alias("source"), F.count(F.lit(1)).cast("string").alias("examples"), F.min("event_id").cast("string").alias("first"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), note.alias("note"))
        return one.unpivot([], one.columns, "field", "value").where("value is not null")

    return statistics.same_identity(identity(e, F.lit(None).cast("string")), identity(e.where("event_type <> 'error'"), F.lit("without errors")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (f < 0.5) AS flagged, count(*) FILTER (f >= 0.5 AND f < 1) AS partial, count(*) FILTER (f >= 1) AS \"full\", count(*) FILTER (f = 0 AND c = 0 AND p = 0) AS collapsed, round(avg(f), 4) AS mean_faithfulness, round(avg(c), 4) AS mean_correctness, round(avg(p), 4) AS mean_completeness FROM (SELECT event_type, least(1, greatest(0, floor(value) / 20)) AS f, (user_id % 5) / 4 AS c, (event_id % 3) / 2 AS p FROM events) GROUP BY 1")
def calibration_summary(spark, sf):
    """D18 S8 H20"""
    e = v.table(spark, sf, "events")
    s = e.select("event_type", tx.unit_score(F.floor("value") / 20).alias("faithfulness"), ((F.col("user_id") % 5) / 4).alias("correctness"), ((F.col("event_id") % 3) / 2).alias("completeness"))
    return statistics.calibration_summary(s, ("event_type",))


@query("""SELECT row_id, planted, perturbed FROM (SELECT *, ['The rule was repealed.', 'It applies abroad.', 'No exception exists.'][(row_number() OVER (ORDER BY h, row_id) - 1) % 3 + 1] AS planted, rtrim(answer) || chr(10) || ['The rule was repealed.', 'It applies abroad.', 'No exception exists.'][(row_number() OVER (ORDER BY h, row_id) - 1) % 3 + 1] AS perturbed FROM
  (SELECT conv_id * 1000 + turn AS row_id, text AS answer, md5('42-' || (conv_id * 1000 + turn)) AS h FROM conversations WHERE role = 'assistant' AND trim(text) <> '' ORDER BY h, row_id LIMIT 30))""")
def calibration_plan(spark, sf):
    """The sample of 30 is the plan's own parameter."""
    c = v.table(spark, sf, "conversations").where("role = 'assistant'")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("answer"), F.col("text").alias("expected_answer"), F.lit(1).alias("evidence_count"), F.lit(False).alias("should_refuse"))
    told = ["The rule was repealed.", "It applies abroad.", "No exception exists."]
    return statistics.calibration_plan(rows, told, 30).select("row_id", "planted", "perturbed")


# ---- label sets and audits


def _labels(spark, sf) -> DataFrame:
    """Examples as a label set: document is the first hop (or the item number as a file that is not there)."""
    e = v.examples(spark, sf)
    doc = F.coalesce(F.get("hops", F.lit(0))["document_id"], F.concat(F.lit("x"), F.col("example_id").cast("string")))
    return e.select("example_id", "question", F.concat("question", F.lit(" 17% "), F.col("example_id").cast("string")).alias("answer"), "quote", "category", doc.alias("document_id"), F.when(F.col("example_id") % 5 == 0, 2).otherwise(1).alias("page"))


_LAB = {"lb": "SELECT ex.example_id, question, question || ' 17% ' || ex.example_id AS answer, quote, category, coalesce((SELECT min(document_id) FROM hit WHERE hit.example_id = ex.example_id), 'x' || ex.example_id) AS document_id, CASE WHEN ex.example_id % 5 = 0 THEN 2 ELSE 1 END AS page FROM ex"}


@query(w("ex hit", r"""SELECT example_id, CASE WHEN bool_or(h = document_id) THEN CASE WHEN page = 1 THEN 'verified' ELSE 'other_page' END ELSE 'missing' END AS outcome, count(DISTINCT h) FILTER (h <> document_id) AS other_documents,
  coalesce(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?%?')), lambda n: NOT contains(regexp_replace(quote, '\s+', '', 'g'), n))), ','), '') AS numbers FROM (SELECT lb.*, hit.document_id AS h FROM lb LEFT JOIN hit USING (example_id)) GROUP BY example_id, answer, quote, document_id, page""", **_LAB))
def quote_audit(spark, sf):
    """L2 C6 B10 B11 H17"""
    return audit.quote_audit(_labels(spark, sf), v.pages(spark, sf))


@query(w("ex hit pg", """SELECT count(*) AS examples, count(*) FILTER (trim(question) = '' OR trim(answer) = '' OR trim(quote) = '' OR trim(category) = '') AS missing_fields, count(*) FILTER (document_id NOT IN (SELECT document_id FROM pg)) AS unknown_sources,
  min(length(question))::BIGINT AS shortest, list_sort(list(length(question)))[count(*) // 2 + 1]::BIGINT AS median, max(length(question))::BIGINT AS longest, count(*) - count(DISTINCT question) - (SELECT coalesce(sum(c - 2), 0) FROM (SELECT count(*) AS c FROM lb GROUP BY question HAVING count(*) > 1))::BIGINT AS duplicate_questions, count(DISTINCT question) AS unique_questions FROM lb""", **_LAB))
def structure_audit(spark, sf):
    """L1 D14 D15 C14"""
    return audit.structure_audit(_labels(spark, sf), v.pages(spark, sf))


@query(w("qs", "SELECT text AS question, count(*) AS n FROM qs GROUP BY 1 HAVING count(*) > 1"))
def duplicate_questions(spark, sf):
    """D14"""
    return v.questions(spark, sf).groupBy(F.col("text").alias("question")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(w("ex hit pg", "SELECT document_id, 'without_questions' AS kind FROM (SELECT DISTINCT document_id FROM pg) WHERE document_id NOT IN (SELECT document_id FROM lb) UNION ALL SELECT document_id, 'unknown_source' FROM (SELECT DISTINCT document_id FROM lb) WHERE document_id NOT IN (SELECT document_id FROM pg)", **_LAB))
def coverage_gaps(spark, sf):
    """C14"""
    return audit.coverage(_labels(spark, sf), v.pages(spark, sf))


@query(w("ex hit pg", "SELECT document_id, count(*) AS questions, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) FILTER (page > p) AS out_of_range FROM lb LEFT JOIN (SELECT document_id, max(page) AS p FROM pg GROUP BY 1) USING (document_id) GROUP BY 1", **_LAB))
def page_audit(spark, sf):
    """L3"""
    return audit.page_audit(_labels(spark, sf), v.pages(spark, sf))


@query(w("ex hit", "SELECT coalesce(a.question, b.question) AS question, CASE WHEN b.question IS NULL THEN 'only_source' WHEN a.question IS NULL THEN 'only_copy' WHEN a.page <> b.page THEN 'page' ELSE 'answer' END AS outcome FROM lb a FULL JOIN (SELECT question, CASE WHEN example_id % 4 = 0 THEN page + 1 ELSE page END AS page, CASE WHEN example_id % 3 = 0 THEN 'x' ELSE answer END AS answer FROM lb WHERE example_id % 7 <> 0 UNION ALL SELECT 'extra', 1, 'x') b ON a.question = b.question WHERE a.question IS NULL OR b.question IS NULL OR a.page <> b.page OR a.answer <> b.answer", **_LAB))
def copy_audit(spark, sf):
    """C12 L4 G4"""
    a = _labels(spark, sf)
    b = a.where("example_id % 7 <> 0").select("question", F.when(F.col("example_id") % 4 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.when(F.col("example_id") % 3 == 0, "x").otherwise(F.col("answer")).alias("answer"))
    more = spark.createDataFrame([("extra", 1, "x")], "question string, page int, answer string")
    return audit.copy_audit(a, b.unionByName(more))


_BG = r"list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"
_OV = {
    "fl": r"SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS q, regexp_replace(quote, '\s+', '', 'g') AS t FROM (SELECT b.item_id, qs.text, c.text AS quote FROM benchmark b JOIN qs ON qs.query_id = b.item_id JOIN benchmark c ON c.item_id = b.item_id + 1)",
    "ov": f"SELECT item_id, round(CASE WHEN length(q) < 2 THEN 0 ELSE len(list_intersect({_BG.format('q')}, {_BG.format('t')})) / len({_BG.format('q')}) END, 9) AS o FROM fl",
}


def _neighbour_quotes(spark, sf) -> DataFrame:
    b = v.table(spark, sf, "benchmark").select((F.col("item_id") - 1).alias("query_id"), F.col("text").alias("quote"))
    return v.questions(spark, sf).join(b, "query_id").select(F.col("query_id").alias("item_id"), F.col("text").alias("question"), "quote")


@query(w("qs", "SELECT item_id, round(o, 6) AS overlap FROM ov", **_OV))
def bigram_overlap(spark, sf):
    """Each question against the next item's quote."""
    return _neighbour_quotes(spark, sf).select("item_id", F.round(tx.bigram_overlap(F.col("question"), F.col("quote")), 6).alias("overlap"))


@query(w("qs", "SELECT count(*) AS n, round(l[count(*) // 2 + 1], 6) AS median, round(l[least(count(*) - 1, (count(*) * 0.9)::DOUBLE::INT - CASE WHEN (count(*) * 0.9)::INT > count(*) * 0.9 THEN 1 ELSE 0 END) + 1], 6) AS p90, round(max(o), 6) AS largest FROM ov, (SELECT list_sort(list(o)) AS l FROM ov) GROUP BY l", **_OV))
def overlap_summary(spark, sf):
    """D16"""
    return audit.overlap_summary(_neighbour_quotes(spark, sf))


@query(r"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(c.text || ' 12.5% 404', '[0-9]+(?:\.[0-9]+)?%?')), lambda n: NOT contains(regexp_replace(d.text, '\s+', '', 'g'), n))), ',') AS numbers FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'assistant'")
def unsupported_numbers(spark, sf):
    """H17"""
    c = v.table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" 12.5% 404")).alias("answer"))
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("quote"))
    return c.join(d, "conv_id").select("conv_id", "turn", F.array_join(tx.unsupported_numbers(F.col("answer"), F.col("quote")), ",").alias("numbers"))


@query(r"""WITH s AS (SELECT doc_id::VARCHAR AS d, generate_subscripts(x, 1) AS pos, trim(unnest(x), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), ' ' || chr(10)), '[.;!?]') AS x FROM documents)),
  k AS (SELECT d, pos, trim(replace(s, ' ' || chr(10), chr(10))) AS s FROM s), f AS (SELECT d, pos, s, md5(regexp_replace(s, '\s+', '', 'g')) AS key FROM k WHERE length(s) BETWEEN 15 AND 200 AND NOT regexp_matches(s, '[Cc]opyright|[Ll]icensed under|All rights reserved'))
  SELECT key, count(DISTINCT d) AS documents FROM f GROUP BY 1 HAVING count(DISTINCT d) > 1""")
def shared_sentences(spark, sf):
    """Lines kept apart by joining broken ones with a line break."""
    return audit.shared_sentences(v.pages(spark, sf), join_lines_with="\n", ends=".;!?", boilerplate="[Cc]opyright|[Ll]icensed under|All rights reserved").select("key", "documents")


_TITLES = "SELECT DISTINCT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS title FROM documents WHERE len(string_split(text, ' ')) > 3 AND NOT contains(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2], chr(10))"
_LEAK = r"EXISTS (SELECT 1 FROM tt WHERE contains(regexp_replace(question, '\s+', '', 'g'), regexp_replace(title, '\s+', '', 'g')))"


def _titles(spark, sf) -> DataFrame:
    """The first two words of documents."""
    words = F.split("text", " ")
    return v.table(spark, sf, "documents").where(F.size(words) > 3).select(F.concat(words[0], F.lit(" "), words[1]).alias("title")).where(~F.contains("title", F.lit("\n"))).distinct()


@query(w("ex hit qs", f"""SELECT example_id AS candidate_id, CASE WHEN {_LEAK} THEN 'title_leak' WHEN outcome <> 'verified' THEN 'quote_not_on_page' WHEN others > 0 THEN 'shared_quote' WHEN f <> example_id THEN 'duplicate' END AS reason FROM
  (SELECT lb.example_id, question, CASE WHEN bool_or(hit.document_id = lb.document_id) AND page = 1 THEN 'verified' ELSE 'no' END AS outcome, count(DISTINCT hit.document_id) FILTER (hit.document_id <> lb.document_id) AS others, min(lb.example_id) OVER (PARTITION BY question) AS f FROM lb LEFT JOIN hit USING (example_id) GROUP BY lb.example_id, lb.document_id, page, question)""", **_LAB, tt=_TITLES))
def candidate_gate(spark, sf):
    """L7 B8 B9 H23"""
    return audit.candidate_gate(_labels(spark, sf).withColumnRenamed("example_id", "candidate_id"), v.pages(spark, sf), _titles(spark, sf))


@query(w("ex hit", """SELECT candidate_id, CASE WHEN count(*) <> 2 THEN 'not_two_hops' WHEN count(*) FILTER (side = 'left') <> 1 OR count(*) FILTER (side = 'right') <> 1 THEN 'sides' WHEN count(*) FILTER (ok) <> 2 THEN 'quote_not_on_page' END AS reason FROM
  (SELECT lb.example_id // 2 AS candidate_id, CASE WHEN lb.example_id % 2 = 0 OR lb.example_id % 9 = 0 THEN 'left' ELSE 'right' END AS side, page = 1 AND bool_or(coalesce(hit.document_id = lb.document_id, false)) AS ok FROM lb LEFT JOIN hit USING (example_id) GROUP BY lb.example_id, lb.page) GROUP BY 1""", **_LAB))
def hop_gate(spark, sf):
    """Neighbouring labels as the two sides of a candidate."""
    d = _labels(spark, sf)
    side = F.when((F.col("example_id") % 2 == 0) | (F.col("example_id") % 9 == 0), "left").otherwise("right")
    return audit.hop_gate(d.select(F.floor(F.col("example_id") / 2).alias("candidate_id"), side.alias("side"), "document_id", "page", "quote"), v.pages(spark, sf))


@query(r"""WITH s AS (SELECT conv_id, turn, (length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'ing', ''))) / 3 AS s FROM conversations),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS k, min(turn) OVER (PARTITION BY conv_id) AS f FROM s) SELECT conv_id::VARCHAR AS document_id, turn AS page FROM r WHERE k <= 3 OR turn = f""")
def page_shortlist(spark, sf):
    """Conversations as documents, their turns as pages."""
    c = v.table(spark, sf, "conversations")
    return audit.page_shortlist(c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page"), "text"), ["the", "ing"])


@query("SELECT source || '_x_issuer_Title ' || lang || '_2024.pdf' AS name, 'Title ' || lang AS title FROM documents GROUP BY source, lang")
def titles_from_names(spark, sf):
    """B13"""
    d = v.table(spark, sf, "documents").select(F.concat("source", F.lit("_x_issuer_Title "), "lang", F.lit("_2024.pdf")).alias("name")).distinct()
    return audit.titles_of(d)


@query("""WITH t AS (SELECT DISTINCT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS title FROM documents WHERE len(string_split(text, ' ')) > 3 AND NOT contains(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2], chr(10)))
  SELECT item_id AS question_id, arg_max(title, (length(title), title)) AS leak FROM benchmark b JOIN t ON contains(regexp_replace(b.text, '\\s+', '', 'g'), regexp_replace(title, '\\s+', '', 'g')) GROUP BY 1""")
def title_leaks(spark, sf):
    """The first two words of documents as titles."""
    return audit.title_leaks(v.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), _titles(spark, sf))


@query("""SELECT example_id, reason FROM (SELECT doc_id AS example_id, CASE WHEN toxic = 1 AND (doc_id % 3 = 0 OR doc_id % 4 <> 0) THEN 'refusal_with_evidence' WHEN toxic = 0 AND doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'no_label'
  WHEN toxic = 0 AND doc_id % 4 <> 0 AND doc_id % 6 = 0 THEN 'primary_is_not_first_hop' END AS reason FROM labels) WHERE reason IS NOT NULL""")
def label_rejects(spark, sf):
    """B14"""
    d = v.table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), (F.col("toxic") == 1).alias("should_refuse"))
    hop = F.array(F.struct(F.when(F.col("example_id") % 6 == 0, "other").otherwise("own").alias("document_id"), F.lit(1).alias("page"), F.lit("q").alias("quote")))
    d = d.withColumn("evidence", F.when(F.col("example_id") % 3 == 0, hop).otherwise(F.array().cast("array<struct<document_id:string,page:int,quote:string>>")))
    d = d.withColumn("document_id", F.when(F.col("example_id") % 4 != 0, "own"))
    return audit.label_rejects(d)


# ---- answers


def _answers(spark, sf) -> DataFrame:
    """Assistant turns with citations put in; evidence is the conversation's document and two of its pages."""
    c = v.table(spark, sf, "conversations").where("role = 'assistant'")
    d, k, n = F.concat(F.lit("d"), F.col("conv_id").cast("string")), F.col("conv_id") % 4, F.length("text") % 5
    page = n.cast("string")
    cite = F.when(k == 0, F.concat(F.lit(" ["), d, F.lit(" p."), page, F.lit("] [note]"))).when(k == 1, F.concat(F.lit(" ["), d, F.lit(", page "), page, F.lit("]"))).when(k == 2, F.concat(F.lit(" [d-none p."), page, F.lit("] [1]"))).otherwise(F.concat(F.lit(" ["), d, F.lit(":"), page, F.lit("] ["), d, F.lit("]")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", cite).alias("answer"), F.array(F.struct(d.alias("document_id"), F.lit(1).alias("page")), F.struct(d.alias("document_id"), F.lit(2).alias("page"))).alias("evidence"))


_MARK = r"(?i)(?:pages?|p)\s*\.?\s*([0-9]+)"
_TRIM = r"^[ \t,;|·:–—-]+|[ \t,;|·:–—-]+$"
_CITED = {
    "an": "SELECT conv_id * 1000 + turn AS answer_id, 'd' || conv_id AS d, text || CASE conv_id % 4 WHEN 0 THEN ' [d' || conv_id || ' p.' || n || '] [note]' WHEN 1 THEN ' [d' || conv_id || ', page ' || n || ']' WHEN 2 THEN ' [d-none p.' || n || '] [1]' ELSE ' [d' || conv_id || ':' || n || '] [d' || conv_id || ']' END AS answer FROM (SELECT *, length(text) % 5 AS n FROM conversations WHERE role = 'assistant')",
    "sn": r"SELECT answer_id, d, unnest(regexp_extract_all(answer, '\[([^\[\]]{1,200})\]', 1)) AS raw FROM an",
    "mk": f"SELECT *, regexp_extract(raw, '{_MARK}', 1) AS m, regexp_replace(regexp_replace(raw, '{_MARK}', ''), '{_TRIM}', '', 'g') AS body FROM sn",
    "sx": r"SELECT *, m = '' AND body <> d AND regexp_matches(body, ':\s*[0-9]+\s*$') AND regexp_replace(body, ':\s*[0-9]+\s*$', '') = d AS suffix FROM mk",
    "ci": r"SELECT answer_id, CASE WHEN suffix THEN d ELSE body END AS document_id, d, CASE WHEN suffix THEN regexp_extract(body, ':\s*([0-9]+)\s*$', 1)::INT WHEN m <> '' THEN m::INT END AS page FROM sx WHERE suffix OR body = d OR m <> ''",
    "cs2": "SELECT answer_id, document_id, page, CASE WHEN document_id <> d THEN 'unknown' WHEN page IS NOT NULL AND page NOT IN (1, 2) THEN 'ungrounded' ELSE 'ok' END AS state FROM ci",
}


@query(w("", "SELECT answer_id, count(state) AS citations, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'ungrounded') AS ungrounded, trim(any_value(answer)) <> '' AND count(*) FILTER (state IN ('unknown', 'ungrounded')) = 0 AS usable FROM an LEFT JOIN cs2 USING (answer_id) GROUP BY 1", **_CITED))
def citation_check(spark, sf):
    """C8 H8 H9 J9"""
    return answers.citation_report(_answers(spark, sf))


@query(w("", "SELECT answer_id, document_id, page, state FROM cs2", **_CITED))
def citation_spans(spark, sf):
    """H8"""
    return answers.citations(_answers(spark, sf)).select("answer_id", "document_id", "page", "state")


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0.0 ELSE least(1.0, greatest(0.0, value / 20)) END AS correctness, CASE WHEN event_id % 5 IN (3, 4) THEN 0.0 ELSE 0.5 END AS faithfulness, CASE WHEN event_id % 5 = 4 THEN 'judge response was not valid JSON' ELSE event_type END AS reason FROM (SELECT *, round(value, 2) AS v FROM events)")
def judge_parse(spark, sf):
    """Replies made from the events, fenced, bare, with a bad field, broken."""
    e = v.table(spark, sf, "events")
    number = (F.col("value") / 20).cast("string")
    body = F.concat(F.lit('{"correctness": '), number, F.lit(', "faithfulness": '), F.when(F.col("event_id") % 5 == 3, '"none"').otherwise("0.5"), F.lit(', "reason": "'), "event_type", F.lit('"}'))
    reply = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 4, F.concat(body, F.lit("}"))).otherwise(F.concat(F.lit("Here: "), body))
    d = e.select("event_id", answers.judge_reply(reply).alias("r"))
    return d.select("event_id", "r.correctness", "r.faithfulness", "r.reason")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_id % 3 = 0 AS readable FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 3 <> 0")
def object_reply(spark, sf):
    """H11"""
    e = v.table(spark, sf, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sure: "), "props", F.lit(" end"))).otherwise(F.lit("no object"))
    return e.select("event_id", answers.object_reply(reply, "k long").alias("o")).select("event_id", "o.k", F.col("o").isNotNull().alias("readable"))


@query(w("top ch", "SELECT example_id, md5(string_agg('[' || document_id || ' p.1] ' || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM top GROUP BY 1"))
def context_strings(spark, sf):
    """H7"""
    c, index = v.default_index(spark, sf)
    lists = ev.ranked_lists(search.sparse_search(v.questions(spark, sf), index, v.TOP_K), c)
    return lists.select(F.col("query_id").alias("example_id"), F.md5(answers.context_string(F.col("retrieved"))).alias("digest"))


@query(w("top ch", "SELECT example_id, md5(string_agg(document_id || ':' || substring(text, 1, 400), '|' ORDER BY rank)) AS digest FROM top WHERE rank <= 3 GROUP BY 1"))
def evidence_excerpts(spark, sf):
    """A19"""
    c, index = v.default_index(spark, sf)
    lists = ev.ranked_lists(search.sparse_search(v.questions(spark, sf), index, v.TOP_K), c)
    shown = F.transform(answers.excerpts(F.col("retrieved")), lambda x: F.concat(x["document_id"], F.lit(":"), x["text"]))
    return lists.select(F.col("query_id").alias("example_id"), F.md5(F.array_join(shown, "|")).alias("digest"))


# ---- scalar functions


_EDGE = r"[^\pL\pM\p{Nd}\p{Pc}]"


def _twice(text: str, pattern: str, put: str) -> str:
    """Neighbours are taken up by a match, so what stands right beside one is found by the second pass."""
    one = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"regexp_replace({one}, '{pattern}', '{put}', 'g')"


_ADDED = " call 13800138000 or 913800138000 13800138000,13800138001 id 11010519491231002X."
_PHONES = _twice(f"text || '{_ADDED}'", "(^|[^0-9])1[0-9]{10}($|[^0-9])", r"\1[PHONE]\2")


@query(f"SELECT doc_id, md5({_twice(_PHONES, f'(^|{_EDGE})[0-9]{{17}}[0-9Xx]($|{_EDGE})', chr(92) + '1[ID]' + chr(92) + '2')}) AS digest FROM documents")
def mask_pii(spark, sf):
    """Every text, with phone and identity numbers added; a null text has a null digest."""
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.mask_personal(F.concat("text", F.lit(_ADDED)))).alias("digest"))


@query("SELECT source, substr(sha256(source), 1, 16) AS tenant FROM documents GROUP BY 1")
def tenant_hash(spark, sf):
    """H13"""
    return v.table(spark, sf, "documents").select("source").distinct().select("source", tx.short_hash(F.col("source")).alias("tenant"))


@query(w("rq", "SELECT CASE WHEN length(split_part(path, '/', 4)) >= 4 THEN '/api/' || split_part(path, '/', 3) || '/{id}/x' ELSE path END AS path, count(*) AS n FROM rq GROUP BY 1"))
def path_template(spark, sf):
    """H14"""
    return v.requests(spark, sf).groupBy(tx.path_template(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"source\":\"' || source || '\"}') AS fingerprint FROM documents")
def run_fingerprint(spark, sf):
    """H21"""
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", tx.fingerprint(source=F.col("source"), lang=F.col("lang"), n=F.col("n_chars")).alias("fingerprint"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5(regexp_replace(text, '\s+', '', 'g')) AS bare FROM documents")
def whitespace_forms(spark, sf):
    """B2 K19"""
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.collapse_space(F.col("text"))).alias("collapsed"), F.md5(tx.without_space(F.col("text"))).alias("bare"))


# ---- sources


@query()
def html_extract(spark, sf):
    """A4 B6"""
    d = html.extract(v.table(spark, sf, "pages").select("page_id", "html"))
    return d.select("page_id", F.length("text").alias("characters"), F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 3 = 1 THEN text || ' 土地' ELSE text END, '')) AS digest FROM documents")
def decode_texts(spark, sf):
    """A3: texts as UTF-8, UTF-8 with BOM and GB18030 bytes (with two signs that are no UTF-8 there), decoded again."""
    d = v.table(spark, sf, "documents").select("doc_id", "text")

    @F.pandas_udf("binary")
    def gb18030(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else t.encode("gb18030"))

    utf8 = F.encode("text", "UTF-8")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(F.col("doc_id") % 3 == 1, gb18030(F.concat("text", F.lit(" 土地")))).otherwise(utf8)
    return readers.decoded(d.select("doc_id", raw.alias("content"))).select("doc_id", F.md5("text").alias("digest"))


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, event_type, value FROM events)
  SELECT user_id::VARCHAR AS document_id, 1 AS page, md5('Report ' || user_id || chr(10) || string_agg('log row ' || (i + 2) || ' event: ' || event_id || ' | kind: ' || event_type, chr(10) ORDER BY i)) AS digest FROM r GROUP BY user_id""")
def sheet_lines(spark, sf):
    """A user's events as a worksheet with a title row and a header."""
    e = v.table(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + 2
    rows = e.withColumn("row", n).select("user_id", "row", F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("event_id").cast("string").alias("value")), F.struct(F.lit(2).alias("col"), F.col("event_type").alias("value")))).alias("c")).select("user_id", "row", "c.col", "c.value")
    users = e.select("user_id").distinct()
    head = users.select("user_id", F.explode(F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.concat(F.lit("Report "), F.col("user_id").cast("string")).alias("value")), F.struct(F.lit(2).alias("row"), F.lit(1).alias("col"), F.lit("event").alias("value")), F.struct(F.lit(2).alias("row"), F.lit(2).alias("col"), F.lit("kind").alias("value")))).alias("c")).select("user_id", "c.row", "c.col", "c.value")
    all_cells = rows.unionByName(head).select(F.col("user_id").cast("string").alias("document_id"), F.lit(1).alias("sheet_no"), F.lit("log").alias("sheet"), "row", "col", "value", F.lit("str").alias("value_type"), F.lit("General").alias("number_format"))
    return cells.sheet_pages(all_cells).select("document_id", "page", F.md5("text").alias("digest"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN printf('%g', round(value, 2)) || '%' WHEN 1 THEN CAST(floor(value) AS BIGINT)::VARCHAR ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM events WHERE value IS NOT NULL")
def cell_display(spark, sf):
    """Hundredths under a percent format, whole floats, times."""
    e = v.table(spark, sf, "events").where("value is not null")
    k = F.col("event_id") % 3
    value = F.when(k == 0, (F.round(F.col("value"), 2) / 100).cast("string")).when(k == 1, F.floor("value").cast("double").cast("string")).otherwise(F.col("ts").cast("timestamp").cast("string"))
    return e.select("event_id", cells.display_text(value, F.when(k == 2, "datetime").otherwise("float"), F.when(k == 0, "0.00%").otherwise("General")).alias("shown"))


# ---- telemetry


@query(w("rq", "SELECT CASE WHEN length(split_part(path, '/', 4)) >= 4 THEN '/api/' || split_part(path, '/', 3) || '/{id}/x' ELSE path END AS path, status, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM rq GROUP BY ALL"))
def request_counts(spark, sf):
    """D19 J5"""
    return telemetry.request_counts(v.requests(spark, sf))


_EDGES = ", ".join(f"({i}, {b}, '{b}')" for i, b in enumerate(telemetry.BOUNDS)) + f", ({len(telemetry.BOUNDS)}, 1e300, '+Inf')"


@query(w("rq", f"SELECT split_part(path, '/', 3) AS label, e.bound, count(*) FILTER (elapsed_s <= e.b) AS cumulative, count(*) AS total, round(sum(elapsed_s), 6) AS sum FROM rq, (VALUES {_EDGES}) e(i, b, bound) GROUP BY ALL"))
def latency_histogram(spark, sf):
    """D20 E5 J6"""
    r = v.requests(spark, sf).withColumn("label", F.split("path", "/")[2])
    return telemetry.histogram(r, "elapsed_s", "label")


@query("SELECT event_type, count(*) AS events, count(*) FILTER (value < 10) AS good, round(count(*) FILTER (value < 10) / count(*), 6) AS ratio FROM events GROUP BY 1")
def outcome_totals(spark, sf):
    """Fast events as cache hits."""
    e = v.table(spark, sf, "events").withColumn("outcome", F.when(F.col("value") < 10, "hit").otherwise("miss"))
    return telemetry.outcome_totals(e, "event_type", "outcome", "hit")


@query("SELECT event_type AS config, count(*) FILTER (event_id % 10 <> 0) AS calls, sum(user_id) FILTER (event_id % 10 <> 0)::BIGINT AS tokens, round(sum(user_id) FILTER (event_id % 10 <> 0) / 1e6 * 0.042, 6) AS cost, count(*) FILTER (event_id % 10 <> 0) < count(*) AS degraded FROM events GROUP BY 1")
def usage_totals(spark, sf):
    """Users as token numbers, every tenth call failed."""
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("config"), F.col("user_id").alias("tokens"), (F.col("event_id") % 10 != 0).alias("ok"))
    return telemetry.usage_totals(e, e.groupBy("config").agg(F.count(F.lit(1)).alias("expected")))


@query("SELECT 't' || (user_id % 3) AS tenant_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def feedback_counts(spark, sf):
    """Events twice over, as delivered at least once."""
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("feedback_id"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("event_type").alias("kind"))
    return telemetry.feedback_counts(e.unionByName(e))


def _log(spark, sf) -> DataFrame:
    e = v.table(spark, sf, "events")
    outcome = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return e.select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_id") % 4 == 0, "delete").otherwise("upsert").alias("operation"), outcome.alias("outcome"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


@query("SELECT user_id::VARCHAR AS document_id, arg_max(event_id, (ts, event_id)) AS seq, CASE WHEN arg_max(event_id, (ts, event_id)) % 4 = 0 THEN 'delete' ELSE 'upsert' END AS operation FROM events GROUP BY 1")
def latest_intent(spark, sf):
    """E6 J2"""
    return telemetry.latest_intent(_log(spark, sf)).select("document_id", "seq", "operation")


@query("""WITH l AS (SELECT user_id::VARCHAR AS document_id, event_id AS seq, ts, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'claimed' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS outcome, 'e' || event_id AS error FROM events),
  s AS (SELECT document_id, max(seq) FILTER (outcome IS NULL) AS since FROM l GROUP BY 1), d AS (SELECT l.* FROM l JOIN s USING (document_id) WHERE since IS NULL OR seq >= since),
  o AS (SELECT document_id, count(*) FILTER (outcome = 'failed') AS failures, arg_max(coalesce(outcome, 'pending'), seq) AS last, max(ts) AS latest, arg_max(error, seq) FILTER (outcome = 'failed') AS last_error FROM d GROUP BY 1)
  SELECT document_id, failures, CASE WHEN last = 'done' THEN 'done' WHEN failures >= 3 THEN 'parked' WHEN last = 'claimed' THEN CASE WHEN latest < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTES THEN 'stale' ELSE 'running' END ELSE 'due' END AS state, last_error FROM o""")
def retry_budget(spark, sf):
    """J3"""
    return telemetry.retry_state(_log(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 20")
def oldest_due(spark, sf):
    """F7"""
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "due").otherwise("done").alias("state"))
    return telemetry.oldest_due(e, 20).select("id", "created_at")


@query("SELECT user_id::VARCHAR AS trace_id, count(*) AS spans, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 6) AS duration_ms, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN user_id % 3 = 0 THEN count(*)::INT WHEN user_id % 3 = 1 THEN floor(log2(count(*)))::INT + 1 ELSE least(3, count(*))::INT END AS depth FROM events GROUP BY user_id")
def trace_rollup(spark, sf):
    """A user's events as spans: a chain, a binary tree, or all but two below the second, by user."""
    e = v.table(spark, sf, "events")
    own = Window.partitionBy("user_id").orderBy("event_id")
    d = e.select("user_id", F.row_number().over(own).alias("k"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "error", "x").alias("error"))
    k, shape = F.col("k"), F.col("user_id") % 3
    parent = F.when(shape == 0, k - 1).when(shape == 1, F.floor(k / 2).cast("int")).otherwise(F.least(k - 1, F.lit(2)))
    d = d.select(F.col("user_id").cast("string").alias("trace_id"), k.cast("string").alias("span_id"), F.when(k > 1, parent.cast("string")).alias("parent_id"), "started_at", F.col("started_at").alias("ended_at"), "error")
    return telemetry.trace_rollup(d).select("trace_id", "spans", "duration_ms", "errors", "depth")


@query("""WITH e AS (SELECT user_id, event_id, event_type, (value * 1000)::BIGINT AS took, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  s AS (SELECT user_id, k, CASE WHEN k > 1 THEN k // 4 + (k % 4 > 0)::INT - (k // 4 + (k % 4 > 0)::INT = k)::INT END AS parent, event_type AS name, took FROM e),
  b AS (SELECT user_id, parent AS k, sum(took) AS below FROM s WHERE parent IS NOT NULL GROUP BY ALL)
  SELECT user_id::VARCHAR AS trace_id, name, count(*) AS spans, round(sum(took) / 1000, 3) AS total_ms, round(sum(greatest(took - coalesce(below, 0), 0)) / 1000, 3) AS own_ms FROM s LEFT JOIN b USING (user_id, k) GROUP BY ALL""")
def stage_times(spark, sf):
    """A user's events as spans, four below each, that take as many milliseconds as their value says."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    start = F.col("ts").cast("timestamp")
    d = v.table(spark, sf, "events").select("user_id", F.row_number().over(own).alias("k"), "event_type", start.alias("started_at"), F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1000).cast("long")).alias("ended_at"))
    up = F.ceil(F.col("k") / 4)
    parent = F.when(F.col("k") > 1, F.when(up == F.col("k"), up - 1).otherwise(up))
    return telemetry.stage_times(d.select(F.col("user_id").cast("string").alias("trace_id"), F.col("k").cast("string").alias("span_id"), parent.cast("string").alias("parent_id"), F.col("event_type").alias("name"), "started_at", "ended_at"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT key, event_id, t, k, t AS start, 1 AS n FROM e WHERE k = 1 UNION ALL
    SELECT e.key, e.event_id, e.t, e.k, CASE WHEN e.t - r.start >= 86400 THEN e.t ELSE r.start END, CASE WHEN e.t - r.start >= 86400 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
  SELECT key, event_id, n <= 3 AS allowed, greatest(0, 3 - n)::BIGINT AS remaining, greatest(1, trunc(86400 - (t - start)))::BIGINT AS retry_after FROM r""")
def quota_windows(spark, sf):
    """J7"""
    e = v.table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return quota_decisions(e, 3, 86_400)


@query("SELECT doc_id FROM labels WHERE doc_id % 3 <> 0")
def pending_examples(spark, sf):
    """Labels of multiples of three are finished under the fingerprint."""
    d = v.table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"))
    done = d.where("example_id % 3 = 0").withColumn("fingerprint", F.lit("f1")).unionByName(d.withColumn("fingerprint", F.lit("f0")))
    return ev.pending(d, done, "f1").select(F.col("example_id").alias("doc_id"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id % 2 = 1")
def unsent_examples(spark, sf):
    """A20"""
    d = v.table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("question"), F.col("doc_id").cast("string").alias("document_id"))
    return readers.unsent(d, d.where("doc_id % 2 = 0")).select("doc_id", "lang")


# ---- files, hooks and reports


@query("""SELECT path, reason FROM (SELECT source || '/' || doc_id || ['.txt', '.PDF', '.md', '.zip'][doc_id % 4 + 1] AS path, CASE WHEN doc_id % 4 IN (1, 3) THEN 'unsupported_suffix' WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' END AS reason FROM documents) WHERE reason IS NOT NULL""")
def file_rejects(spark, sf):
    """A1 A2: documents as files of four suffixes."""
    d = v.table(spark, sf, "documents")
    suffix = F.get(F.array(*map(F.lit, (".txt", ".PDF", ".md", ".zip"))), (F.col("doc_id") % 4).cast("int"))
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("length"))
    return readers.split_files(files)[1]


@query(w("ex hit", "SELECT ex.example_id, ex.question, category, should_refuse, mode, count(hit.document_id) AS hops, coalesce(string_agg(hit.document_id, ',' ORDER BY hit.document_id), '') AS documents FROM ex LEFT JOIN hit USING (example_id) GROUP BY ALL"))
def label_files(spark, sf):
    """The label set written as lines of objects with examples below a folder for each category, read and bound to documents."""
    e = v.examples(spark, sf)
    hops = F.transform("hops", lambda h: F.struct(F.concat(h["document_id"], F.lit(".txt")).alias("source_filename"), h["page"].alias("page"), h["quote"].alias("quote")))
    row = F.struct(F.concat_ws("|", F.col("example_id").cast("string"), "question").alias("question"), F.col("answer").alias("expected_answer"), "category", "should_refuse", F.col("mode").alias("evidence_mode"), hops.alias("expected_evidence"))
    path = folder(spark)
    readers.nested(e.select("category", row.alias("r")), "category").select("category", F.to_json(F.struct(F.col("rows.r").alias("examples"))).alias("value")).write.partitionBy("category").text(path)
    read = readers.label_set(spark, path, lines=True).withColumn("example_id", F.split("question", r"\|")[0].cast("long")).withColumn("question", F.substring_index("question", "|", -1))
    files = v.pages(spark, sf).select(F.concat("document_id", F.lit(".txt")).alias("filename"), "document_id")
    bound = readers.bind_hops(read, files)
    return bound.select("example_id", "question", "category", "should_refuse", "mode", F.size("hops").cast("long").alias("hops"), F.array_join(F.array_sort(F.transform("hops", lambda h: h["document_id"])), ",").alias("documents"))


@query(w("qs", "SELECT query_id::VARCHAR AS item, text AS question, (query_id % 7)::INT AS page FROM qs"))
def label_csv(spark, sf):
    """The flat label set written as CSV and read again."""
    path = folder(spark)
    v.questions(spark, sf).select(F.col("query_id").alias("item"), F.col("text").alias("question"), (F.col("query_id") % 7).alias("page")).write.option("escape", '"').csv(path, header=True)
    return readers.label_csv(spark, path).select("item", "question", "page")


@query(w("met ex", "SELECT 'bm25' AS config, ex.example_id::VARCHAR AS example_id, question, category, should_refuse, round(max(value) FILTER (metric = 'mrr'), 6) AS mrr FROM ex LEFT JOIN met USING (example_id) GROUP BY ALL"))
def artifact_rows(spark, sf):
    """An experiment artifact written as JSON, its examples read with their config."""
    per = v.sparse_metrics(spark, sf).groupBy("example_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    e = v.examples(spark, sf).join(per, "example_id", "left").select(F.col("example_id").cast("string").alias("example_id"), "question", "category", "should_refuse", "metrics")
    path = folder(spark)
    readers.nested(e.withColumn("name", F.lit("bm25")), "name", "per_example").select(F.array(F.struct("name", "per_example")).alias("configs")).write.json(path)
    return readers.artifact_rows(spark, path, lines=True).select("config", "example_id", "question", "category", "should_refuse", F.round(F.col("metrics")["mrr"], 6).alias("mrr"))


@query("SELECT 'c' || (doc_id % 3) AS config, 'q' || doc_id AS question, quality::DOUBLE AS judge, toxic::DOUBLE AS correctness FROM labels WHERE doc_id % 5 <> 0")
def reviewer_files(spark, sf):
    """A reviewer's template filled in, written as an object with labels, read and matched with the judged rows."""
    d = v.table(spark, sf, "labels").select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("config"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.col("quality").cast("double").alias("judge"), "doc_id", "toxic")
    filled = answers.reviewer_template(d.select("config", "question", "judge")).join(d.where("doc_id % 5 <> 0").select("config", "question", "toxic"), ["config", "question"])
    path = folder(spark)
    row = F.struct("config", "question", F.col("toxic").cast("double").alias("correctness"), "note")
    readers.nested(filled.select("config", row.alias("r")), "config").select("config", F.to_json(F.struct(F.col("rows.r").alias("labels"))).alias("value")).write.partitionBy("config").text(path)
    both, _ = answers.match_labels(d.select("config", "question", "judge"), readers.reviewer_labels(spark, path, lines=True))
    return both.select("config", "question", "judge", "correctness")


@query(w("pg ch", "SELECT document_id, document_id || '.txt' AS filename, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, coalesce(n, 0)::INT AS chunks FROM pg LEFT JOIN (SELECT document_id, count(*) AS n FROM ch GROUP BY 1) USING (document_id)"))
def import_manifest(spark, sf):
    """The manifest of an import written as JSON and read again."""
    n = v.chunks(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    text = F.coalesce("text", F.lit(""))
    d = v.pages(spark, sf).join(n, "document_id", "left").select("kb_id", "document_id", F.concat("document_id", F.lit(".txt")).alias("filename"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), F.coalesce("n", F.lit(0)).alias("chunks"))
    path = folder(spark)
    readers.nested(d, "kb_id", "documents").select("documents").write.json(path)
    return readers.import_manifest(spark, path, lines=True)


@query("SELECT unnest(['missing kb_id', 'unexpected label', 'type of vec_id: bigint', (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) || ' doubled keys', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 32) + (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0 AND len(embedding) <> 32) || ' vectors of another dimension']) AS fault")
def index_faults(spark, sf):
    """The vectors with some of them twice against a schema that wants other things."""
    e = v.table(spark, sf, "embeddings")
    wanted = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("embedding", e.schema["embedding"].dataType), T.StructField("kb_id", T.StringType())])
    faults = readers.schema_faults(e.unionByName(e.where("vec_id % 10 = 0")), wanted, "vec_id", "embedding", 32)
    return spark.createDataFrame([(f,) for f in faults], "fault string")


@query(w("met", "SELECT 'example_results' AS part, count(DISTINCT example_id) * 2 AS n FROM met UNION ALL SELECT 'metrics_long', count(*) * 2 FROM met UNION ALL SELECT 'runs', 2"))
def run_store(spark, sf):
    """A run appended twice."""
    long, path = materialize(v.sparse_metrics(spark, sf)), folder(spark)
    for name in ("r1", "r2"):
        own = long.withColumn("run_id", F.lit(name))
        readers.append_run(path, own.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")), own.select("run_id", "example_id").distinct(), own)
    parts = [spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("runs", "example_results", "metrics_long")]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_type AS source_config, event_id, value FROM events")
def grouped_artifact(spark, sf):
    """Events as rows of their type's config, nested as JSON lines and read again."""
    path = folder(spark)
    readers.write_grouped_json(v.table(spark, sf, "events").select(F.col("event_type").alias("source_config"), "event_id", "value"), path)
    return spark.read.schema("source_config string, rows array<struct<event_id:long,value:double>>").json(path).select("source_config", F.explode("rows").alias("r")).select("source_config", "r.event_id", "r.value")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(value * 1000) END AS ms FROM events WHERE value IS NOT NULL")
def span_durations(spark, sf):
    """Spans as long as an event's value in seconds; every fifth has not ended."""
    e = v.table(spark, sf, "events").where("value is not null").withColumn("t", F.col("ts").cast("timestamp"))
    end = F.timestamp_micros(F.unix_micros("t") + F.round(F.col("value") * 1000).cast("long") * 1000)
    return e.select("event_id", tx.duration_ms(F.col("t"), F.when(F.col("event_id") % 5 != 0, end)).alias("ms"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::DOUBLE AS first FROM documents WHERE text IS NOT NULL")
def embedding_hook(spark, sf):
    """A caller's embedding of each distinct text, joined back to the documents."""
    d = v.table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    made = search.embed_with(d, lambda texts: [[float(len(t)), 1.0] for t in texts])
    return d.join(made, "text").select("doc_id", F.md5("text").alias("digest"), F.get("vector", F.lit(0)).alias("first"))


@query(w("sp ch qs", "SELECT query_id, chunk_id, rank::INT AS rank, degraded FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, page, text, chunk_id) AS rank FROM (SELECT sp.query_id, sp.chunk_id, ch.page, ch.text, sp.query_id % 3 = 0 AS degraded, CASE WHEN sp.query_id % 3 = 0 THEN score ELSE length(ch.text) END AS own FROM sp JOIN ch USING (chunk_id) WHERE sp.rank <= 20)) WHERE rank <= 5"))
def reranker_hook(spark, sf):
    """M2 M4: a caller's scorer (the passage's length) over BM25 candidates; it fails for every third question."""
    c, index = v.default_index(spark, sf)
    asked = v.questions(spark, sf)
    top = search.sparse_search(asked, index, 20).join(c.select("chunk_id", "page", "text"), "chunk_id")
    marked = top.join(asked.select("query_id", F.when(F.col("query_id") % 3 == 0, "fails").otherwise("works").alias("question")), "query_id")
    got = search.rerank_with(marked.select("query_id", "question", "chunk_id", "score", "page", "text"), lambda q, t: t.str.len().astype(float).where(q == "works"), 5)
    return got.select("query_id", "chunk_id", "rank", "degraded")


@query(w("hit sp ch", "SELECT x.example_id, round(count(best) / count(*), 6) AS recall, round(coalesce(1.0 / min(best), 0), 6) AS mrr FROM (SELECT hit.example_id, hit.document_id, min(rank) AS best FROM hit LEFT JOIN (SELECT query_id, split_part(chunk_id, ':', 1) AS document_id, rank FROM sp WHERE rank <= 5) t ON t.query_id = hit.example_id AND t.document_id = hit.document_id GROUP BY ALL) x GROUP BY 1"))
def evaluator_hooks(spark, sf):
    """M5: the evaluators on inputs and outputs of the BM25 run."""
    c, index = v.default_index(spark, sf)
    lists = ev.ranked_lists(search.sparse_search(v.questions(spark, sf), index, v.TOP_K), c)
    e = v.examples(spark, sf).where(~F.col("should_refuse")).join(lists.withColumnRenamed("query_id", "example_id"), "example_id", "left")
    ids = F.coalesce(F.transform("retrieved", lambda r: r["document_id"]), F.array().cast("array<string>"))
    wanted = F.transform("hops", lambda h: h["document_id"])
    return e.select("example_id", *(F.round(f(ids, wanted), 6).alias(name) for name, f in answers.EVALUATORS.items()))


@query(w("ex hit met top", """SELECT ex.example_id, question, category, mode AS evidence_mode, should_refuse, coalesce((SELECT string_agg(document_id, ',' ORDER BY document_id) FROM hit WHERE hit.example_id = ex.example_id), '') AS sources,
  (SELECT round(value, 6) FROM met WHERE met.example_id = ex.example_id AND metric = 'recall_at_5') AS recall_at_5, (SELECT value > 0 FROM met WHERE met.example_id = ex.example_id AND metric = 'passage_hit') AS quote_hit,
  (SELECT count(*) FROM top WHERE top.example_id = ex.example_id) > 0 AS retrieved_something, coalesce((SELECT round(max(score), 4) FROM top WHERE top.example_id = ex.example_id), 0.0) AS top_score, round(e.value, 1) AS latency_ms FROM ex LEFT JOIN events e ON e.event_id = ex.example_id"""))
def example_export(spark, sf):
    """I17"""
    c, index = v.default_index(spark, sf)
    lists = ev.ranked_lists(search.sparse_search(v.questions(spark, sf), index, v.TOP_K), c).withColumnRenamed("query_id", "example_id")
    e = materialize(v.examples(spark, sf))
    latency = v.table(spark, sf, "events").select(F.col("event_id").alias("example_id"), F.col("value").alias("latency_ms"))
    rows = ev.export_rows(e, lists, ev.example_metrics(e, lists), latency)
    return rows.select("example_id", "question", "category", "evidence_mode", "should_refuse", F.array_join("sources", ",").alias("sources"), F.round("recall_at_5", 6).alias("recall_at_5"), "quote_hit", "retrieved_something", "top_score", "latency_ms")


_DELTA = {
    "q2": r"SELECT query_id, CASE WHEN query_id % 2 = 0 THEN regexp_replace(text, '^\S+ \S+ ', '') ELSE text END AS text FROM qs",
    "qt2": f"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM q2",
    "bm2": "SELECT query_id, chunk_id, sum(round(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e12)::BIGINT) / 1e12 AS score FROM qt2 JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (chunk_id), cs GROUP BY ALL",
    "sp2": "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm2 WHERE score > 0",
    "mr2": "SELECT example_id, CASE WHEN any_value(mode) = 'any' THEN coalesce(1.0 / min(rank), 0) ELSE sum(coalesce(1.0 / rank, 0)) / count(*) END AS value FROM (SELECT hit.example_id, ex.mode, hit.document_id, min(rank) AS rank FROM hit JOIN ex USING (example_id) LEFT JOIN (SELECT query_id, split_part(chunk_id, ':', 1) AS document_id, rank FROM sp2 WHERE rank <= 5) t ON t.query_id = hit.example_id AND t.document_id = hit.document_id GROUP BY ALL) GROUP BY 1",
}


@query(w("met qs post ts dl cs hit ex", "SELECT 'mrr' AS metric, round(a, 6) AS original, round(b, 6) AS without_titles, round(b - a, 6) AS delta, (SELECT count(*) FROM qs JOIN q2 USING (query_id) WHERE qs.text <> q2.text) AS changed FROM (SELECT avg(value) AS a FROM met WHERE metric = 'mrr'), (SELECT avg(value) AS b FROM mr2)", **_DELTA))
def difficulty_delta(spark, sf):
    """A question's first two words as its document's title, bracketed, for every other question."""
    c, index = v.default_index(spark, sf)
    e = materialize(v.examples(spark, sf))

    def measure(asked: DataFrame) -> DataFrame:
        lists = ev.ranked_lists(search.sparse_search(asked, index, v.TOP_K), c).withColumnRenamed("query_id", "example_id")
        return ev.example_metrics(e, lists).where("metric = 'mrr'")

    named = F.when(F.col("query_id") % 2 == 0, F.regexp_replace("text", r"^(\S+ \S+) ", "《$1》 ")).otherwise(F.col("text"))
    return ev.difficulty_delta(v.questions(spark, sf).select("query_id", named.alias("text")), measure)


_SET = {
    **_LAB, "tt": _TITLES,
    "hp": "SELECT ex.example_id, hit.document_id, CASE WHEN ex.example_id % 5 = 0 THEN 2 ELSE 1 END AS page FROM hit JOIN ex USING (example_id)",
    "ov1": f"SELECT round(CASE WHEN length(q) < 2 THEN 0 ELSE len(list_intersect({_BG.format('q')}, {_BG.format('t')})) / len({_BG.format('q')}) END, 9) AS o, example_id FROM (SELECT example_id, regexp_replace(question, '\\s+', '', 'g') AS q, regexp_replace(quote, '\\s+', '', 'g') AS t FROM ex WHERE n > 0)",
}


def _overlap_rows(name: str, where: str) -> str:
    return f"SELECT '{name}', i, round(list_sort(l)[CASE i WHEN 'median' THEN len(l) // 2 + 1 WHEN 'p90' THEN least(len(l) - 1, floor(len(l) * 0.9::DOUBLE)::INT) + 1 ELSE len(l) END], 6) FROM (SELECT list(o) AS l FROM ov1 WHERE {where}), (SELECT unnest(['median', 'p90', 'largest']) AS i) WHERE len(l) > 0"


@query(w("ex hit qs", f"""SELECT section, item, value::DOUBLE AS value FROM (
  SELECT 'examples' AS section, 'all' AS item, count(*)::DOUBLE AS value FROM ex UNION ALL SELECT 'examples', 'refusals', count(*) FILTER (should_refuse) FROM ex UNION ALL SELECT 'examples', 'multiple_hops', count(*) FILTER (n > 1) FROM ex
  UNION ALL SELECT 'questions', 'unique', count(DISTINCT question) FROM ex UNION ALL SELECT 'questions', 'duplicated', count(*) FROM (SELECT question FROM ex GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'questions', 'naming_a_document', count(*) FROM ex WHERE {_LEAK}
  UNION ALL SELECT 'categories', category, count(*) FROM ex GROUP BY category UNION ALL SELECT 'modes', mode, count(*) FROM ex WHERE NOT should_refuse GROUP BY mode
  UNION ALL SELECT 'hops', CASE page WHEN 1 THEN 'verified' ELSE 'other_page' END, count(*) FROM hp GROUP BY page UNION ALL SELECT 'hops', 'page_out_of_range', count(*) FROM hp WHERE page > 1
  UNION ALL {_overlap_rows('overlap', 'true')} UNION ALL {_overlap_rows('overlap_of_comparison', 'example_id % 2 = 0')})""", **_SET))
def generated_set_audit(spark, sf):
    """The label set with a wrong page for every fifth example, against its even examples."""
    e = materialize(v.examples(spark, sf))
    page = F.when(F.col("example_id") % 5 == 0, 2).otherwise(1)
    off = e.withColumn("hops", F.transform("hops", lambda h: F.struct(h["document_id"].alias("document_id"), page.alias("page"), h["quote"].alias("quote"))))
    return audit.generated_set_audit(off, v.pages(spark, sf), _titles(spark, sf), e.where("example_id % 2 = 0"))


@query(w("ch", "SELECT document_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM ch GROUP BY 1"))
def ingest_stream(spark, sf):
    """The documents as a stream into a versioned chunk table."""
    schema = v.table(spark, sf, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/{{documents.parquet}}")  # a pattern, as a stream takes no single file; the table is a file or a folder of parts
    path = folder(spark)
    jobs.ingest_documents(arriving.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return jobs.current_rows(spark, f"{path}/table", "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query("SELECT count(*) AS exact, true AS enough FROM (SELECT q.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC) AS k FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0) WHERE k <= 10")
def ann_recall(spark, sf):
    """whether the probed cells hold at least nine tenths of the exact neighbours."""
    exact, near = cosine_topk(spark, sf).select("query_id", "chunk_id"), ann_topk(spark, sf).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = exact.join(near, ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("exact"), (F.coalesce(F.sum("found"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("enough"))
