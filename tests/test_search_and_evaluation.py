import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagemill.operators import corpus, evaluation, search, statistics
from passagemill.operators.containment import containing
from passagemill.operators.index import build_index

TEXTS = {"a": "cats and dogs live here", "b": "dogs dogs and more dogs", "c": "土地 承包 法", "d": "nothing to see", "e": "cats sleep", "f": "a long text on cats, dogs, birds and other animals of the land"}


def plain_bm25(texts, query):
    docs = {k: t.lower().replace(",", "").split() for k, t in texts.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for k, words in docs.items():
        tf, s = Counter(words), 0.0
        for q in dict.fromkeys(query.lower().split()):
            df = sum(q in d for d in docs.values())
            if tf[q]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s > 0:
            out[k] = s
    return out


def test_bm25_against_plain_python(spark):
    texts = {k: t for k, t in TEXTS.items() if k != "c"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "cats dogs"), (2, "absent"), (3, "and and")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in search.sparse_scores(queries, build_index(chunks)).collect()}
    want = {(i, k): s for i, q in ((1, "cats dogs"), (2, "absent"), (3, "and and")) for k, s in plain_bm25(texts, q).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 801), ("d", 2, ""), ("d", 3, "  y  z "), ("e", 1, None)], "document_id string, page int, text string")
    rows = {r.chunk_id: (r.page, len(r.text)) for r in corpus.chunk_pages(pages).collect()}
    assert rows == {"d:0": (1, 800), "d:1": (1, 121), "d:2": (3, 3)}
    with pytest.raises(ValueError):
        corpus.chunk_pages(pages, 10, 10)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def test_fusion_ties_and_truncation(spark):
    chunks = spark.createDataFrame([("x", 2, "b"), ("y", 1, "a"), ("z", 1, "c")], "chunk_id string, page int, text string")
    dense, sparse = ranking(spark, [(1, "x", 0.9, 1), (1, "y", 0.5, 2)]), ranking(spark, [(1, "y", 7.0, 1), (1, "x", 3.0, 2), (1, "z", 1.0, 3)])
    order = lambda d: [r.chunk_id for r in d.orderBy("rank").collect()]
    assert order(search.fuse(dense, sparse, chunks, search.fusion("rrf"), 5)) == ["y", "x", "z"]  # equal score and rank: the earlier page
    assert order(search.fuse(dense, sparse, chunks, search.Fusion(truncate=1), 5)) == ["y", "x"]
    convex = {r.chunk_id: r.score for r in search.fuse(dense, sparse, chunks, search.fusion("convex"), 5).collect()}
    assert convex == {"x": pytest.approx(1 + 2 / 6), "y": pytest.approx(1.0), "z": pytest.approx(0.0)}
    with pytest.raises(ValueError):
        search.fusion("none")


def test_metrics(spark):
    hop = "struct<document_id:string,page:int,quote:string>"
    ex = spark.createDataFrame([(1, "all", [("a", 1, "q one"), ("b", 1, "zz")]), (2, "any", [("a", 1, ""), ("c", None, "")]), (3, "all", [])], f"example_id int, mode string, hops array<{hop}>")
    got = spark.createDataFrame([(1, [(1, "a:0", "a", 1, "q  one", 2.0), (2, "x:0", "x", 1, "", 1.0), (3, "b:0", "b", 2, "", 0.5)]), (2, [(1, "c:0", "c", 9, "t", 1.0)])], "example_id int, retrieved array<struct<rank:int,chunk_id:string,document_id:string,page:int,text:string,score:double>>")
    m = {(r.example_id, r.metric): r.value for r in evaluation.example_metrics(ex, got).collect()}
    assert m[1, "recall_at_1"] == 0.5 and m[1, "recall_at_3"] == 1.0 and m[1, "mrr"] == pytest.approx((1 + 1 / 3) / 2)
    assert m[1, "ndcg_at_3"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert m[1, "precision_at_5"] == pytest.approx(2 / 5) and m[1, "page_hit"] == 0.0 and m[1, "passage_hit"] == 0.0 and m[1, "passage_mrr"] == 0.5
    assert m[2, "any_target_at_1"] == 1.0 and m[2, "page_hit"] == 1.0 and (2, "passage_hit") not in m
    assert not any(k[0] == 3 for k in m)


def test_containment_finds_short_and_long_quotes(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs off"), (2, "a b c"), (3, None)], "text_id int, text string")
    quotes = spark.createDataFrame([(1, "brown  fox jumps over\nthe lazy dog and"), (2, "b c"), (3, ""), (4, "no such passage anywhere in these texts at all")], "quote_id int, quote string")
    assert {tuple(r) for r in containing(quotes, texts).collect()} == {(1, 1), (2, 2)}


def test_random_draw(spark):
    rows = spark.createDataFrame([("all", [2, 3], 10), ("any", [2, 3], 10), ("all", [4], 10)], "mode string, counts array<bigint>, total bigint")
    got = [r.hit for r in evaluation.random_draw(rows, 3).collect()]
    c = math.comb
    miss = lambda n: c(10 - n, 3) / c(10, 3)
    assert got == [pytest.approx(1 - miss(2) - miss(3) + miss(5)), pytest.approx(1 - miss(5)), pytest.approx(1 - miss(4))]


def test_bootstrap_and_gate(spark):
    long = spark.createDataFrame([(c, i, "m", float(v)) for c, vs in (("a", [0, 0, 1, 0]), ("b", [1, 1, 1, 1])) for i, v in enumerate(vs)], "config string, example_id int, metric string, value double")
    r = statistics.paired_bootstrap(statistics.pairs_of(long, "a"), 300).first()
    assert (r.n, r.delta, r.step_pp) == (4, 0.75, 25.0) and r.low <= 0.75 <= r.high
    with pytest.raises(ValueError):
        statistics.pairs_of(long, "zz")
    a = spark.createDataFrame([("c", "x", 0.5), ("c", "latency_p50", 9.0), ("c", "new", 1.0)], "config string, metric string, value double")
    b = spark.createDataFrame([("c", "x", 0.6), ("c", "latency_p50", 1.0), ("c", "gone", 1.0)], "config string, metric string, value double")
    assert {x.metric: x.outcome for x in statistics.regression_gate(a, b, 0.01).collect()} == {"x": "regression", "new": "new", "gone": "missing"}


def test_kappa(spark):
    rows = spark.createDataFrame([("m", 1.0, 1.0)] * 4 + [("m", 0.0, 0.0)] * 3 + [("m", 1.0, 0.0)] * 2 + [("m", 0.0, 1.0), ("m", None, 1.0), ("m", 1.0, None), ("same", 1.0, 1.0)], "metric string, judge double, label double")
    got = {r.metric: r for r in statistics.agreement(rows).collect()}
    assert got["m"].kappa == pytest.approx((0.7 - 0.5) / 0.5, abs=1e-6) and got["m"].unscored == 1 and got["m"].unlabelled == 1
    assert got["same"].kappa is None and got["same"].band == "undefined"


def test_expand_and_rerank(spark):
    q = spark.createDataFrame([(1, " Apples and pears "), (2, "none")], "query_id int, text string")
    rules = spark.createDataFrame([(1, "App", ["fruit"]), (2, "and", ["plus", "also"]), (3, "pears", ["x"])], "seq int, trigger string, expansion array<string>")
    assert sorted(tuple(r) for r in search.expand(q, rules).collect()) == [(1, 0, "Apples and pears"), (1, 1, "Apples and pears fruit"), (1, 2, "Apples and pears plus also"), (2, 0, "none")]
    cand = spark.createDataFrame([(1, "c1", 1.0, 1, 1, "nothing"), (1, "c2", 0.9, 2, 1, "apples and pears")], "query_id int, chunk_id string, score double, rank int, page int, text string")
    top = search.rerank_lexical(q, cand, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in top] == [("c1", 0.7), ("c2", 0.3)]
