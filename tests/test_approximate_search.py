import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import ann, search
from passagemill.plans.catalog import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    pairs = lambda name: {(r.query_id, r.chunk_id) for r in QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    exact = pairs("cosine_topk")
    assert len(exact & pairs("ann_topk")) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["ann_clustered", "ann_chunks"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_with_few_pairs(spark, sf, name):
    row = QUERIES[name](spark, f"/root/testdata/{sf}").first()
    assert row.found and row.compared_few and (row.spared or sf == "sf0.001" and name == "ann_chunks"), row


def test_far_vectors_are_found(spark):
    """Neighbours of small cosine, and so few cells that next to nothing is probed."""
    e = spark.range(60).select(F.col("id").alias("chunk_id"), F.expr("array(cast(0.1 as double), if(id % 2 = 0, 1, -1) * sqrt(0.99), cast(0 as double))").alias("vector"))
    q = spark.sql("select 1L as query_id, array(1D, 0D, 0D) as vector")
    assert [r.score for r in ann.approximate_search(q, e, 5).collect()] == [0.1] * 5
    assert ann.approximate_search(q, e, 40, probes=1).count() == 40
    assert ann.approximate_search(q, e.limit(0), 5).count() == 0


def test_within_probed_cells_the_result_is_exact(spark, monkeypatch):
    """All cells probed: the codes may let too much through, but lose nothing; also for vectors outside the learned ranges."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    x[:300] = x[0]  # a hot cell
    x[899] = 0
    x[:899] /= np.linalg.norm(x[:899], axis=1, keepdims=True)
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(20, 12)))] + [(99, x[0].tolist())], "query_id long, vector array<double>")
    rows = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in d.collect())
    want = rows(search.dense_search(q, e, 7))
    assert rows(ann.ann_search(q, ann.build_ann(e), 7, probes=10**6)) == want
    assert rows(ann.ann_search(q, ann.build_ann(e, sample_rows=60), 7, probes=10**6)) == want
    monkeypatch.setattr(ann, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(ann, "_BUFFER", 10)
    assert rows(ann.ann_search(q, ann.build_ann(e), 7, probes=10**6)) == want


def test_blocks_give_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = {name: sorted(map(tuple, QUERIES[name](spark, sf).collect())) for name in ("cosine_topk", "ann_topk")}
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(ann, "BROADCAST_QUERIES", 3)
    for name, rows in want.items():
        assert sorted(map(tuple, QUERIES[name](spark, sf).collect())) == rows
