"""Order statistics against sorting, and a group of five million distinct values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import evaluation, quantiles
from passagemill.operators.quantiles import MEDIAN, at_ranks, disc, place

ASKS = {"p50": disc(0.5), "p95": disc(0.95), "p100": disc(1.0), "first": lambda n: F.lit(1), "p90": place(0.9), **MEDIAN}


def plain(values):
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    n = len(x)
    of = lambda p: x[next(k for k in range(1, n + 1) if k / n >= p) - 1]
    return of(0.5), of(0.95), x[-1], x[0], x[min(n - 1, int(n * 0.9))], x[(n + 1) // 2 - 1], x[n // 2]


@pytest.mark.parametrize("few,buckets", [(1 << 14, 1 << 10), (3, 2), (5, 64)])
def test_against_sorting(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = random.Random(few)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(101)], "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(120)], "same": [7.0] * 60, "one": [3.0], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(40)],
        "ends": [math.inf, -math.inf, math.nan, 1.0, 2.0, 1.7e308, -1.7e308], "nan": [math.nan] * 3 + [1.0], "inf": [math.inf] * 4 + [-math.inf], None: [0.0, -0.0, 5.0, 5e-324],
    }
    rows = [(g, v) for g, x in groups.items() for v in x] + [("empty", None), ("one", None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: tuple(r[a] for a in ASKS) for r in at_ranks(d, "v", ASKS, ("g",)).collect()}
    alike = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    assert all(alike(a, b) for g, v in groups.items() for a, b in zip(got[g], plain(v), strict=True))
    assert got.keys() == groups.keys()


def test_without_groups_and_empty(spark):
    d = spark.createDataFrame([(1,), (5,), (9,)], "v int")
    assert at_ranks(d, "v", {"m": disc(0.5)}).first().m == 5.0
    row = evaluation.latency_percentiles(d.limit(0), "v").first()
    assert row.p50 is None and row.p100 is None
    assert evaluation.latency_percentiles(d.limit(0).withColumn("g", F.lit(1)), "v", ("g",)).count() == 0


def test_five_million_distinct_values(spark):
    n = 5_000_000
    d = spark.range(0, n, 1, 16).select((F.exp(F.col("id") * 2654435761 % 4294967296 / 2e8)).alias("v"), F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("g"))
    got = {r.g: (r.p50, r.p95) for r in evaluation.latency_percentiles(d, "v", ("g",)).collect()}
    i = np.arange(n, dtype=np.uint64)
    x = (i * np.uint64(2654435761) % np.uint64(4294967296)).astype(float) / 2e8
    for g, own in (("small", x[::1000]), ("large", np.delete(x, np.s_[::1000]))):
        own = np.sort(own)
        assert len(np.unique(own)) == len(own)
        want = [math.exp(own[math.ceil(p * len(own)) - 1]) for p in (0.5, 0.95)]
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[g], want, strict=True))
