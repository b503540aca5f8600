"""The bootstrap by cells: its draws, its intervals against drawing single examples, and many examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import statistics


def test_draws_of_blocks_add_up():
    sizes = np.array([5, 0, 40, 1, 300, 7, 7])
    parts = np.stack([statistics.draws_of_block(sizes, b, 4000, 3) for b in range(len(sizes))])
    assert (parts.sum(axis=0) == sizes.sum()).all() and (parts[1] == 0).all()
    n, p = sizes.sum(), sizes / sizes.sum()
    assert np.allclose(parts.mean(axis=1), n * p, atol=5 * np.sqrt(n / 4000) / 2)
    assert np.allclose(parts.var(axis=1), n * p * (1 - p), rtol=0.2, atol=0.2)
    assert np.allclose(np.cov(parts[4], parts[2])[0, 1], -n * p[4] * p[2], rtol=0.3)


@pytest.mark.parametrize("cells", [1 << 12, 7])
def test_intervals_against_single_draws(spark, monkeypatch, cells):
    monkeypatch.setattr(statistics, "CELLS", cells)
    rng = np.random.default_rng(2)
    rows = [("a", m, i, 0.25, 0.25 + float(x)) for m, values in (("few", rng.choice([-1, 0, 0, 1, 1], 200)), ("many", rng.normal(0.1, 1, 200))) for i, x in enumerate(values)]
    rows += [("b", "few", i, 0.0, 1.0) for i in range(3)] + [("b", "same", i, r[3], r[4]) for i, r in enumerate(rows[:200])]
    d = spark.createDataFrame(rows, "config string, metric string, example_id long, ref double, value double").repartition(5)
    got = {(r.config, r.metric): r for r in statistics.cell_bootstrap(d, 1000).collect()}
    for (config, metric), r in got.items():
        x = np.array([v - u for c, m, _, u, v in rows if (c, m) == (config, metric)])
        means = np.sort(np.random.default_rng(9).choice(x, (4000, len(x))).mean(axis=1))
        error = x.std() / np.sqrt(len(x))
        assert r.n == len(x) and abs(r.delta - x.mean()) < 1e-6
        assert abs(r.low - means[100]) <= 0.35 * error + 1e-9 and abs(r.high - means[3900]) <= 0.35 * error + 1e-9
    assert (got["b", "few"].low, got["b", "few"].verdict) == (1.0, "better")
    assert (got["a", "few"].low, got["a", "few"].high) == (got["b", "same"].low, got["b", "same"].high)  # equal cells, equal draws
    again = {(r.config, r.metric): r for r in statistics.cell_bootstrap(d.repartition(2), 1000).collect()}
    assert got == again and statistics.cell_bootstrap(d.limit(0), 100).count() == 0


def test_ten_million_examples(spark):
    d = spark.range(0, 10_000_000, 1, 8).select(F.lit("c").alias("config"), F.lit("recall").alias("metric"), F.col("id").alias("example_id"), (F.col("id") % 2).cast("double").alias("ref"), (F.col("id") % 5 > 1).cast("double").alias("value"))
    r = statistics.cell_bootstrap(d).first()
    error = np.sqrt((0.5 - 0.1**2) / 1e7)
    assert r.n == 10_000_000 and abs(r.delta - 0.1) < 1e-6 and abs(r.low - (0.1 - 1.96 * error)) < 0.2 * error and abs(r.high - (0.1 + 1.96 * error)) < 0.2 * error and r.verdict == "better"


def test_kappa_intervals_against_single_draws_in_many_tasks(spark, monkeypatch):
    """Every draw is that of its own hash, whatever groups share it; the draws are dealt to tasks by their number, which their few rows don't show."""
    import hashlib

    monkeypatch.setattr(statistics, "SLOTS", 1 << 8)
    monkeypatch.setattr(statistics, "DRAWS", 1 << 14)
    cells = {"a": (300, 200, 100, 400), "b": (3, 2, 1, 4), None: (200, 1, 1, 55), "two": (1, 0, 0, 1), "same": (4, 0, 0, 0)}
    rows = [(g, *r) for g, n in cells.items() for r, k in zip([(1.0, 0.5), (0.5, 0.0), (0.0, 1.0), (0.2, 0.4)], n, strict=True) for _ in range(k)]
    d = spark.createDataFrame(rows + [("a", None, 1.0), ("b", 1.0, None)], "metric string, judge double, label double")
    want, times = {}, 110
    for g, (a, b, c, rest) in cells.items():
        n, k = a + b + c + rest, []
        for it in range(times):
            at = [int(hashlib.md5(f"7-{it}-{s}".encode()).hexdigest()[:8], 16) % n for s in range(n)]
            tp, fp, fn = (sum(low <= p < high for p in at) for low, high in ((0, a), (a, a + b), (a + b, a + b + c)))
            e = (tp + fp) / n * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n)
            k += [round(((n - fp - fn) / n - e) / (1 - e), 9)] if e < 1 else []
        if n >= 3 and len(k) >= 50:
            want[g] = (round(sorted(k)[max(0, int(0.025 * len(k)) - 1)], 6), round(sorted(k)[min(len(k) - 1, int(0.975 * len(k)))], 6))
    out = statistics.kappa_interval(d, iterations=times, seed=7)
    got = {r.metric: (r.low, r.high) for r in out.collect()}
    assert set(got) == set(want) == {"a", "b", None} and all(got[g] == pytest.approx(want[g], abs=2e-6) for g in want)
    assert f", {(1000 + 10 + 257 + 4) * times // (1 << 14) + 1}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert statistics.kappa_interval(d.limit(0), iterations=times).count() == 0
