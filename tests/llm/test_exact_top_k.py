"""Operator 12 against plain integer arithmetic."""

import math
import random

from passagemill.llm import exact_top_k as op


def plain(rows, asked, k, scale=256):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    big = lambda i: (i is None, i or 0)
    out = []
    for place, (qi, q) in enumerate(sound):
        if asked(qi):
            scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), big(i), i) for p, (i, v) in enumerate(sound) if p != place]
            out += [(qi, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(parts)


def check(spark, rows, k=5):
    d = frame(spark, rows)
    got = sorted(map(tuple, op.exact_top_k(d, d.where("vec_id % 50 = 0"), k).collect()), key=str)
    assert got == plain(rows, lambda i: i is not None and i % 50 == 0, k)


def vectors(n, d, seed=1):
    rng = random.Random(seed)
    # eighths are exact as floats; few values, so scores tie
    return [(i, [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.5, 2.0]) for _ in range(d)]) for i in range(n)]


def test_random(spark):
    check(spark, vectors(400, 20))
    check(spark, vectors(120, 3), k=200)


def test_thresholds_from_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "SMALL", 4)
    monkeypatch.setattr(op, "PART", 4)
    check(spark, vectors(500, 17))
    hot = [1.0] * 16
    check(spark, [(i, hot if i % 3 else v) for i, v in vectors(600, 16)])


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(op, "QUERY_BLOCK", 3)
    check(spark, vectors(400, 9))


def test_odd_rows(spark):
    bad = [(50, None), (100, [None, 1.0, 2.0]), (150, [math.nan] * 3), (200, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (None, None)]
    check(spark, [(0, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [0.5, 0.5, 0.5]), (1, [9.0, 0.0, 0.0]), (0, [1.0, 2.0, 3.0]), *bad])
    check(spark, [(0, [1.0, -2.0]), (1, [4.0]), (2, []), (50, [1.0, 1.0, 7.0])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(0, [3e6, -3e6]), (1, [2e6, 1.0]), (50, [-5e6, 5e6]), (2, [1e7, 1e7])])
    assert op.exact_top_k(frame(spark, []), frame(spark, []), 5).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])]
    d = frame(spark, rows)
    got = [(r.vec_id, r.score) for r in op.exact_top_k(d, d.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got[0] == (1, 2**63 - 1) and got[2] == (2, -(2**63)) and got[1][0] == 3


def test_survivors_fall_on_the_way():
    import numpy as np

    rng = np.random.default_rng(0)
    columns = np.floor(rng.normal(size=(64, 2000)) * 40)
    query = columns[:, 7].copy()
    every = query @ columns
    at, score = op.survivors(query, op._mass_left(query[:, None])[:, 0], columns, op._mass_left(columns), float(np.sort(every)[-5]))
    assert set(np.argsort(-every)[:5]) <= set(at) and (score == every[at]).all() and len(at) < 200
