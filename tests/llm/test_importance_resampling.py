"""Operator 13 against plain counting, with one and with several words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from passagemill.llm import importance_resampling as op
from passagemill.llm.ranks import with_rank
from pyspark.sql import functions as F


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1)]


def plain(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, most)[1]) for texts in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, x in docs:
        w, f = features(x, most)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def texts(n, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "d3", "日本", "x" * 80, "is", "of"])
    line = lambda: rng.choice([" ", ", ", "--"]).join(word() for _ in range(rng.randint(0, 9)))
    return [(i, "\n".join(rng.choice([line(), "the same line again", ""]) for _ in range(rng.randint(0, 8)))) for i in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_against_plain_counting(spark, most):
    docs = [*texts(200), (500, None), (501, ""), (502, "word " * 300_000), (7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (503, "a\x00b\r\nc")]
    target = [x for _, x in texts(20, 9)] + [None]
    d = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, score string, rank int").repartition(5)
    b = spark.createDataFrame([(x,) for x in target], "text string")
    got = op.resample(d, b, most=most, buckets=97, percent=30, least_words=5)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == plain(docs, target, most, 97, 30, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.resample(none, none).count() == 0
    docs = texts(30)
    got = op.resample(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == plain(docs, [])


def test_crc():
    data = np.frombuffer(b"123456789" + b"q" * 300, np.uint8)
    assert op.span_crcs(data, np.array([0, 9, 3, 4]), np.array([9, 309, 3, 5])).tolist() == [0xCBF43926, zlib.crc32(b"q" * 300), 0, zlib.crc32(b"5")]


def test_ranks(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 50).alias("v"), "id")
    rows = with_rank(d, [F.asc("g"), F.desc("v"), F.asc("id")], group="g").collect()
    want = sorted(rows, key=lambda r: (r.g, -r.v, r.id))
    assert [r["rank"] for r in want] == [k for g in range(3) for k in range(1, 1 + sum(r.g == g for r in rows))]
    assert with_rank(d.where("id < 0"), [F.asc("v")]).count() == 0
