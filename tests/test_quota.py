import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators.quota import _split_runs, quota_decisions
from passagemill.sources.scratch import materialize, noted


def fold(rows, limit, seconds):
    """One pass over each key's events in order."""
    out, state = [], {}
    for k, e, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        start, n = state.get(k, (None, 0))
        if start is None or t - start >= seconds * 1_000_000:
            start, n = t, 0
        state[k] = start, n + 1
        out.append((k, e, n < limit, max(0, limit - n - 1), max(1, int((seconds * 1_000_000 - t + start) // 1_000_000))))
    return out + [(k, e, None, None, None) for k, e, t in rows if t is None]


def decided(spark, rows, limit, seconds, ranges):
    d = spark.createDataFrame([(k, e, t, "x") for k, e, t in rows], "key string, event_id long, t long, block string")
    got = quota_decisions(d.withColumn("ts", F.timestamp_micros("t")), limit, seconds, ranges)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("seconds", [1, 45, 700, 100_000])
def test_split_keys_equal_a_fold(spark, seconds):
    """A hot key, a null key, ties across ranges, gaps longer than a range, repeated rows and rows without a time."""
    rng, rows = random.Random(seconds), []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", None, "a", f"k{i}"])
        burst = rng.choice([0, 3000, 3001, 50_000])
        rows.append((key, i, None if i % 97 == 0 else (burst + rng.randint(0, 900)) * 1_000_000 - 10**9))
    rows += [("hot", 5000 + i, 3_000 * 1_000_000) for i in range(150)] + [("hot", 7000, 7)] * 30
    assert decided(spark, rows, 3, seconds, 9) == sorted(fold(rows, 3, seconds), key=repr)


def test_whole_keys_and_empty_tables(spark):
    rows = [(f"k{i % 7}", i, i * 400_000) for i in range(100)]
    assert decided(spark, rows, 2, 3, 1) == sorted(fold(rows, 2, 3), key=repr)
    assert decided(spark, [], 2, 3, None) == [] and decided(spark, [("a", 1, None)], 2, 3, None) == [("a", 1, None, None, None)]


def test_a_key_of_a_million_events_lies_in_many_ranges(spark):
    """Windows of about 700 events, none of which a border of ranges meets in the same place; no range holds much over its share."""
    d = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 10_007 + F.col("id") % 7).alias("ts"))
    with noted() as made:
        got = materialize(quota_decisions(d, 100, 7, 16))
    sizes = [r["count"] for r in made[0].groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 200_000
    starts, n = [], 0
    last = None
    for i in range(1_000_000):
        t = i * 10_007 + i % 7
        if last is None or t - last >= 7_000_000:
            last, n = t, n + 1
            starts.append(i)
    assert got.where("remaining = 99").count() == n and [r[0] for r in got.where("remaining = 99").orderBy("event_id").select("event_id").collect()] == starts
    assert got.where("allowed").count() == sum(min(100, b - a) for a, b in zip(starts, starts[1:] + [1_000_000]))
    assert _split_runs(made[0]).count() == 16
