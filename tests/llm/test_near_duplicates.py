"""Recall near the threshold, ids with several texts, and what moves when many texts share a lot without being linked."""

import random

import numpy as np

from passagemill.llm import near_duplicates as nd
from passagemill.llm.shared import materialize
from test_operators import brute_components, shingles


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_an_id_with_two_texts_loses_no_link(spark):
    rng = random.Random(1)
    one, two = ([f"{c}{rng.randrange(99)}" for _ in range(60)] for c in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, "quite something else in here")]
    got = sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    # one document: what is near one of its texts is linked with what is near the other
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, near(one)), (0, near(two))]
    assert {r.component_id for r in nd.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity between 0.85 and 0.87, of short and long texts: every one is linked."""
    rng, rows, pairs = random.Random(3), [], 0
    while pairs < 300:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 60, 90, 200]))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 65)):
            other[at] = "x"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if 0.85 <= len(a & b) / len(a | b) < 0.87:
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_small_sets(spark):
    words = [f"s{i}" for i in range(12)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "s12"])), (2, " ".join(words[:7])), (3, "a b c"), (4, "a b c d"), (5, "A  b\tC")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_shared_boilerplate_moves_no_sets(spark, monkeypatch):
    """5,000 texts that share half of their words fill common buckets, but none of their sets is asked for."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, common + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(40))) for i in range(5000)]
    moved = []
    whole = nd._with_sets

    def counted(docs, classes, wanted):
        wanted = materialize(wanted)
        moved.append(wanted.count())
        return whole(docs, classes, wanted)

    monkeypatch.setattr(nd, "_with_sets", counted)
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert all(r.component_id == r.doc_id for r in got) and sum(moved) == 0


def test_a_large_group_is_joined_by_stars(spark, monkeypatch):
    """2,000 different near copies of one text and a chain: sets move about once each, in small cells too."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"v{i}"])) for i in range(2000)]
    chain = [f"k{i}" for i in range(60)]
    for i in range(40):
        rows.append((3000 + i, " ".join(chain)))
        chain = list(chain)
        chain[rng.randrange(60)] = f"n{i}"
    monkeypatch.setattr(nd, "CELL_TEXTS", 64)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows[2000:])
    assert got == {i: 0 for i in range(2000)} | {i: c for i, (_, c) in want.items()}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1700], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    like = (nd.signature(np.unique(a)) == nd.signature(np.unique(b))).mean()
    assert abs(like - 1700 / 2300) < 0.08
