"""Quotes in texts by both ways, against plain search."""

import random

import pytest

from passagemill.operators import containment


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_both_ways_against_plain_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(containment, "BROADCAST_QUOTES", broadcast)
    monkeypatch.setattr(containment, "SCANNED", 300)
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "aab", "b", "法律", "é", "long-word-here", "x", "aaaaaaaa"])
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    texts = [(i, text(60)) for i in range(120)] + [(200, None), (201, ""), (202, "ab " * 3000), (3, "repeated id 法律")]
    quotes = [(i, text(1 + i % 14)) for i in range(80)] + [(90, " "), (91, None), (92, "a"), (93, "absent words of a quote"), (94, "ab " * 2999), (95, "律é"), (205, "b")]
    quotes += [(96 + i, texts[i][1][3:]) for i in range(10)]
    bare = lambda t: "".join((t or "").split())
    want = {(q, t) for q, x in quotes for t, y in texts if bare(x) and bare(x) in bare(y)}
    got = containment.containing(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "text_id long, text string").repartition(3)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "quote_id long, quote string"), spark.createDataFrame([], "text_id long, text string")
    assert containment.containing(none[0], none[1]).count() == 0 and containment.containing(spark.createDataFrame(quotes, "quote_id long, quote string"), none[1]).count() == 0
