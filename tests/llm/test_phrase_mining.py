"""Operator 11 against counting every run of every text."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from passagemill.llm import phrase_mining as op


def plain(docs, least, longest=5, top=2000):
    f, total = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    held = {(lang, w[i:j]) for (lang, w), n in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * n >= 100 * cand[lang, w[i:j]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in held:
            score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, rows in out.items() for i, x in enumerate(sorted(rows)[:top], 1))


def texts(n, seed=2):
    rng = random.Random(seed)
    fixed = ["New York City hall opens", "machine learning", "e.g. this one", "größe é 日本 語", "a b a b a b"]
    word = lambda: rng.choice(["the", "of", "a", "b", "x\x00y", "Zeta", "l m", "\t", "q" * 70])
    part = lambda: rng.choice(fixed) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 9)))
    return [(rng.choice([" ", ", ", "\n", "; "]).join(part() for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None])) for _ in range(n)]


def mined(spark, docs, parts=4, **how):
    d = spark.createDataFrame([(i, t, x, "clash", 1) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int").repartition(parts)
    return sorted(map(tuple, op.mine_phrases(d, **how).collect()))


@pytest.mark.parametrize("trigger", [2, 32])
def test_against_plain_counting(spark, monkeypatch, trigger):
    monkeypatch.setattr(op, "TRIGGER", trigger)
    docs = [*texts(150), *texts(10, 3) * 9, (None, "en"), ("", None), ("...", "de"), ("the of the of " * 3000, "long"), ("no break " * 500, "de")]
    want = plain(docs, 12)
    assert len(want) > 40 and mined(spark, docs, least=12) == want
    assert mined(spark, docs, least=12, top=3) == plain(docs, 12, top=3)
    assert mined(spark, docs, least=30, longest=3) == plain(docs, 30, 3)


def test_nothing_frequent(spark):
    assert mined(spark, [("one two", "en")]) == [] and mined(spark, []) == []


def test_long_texts_are_parted_where_a_piece_ends(spark):
    docs = [("alpha beta gamma, delta " * 100_000, "en"), ("x y " * 200_000, "en")]
    assert mined(spark, docs) == plain(docs, 100)


def test_every_run_is_in_one_chunk():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 7, 3000).astype(np.uint64)
    first = np.array([0, 0, 5, 6, 2000, 2003, 3000])
    a, e, last = op.chunk_spans(hashes, first, 4)
    seen = Counter()
    for s, t, z in zip(a, e, last, strict=True):
        seen.update((i, m) for m in range(1, 6) for i in range(s, t - m + 1) if z or i < t - 4)
    want = {(i, m) for x, y in zip(first[:-1], first[1:], strict=True) for m in range(1, 6) for i in range(x, y - m + 1)}
    assert set(seen) == want and set(seen.values()) == {1}
