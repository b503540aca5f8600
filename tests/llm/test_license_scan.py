"""Retrieval by bands against exact containment in every window, spread matches at any offset, and blocks of templates."""

import math
import random
import re

import pytest

from passagemill.llm import license_scan as ls


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, templates):
    """Every window of every text against every template, shingle by shingle."""
    best = {}
    for i, text in docs:
        w = words(text)
        for name, t in templates:
            tw = words(t)
            k = min(5, len(tw))
            if not k:
                continue
            want = {tuple(tw[j : j + k]) for j in range(len(tw) - k + 1)}
            half = math.ceil(1.5 ** math.ceil(math.log(1.5 * len(want), 1.5)))
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for at in range(0, len(grams), half):
                window = grams[at : at + 2 * half]
                share = len(want & set(window)) / len(want)
                if share >= 0.8:
                    spot = at + next(j for j, g in enumerate(window) if g in want)
                    s, p = best.get((i, name), (0.0, spot))
                    best[i, name] = max(s, share), min(p, spot)
    return {(i, n, s, p) for (i, n), (s, p) in best.items()}


def found(d, templates=None):
    return {(r.doc_id, r.license, r.containment, r.first_word) for r in ls.license_scan(d, templates).collect()}


def edited(rng, text, spread):
    """A copy that lost a few words at one end and got some put in at two places."""
    w = text.split()
    w = w[: max(1, len(w) - len(w) // 20)]
    for _ in range(2):
        at = rng.randrange(len(w))
        w[at:at] = [f"in{rng.randrange(999)}" for _ in range(int(len(w) * spread))]
    return " ".join(w)


def test_against_exact_containment(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"p{rng.randrange(3000)}" for _ in range(n))
    docs = []
    for i in range(300):
        name, text = rng.choice(ls.STATEMENTS)
        docs.append((i, f"{prose(rng.randrange(400))} {edited(rng, text, rng.choice([0, 0, 0.02, 0.1]))} {prose(rng.randrange(200))}"))
    docs += [(400 + i, prose(300) + " permission is hereby granted to all") for i in range(20)] + [(500, None), (501, "")]
    want = brute(docs, ls.STATEMENTS)
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert len(want) > 250 and got == want  # a recall of 1: the bound of the bands is a miss in a million


def test_a_spread_match_is_found_at_every_offset(spark):
    w = ls.STATEMENTS[3][1].split()
    late = " ".join([*w[:14], "copyright", "notice", "of", "page", "two", *w[14:]])
    docs = [(i, "x " * i + late) for i in range(0, 120)]
    got = {r[0] for r in found(spark.createDataFrame(docs, "doc_id long, text string")) if r[1] == "mit"}
    assert got == set(range(120))


def test_templates_in_blocks(spark, monkeypatch):
    rows = [(f"l{i}", " ".join(f"t{i}w{j}" for j in range(8))) for i in range(60)] + [("null", None), ("blank", " "), (None, "x y")]
    templates = spark.createDataFrame(rows, "license string, text string")
    d = spark.createDataFrame([(i, f"a b {rows[i][1]} c") for i in range(60)], "doc_id long, text string")
    want = {(i, f"l{i}", 1.0, 2) for i in range(60)}
    assert found(d, templates) == want
    monkeypatch.setattr(ls, "TEMPLATES", 7)
    assert found(d, templates) == want
    with pytest.raises(ValueError):
        found(d, spark.createDataFrame([("one", f"w{i}") for i in range(8)], "license string, text string"))
    assert found(d, templates.limit(0)) == set()
