"""Term frequencies without anything written before, and their plan."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagemill.functions.text import tokens
from passagemill.operators import search
from passagemill.operators.index import Index, build_index, corpus_stats, term_frequencies, term_stats, updated


def test_term_frequencies_unwritten(spark):
    texts = [(i, f"alpha beta {'beta ' * (i % 3)} gamma{i % 7} 法律 x") for i in range(60)] + [(100, ""), (101, None), (102, "...")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    plain = {r.chunk_id: Counter(r.t or []) for r in chunks.select("chunk_id", tokens(chunks.text).alias("t")).collect()}
    postings = term_frequencies(chunks)
    got = postings.collect()
    assert {(r.chunk_id, r.term, r.tf) for r in got} == {(i, t, n) for i, c in plain.items() for t, n in c.items()}
    assert len(got) == sum(map(len, plain.values())) and all(r.dl == sum(plain[r.chunk_id].values()) for r in got)
    df = {r.term: r.df for r in term_stats(postings, corpus_stats(chunks)).collect()}
    assert df["beta"] == 60 and df["法律"] == 60


def test_the_tokens_are_not_counted_in_a_filter(spark):
    """A test of the array's size below the generator would tokenise each chunk anew for each of its tokens."""
    chunks = spark.createDataFrame([(1, "a b a")], "chunk_id long, text string")
    plan = term_frequencies(chunks)._jdf.queryExecution().optimizedPlan().toString()
    # twice at most, where the filter on sizes had it 174 times
    assert plan.count("regexp_extract_all") <= 2 * tokens(chunks.text)._jc.toString().count("regexp_extract_all") + 6 and "size" not in plan.split("Generate")[0]


def chunk_rows(spark, n, seed=1, prefix="c"):
    rng = random.Random(seed)
    # few words are in nearly all chunks, most in few
    text = lambda: " ".join(rng.choice(["the", "of", "and", f"w{int(rng.expovariate(0.05))}"]) for _ in range(rng.randint(0, 40)))
    return spark.createDataFrame([(f"{prefix}{i}", text(), rng.choice(["a", "b"])) for i in range(n)], "chunk_id string, text string, kind string").repartition(3)


def asked(spark, n=25, seed=7):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["the", "of", "absent", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 7))), rng.choice(["a", "b", "c"])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, text string, scope string")


def ranks(d):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in d.collect())


@pytest.mark.parametrize("first", [2, 64])
def test_bounded_search_equals_all_scores(spark, monkeypatch, first):
    monkeypatch.setattr(search, "_FIRST_ROWS", first)
    monkeypatch.setattr(search, "_MOST_ROWS", 4 * first)
    chunks, q = chunk_rows(spark, 700), asked(spark)
    for index, ask in ((build_index(chunks), q.drop("scope")), (build_index(chunks, F.col("kind")), q)):
        for k in (1, 4, 1000):
            assert ranks(search.sparse_search(ask, index, k)) == ranks(search._ranked(search.sparse_scores(ask, index), k))
        n = search.sparse_pairs(ask, index, 2).first()
        assert 0 < n.made < n.every
        monkeypatch.setattr(search, "BROADCAST_TERMS", 0)  # both sides by term, salted
        want = ranks(search.sparse_search(ask, index, 4))
        monkeypatch.setattr(search, "BROADCAST_TERMS", 32 << 20)
        assert want == ranks(search.sparse_search(ask, index, 4))
    assert search.sparse_search(q.limit(0), index, 3).count() == 0 and search.sparse_search(q, build_index(chunks.limit(0)), 3).count() == 0


def test_updates_equal_a_rebuild(spark, tmp_path):
    chunks = chunk_rows(spark, 300)
    for at, scope in enumerate((None, F.col("kind"))):
        build_index(chunks, scope).write(f"{tmp_path}/{at}")
        index = Index.read(spark, f"{tmp_path}/{at}")
        new = chunk_rows(spark, 40, 5, "d").unionByName(chunk_rows(spark, 20, 9, "c"))  # c0 .. c19 change
        gone = spark.createDataFrame([(f"c{i}",) for i in [*range(20), *range(100, 130), 100]] + [("none",)], "chunk_id string")
        kept = chunks.join(gone, "chunk_id", "left_anti").unionByName(new)
        got, want = updated(updated(index, gone, new, scope), gone.limit(0), new.limit(0), scope), build_index(kept, scope)
        table = lambda d, *c: sorted((tuple(r) for r in d.select(*c).collect()), key=str)
        assert table(got.terms, "scope", "term", "df", "idf") == table(want.terms, "scope", "term", "df", "idf")
        assert table(got.corpus, "scope", "n", "total", "avgdl") == table(want.corpus, "scope", "n", "total", "avgdl")
        assert table(got.postings, "scope", "term", "chunk_id", "tf", "dl") == table(want.postings, "scope", "term", "chunk_id", "tf", "dl")
        q = asked(spark) if scope is not None else asked(spark).drop("scope")
        assert ranks(search.sparse_search(q, got, 5)) == ranks(search.sparse_search(q, want, 5))
    nothing = updated(index, chunks.select("chunk_id"), chunks.limit(0), scope)
    assert nothing.terms.count() == nothing.corpus.count() == nothing.rows.count() == 0
