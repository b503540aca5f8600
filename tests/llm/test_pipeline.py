import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

from passagemill.llm.queries import queries, tokenizer_path
from test_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """Learned verdicts as the queries give them on each stage's input; groups, benchmark hits and tokens by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    toxic = {r.doc_id for r in queries()["op9_toxicity"](spark, SF).where("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    assert {r.doc_id for r in first.collect()} == set(left) and first.columns == docs.columns
    groups = brute_components(sorted(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i and any(c.isalpha() for c in t or "")}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not brute_hits(t, items)[-1]}
    t = Tokenizer.from_file(tokenizer_path())
    want = {i: (len(t.encode(x, add_special_tokens=False).ids), hashlib.sha256(x.encode()).hexdigest()) for i, x in left.items()}
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, None, "en", None, 0), (-6, "", None, "s", 0), (-7, "plain words of a text", "en", "s", 3)], docs.schema)
    for rows in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count(), name
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(odd), SF)
    assert {r.doc_id for r in kept.where("doc_id < 0").collect()} == {-7}
