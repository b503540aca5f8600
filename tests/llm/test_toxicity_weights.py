"""The score means the same whether a class is over the bound of the sample or not."""

import random

from passagemill.llm import toxicity


def test_scores_do_not_depend_on_the_bound(spark):
    rng = random.Random(4)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    bad = ["zlurk", "grompf", "vexly"]
    make = lambda *more: " ".join([*(rng.choice(plain) for _ in range(40)), *more])
    rows = []
    for i in range(4000):
        toxic = i % 10 == 0
        # some of either class look like the other, so the fit has no gap to fall into
        word = [rng.choice(bad)] if (rng.random() < 0.85 if toxic else rng.random() < 0.03) else []
        rows.append((i, make(*word), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    ask = spark.createDataFrame([(1, make("zlurk")), (2, make()), (3, make("grompf", "vexly")), (4, "")], "doc_id long, text string")
    score = lambda bound: {r.doc_id: r.score for r in toxicity.score(ask, toxicity.learn(d, d.select("doc_id", "toxic"), rows_per_class=bound)).collect()}
    whole, part = score(10**6), score(1000)
    assert all(abs(whole[i] - part[i]) < 0.05 for i in whole) and whole[1] > 0.5 > whole[2], (whole, part)
