import math
import re

from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.functions.vectors import cosine, hash_embedding


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def plain_tokens(t):
    low = t.lower()
    out = re.findall(r"[a-z0-9_]+", low)
    for run in re.findall("[一-鿿]+", low):
        if len(run) <= 8:
            out.append(run)
        if len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)] + [run[i : i + 3] for i in range(len(run) - 2)]
    return out


def test_tokens(spark):
    for t in ["Hello World_2, x", "土地承包法", "一", "abc 承包经营权期限延长三十年 def", "", "😀 a"]:
        assert one(spark, tx.tokens(F.col("t")), t=t) == plain_tokens(t)


def test_space_class(spark):
    assert one(spark, tx.collapse_space(F.col("t")), t=" a \x1c b c　d\n") == "a b c d"
    assert one(spark, tx.without_space(F.col("t")), t="a　b\t\x85c") == "abc"


def test_masking(spark):
    assert one(spark, tx.mask_personal(F.col("t")), t="13812345678 x 913812345678 11010519491231002X") == "[PHONE] x 913812345678 [ID]"


def test_path_template(spark):
    assert one(spark, tx.path_template(F.col("t")), t="/a/1234/b/12/123e4567-e89b-12d3-a456-426614174000") == "/a/{id}/b/12/{id}"


def test_overlap_and_numbers(spark):
    assert one(spark, tx.bigram_overlap(F.col("q"), F.col("t")), q="ab c", t="xabc") == 1.0
    assert one(spark, tx.bigram_overlap(F.col("q"), F.col("t")), q="a", t="xabc") == 0.0
    assert one(spark, tx.unsupported_numbers(F.col("a"), F.col("q")), a="12.5% of 40", q="about 1 2.5% there") == ["40"]


def test_sentences(spark):
    got = one(spark, tx.sentences(F.col("t")), t="第一条 甲乙\n丙。 1.丁；（一）戊！")
    assert got[0] == "甲乙丙" and "戊" in got


def test_scores_keep_null(spark):
    assert one(spark, tx.unit_score(F.lit(None).cast("double"))) is None
    assert one(spark, tx.unit_score(F.lit(7))) == 1.0


def test_embedding(spark):
    v = one(spark, hash_embedding(F.col("t")), t="alpha beta alpha")
    assert len(v) == 32 and math.isclose(sum(x * x for x in v), 1.0)
    import hashlib

    want = [0.0] * 32
    for f in ["alpha", "beta", "alpha"]:
        d = hashlib.sha256(f.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 32] += 1 if d[4] & 1 else -1
    n = math.sqrt(sum(x * x for x in want))
    assert all(math.isclose(a, b / n) for a, b in zip(v, want))


def test_cosine(spark):
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    import pytest

    with pytest.raises(Exception, match="dimension"):
        one(spark, cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
