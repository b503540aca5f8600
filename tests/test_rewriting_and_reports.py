import pytest

from passagemill.operators.rewriting import register_rewriter, rewritten


def test_forms_of_questions(spark):
    def forms(text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return None if "none" in text else [text.upper(), " ", None, text, text[::-1], "more"]

    register_rewriter(spark, "forms", forms)
    rows = [("a", "ab  cd", 1), ("b", "a bad one", 1), ("c", None, 1), ("d", " ", 1), ("e", "none", 1), ("f", "z", 1), ("f", "y", 1), ("f", "y", 1), (None, "n", 1)]
    d = spark.createDataFrame(rows, "query_id string, text string, variant int")
    got = sorted(map(tuple, rewritten(d, "forms").collect()), key=repr)
    want = [("a", 0, "ab cd", False), ("a", 1, "AB CD", False), ("a", 2, "dc ba", False), ("b", 0, "a bad one", True), ("e", 0, "none", False), ("f", 0, "y", False), ("f", 1, "Y", False), ("f", 2, "more", False), (None, 0, "n", False), (None, 1, "N", False), (None, 2, "more", False)]
    assert got == sorted(want, key=repr)
    assert rewritten(d.limit(0), "forms").count() == 0


def test_the_key_keeps_its_type_and_faults_are_named(spark):
    register_rewriter(spark, "plain_forms", lambda text: [text + " again"], 2)
    d = spark.sql("SELECT 7L AS query_id, 'word' AS text")
    d.createOrReplaceTempView("asked_once")
    got = spark.sql("SELECT query_id, variant, text FROM plain_forms(TABLE(asked_once)) ORDER BY variant")
    assert dict(got.dtypes)["query_id"] == "bigint" and [tuple(r) for r in got.collect()] == [(7, 0, "word"), (7, 1, "word again")]
    with pytest.raises(Exception, match="no column query_id"):
        spark.sql("SELECT * FROM plain_forms(TABLE(SELECT 'word' AS text))").collect()
    with pytest.raises(Exception, match="not string"):
        spark.sql("SELECT * FROM plain_forms(TABLE(SELECT 1 AS query_id, 2 AS text))").collect()


def test_report_table_rows(spark):
    from passagemill.operators.evaluation import report_table

    d = spark.createDataFrame([("a", "m", 0.0625), ("a", "n", 1234.5), ("b", "m", None), ("b", "o", 1.0)], "config string, metric string, mean double")
    assert sorted(map(tuple, report_table(d, ["m", "n"]).collect())) == [("a", "0.062", "1234.500"), ("b", "—", "—")]


def test_identity_of_runs(spark):
    from passagemill.operators.statistics import same_identity

    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "2"), ("n", None)], "field string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4"), ("n", None)], "field string, value string")
    assert sorted(map(tuple, same_identity(a, b).collect())) == [("w", None, "4"), ("y", None, "3"), ("z", "2", None)]
    assert same_identity(a, a).isEmpty()


def test_too_many_rules_are_refused(spark):
    from passagemill.operators import search

    rules = spark.range(search.MOST_RULES + 1).selectExpr("int(id) AS seq", "string(id) AS trigger", "array('x') AS expansion")
    asked = spark.createDataFrame([(1, "ask 7")], "query_id long, text string")
    with pytest.raises(ValueError, match="expansion rules"):
        search.expand(asked, rules)
    assert {r.text for r in search.expand(asked, rules.where("seq < 9")).collect()} == {"ask 7", "ask 7 x"}
