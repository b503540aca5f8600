import json

import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import answers, audit, telemetry
from passagemill.operators.quota import quota_decisions
from passagemill.sources import cells, html, readers

PAGE = """<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav><div class="site-header">gone</div>
<div class="article-header">Title &amp; more</div><p>First<br>second</p><div id="copyright">gone too</div><p>abcdef0123456789abcdef</p><p>Tail</p></body></html>"""


def test_page_text(spark):
    d = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    got = {r.page_id: r.text for r in html.extract(d).collect()}
    assert got[1].split("\n") == ["T", "Title & more", "First", "second", "Tail"] and got[2] == got[3] == ""


def test_decode(spark):
    d = spark.createDataFrame([(1, b"\xef\xbb\xbfhi"), (2, "土地".encode("gb18030")), (3, b"\xff\xff"), (4, None)], "i int, content binary")
    got = {r.i: r.text for r in readers.decoded(d).collect()}
    assert got[1] == "hi" and got[2] == "土地" and "�" in got[3] and got[4] == ""


def test_sheet(spark):
    rows = [("d", 1, "S", 1, 1, "Title", "str", "G"), ("d", 1, "S", 3, 1, "name", "str", "G"), ("d", 1, "S", 3, 2, "rate", "str", "G"), ("d", 1, "S", 4, 1, "x", "str", "G"), ("d", 1, "S", 4, 2, "0.4", "float", "0%"), ("d", 1, "S", 5, 3, "7.0", "float", "G"), ("d", 2, "H", 1, 1, "a", "str", "G"), ("d", 2, "H", 1, 2, "b", "str", "G")]
    d = spark.createDataFrame(rows, "document_id string, sheet_no int, sheet string, row int, col int, value string, value_type string, number_format string")
    got = {r.page: r.text for r in cells.sheet_pages(d).collect()}
    assert got == {1: "Title\nS row 4 name: x | rate: 40%\nS row 5 column 3: 7", 2: "H header a | b"}


def test_label_files(spark, tmp_path):
    one = [{"question": "q", "expected_answer": "a", "expected_page": 3, "quote": "t", "source_filename": "f"}]
    (tmp_path / "list.json").write_text(json.dumps(one))
    (tmp_path / "object.json").write_text("﻿" + json.dumps({"examples": [{"question": "r", "should_refuse": True, "evidence_mode": "odd"}, {"question": "m", "evidence_mode": "any", "expected_evidence": [{"source_filename": "f", "page": 1, "quote": "x"}]}]}))
    (tmp_path / "bad.json").write_text('"text"')
    r = readers.label_set(spark, str(tmp_path / "list.json")).first()
    assert r.mode == "all" and [tuple(h) for h in r.hops] == [("f", 3, "t")]
    rows = {r.question: r for r in readers.label_set(spark, str(tmp_path / "object.json")).collect()}
    assert rows["r"].should_refuse and rows["r"].hops == [] and rows["m"].mode == "any"
    with pytest.raises(Exception, match="label set"):
        readers.label_set(spark, str(tmp_path / "bad.json")).collect()
    bound = readers.bind_hops(readers.label_set(spark, str(tmp_path / "list.json")).withColumn("example_id", F.lit(1)), spark.createDataFrame([("f", "id1")], "filename string, document_id string")).first()
    assert bound.hops[0].document_id == "id1"


def test_csv_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿question,page\nq,2\n", encoding="utf-8")
    assert readers.label_csv(spark, str(tmp_path / "a.csv")).first().page == 2
    (tmp_path / "d").mkdir()
    for name, text in (("x.txt", "hi"), ("y.pdf", "p"), ("z.md", "")):
        (tmp_path / "d" / name).write_text(text)
    good, bad = readers.corpus_files(spark, str(tmp_path / "d"))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"unsupported_suffix"}  # Spark's file sources pass over empty files
    table = spark.createDataFrame([("a.TXT", 0, b""), ("b.html", 1, b"x"), ("c.zip", 1, b"x")], "path string, length long, content binary")
    good, bad = readers.split_files(table)
    assert [r.path for r in good.collect()] == ["b.html"] and {(r.path, r.reason) for r in bad.collect()} == {("a.TXT", "empty"), ("c.zip", "unsupported_suffix")}


def test_citations(spark):
    ev = [("doc-a", 1), ("doc-b", 2)]
    rows = [(1, "x [doc-a p.1] [1] [note]", ev), (2, "[doc-a p.7]", ev), (3, "[doc-z p.1]", ev), (4, "[doc-b:2] [note:3]", ev), (5, "  ", ev), (6, "[doc-a 第1页]", ev), (7, "plain", [])]
    d = spark.createDataFrame(rows, "answer_id int, answer string, evidence array<struct<document_id:string,page:int>>")
    got = {r.answer_id: (r.citations, r.unknown, r.ungrounded, r.usable) for r in answers.citation_report(d).collect()}
    assert got == {1: (1, 0, 0, True), 2: (1, 0, 1, False), 3: (1, 1, 0, False), 4: (1, 0, 0, True), 5: (0, 0, 0, False), 6: (1, 0, 0, True), 7: (0, 0, 0, False)}


def test_judge_replies(spark):
    rows = [(1, '```json\n{"correctness": 2, "faithfulness": 0.5, "completeness": "x", "reason": "ok"}\n```'), (2, "none"), (3, '{"correctness": 1}}'), (4, '{"correctness": -1}')]
    d = spark.createDataFrame(rows, "i int, reply string").select("i", answers.judge_reply(F.col("reply")).alias("r"))
    got = {r.i: tuple(r.r) for r in d.collect()}
    assert got == {1: (1.0, 0.5, 0.0, "ok"), 2: (0.0, 0.0, 0.0, answers.BAD_REPLY), 3: (0.0, 0.0, 0.0, answers.BAD_REPLY), 4: (0.0, 0.0, 0.0, "")}


def test_quota(spark):
    ev = [("k", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 10, 11])]
    d = spark.createDataFrame(ev, "key string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.event_id, r.allowed, r.remaining) for r in quota_decisions(d, 2, 10).orderBy("event_id").collect()]
    assert got == [(0, True, 1), (1, True, 0), (2, False, 0), (3, True, 1), (4, True, 0)]


def test_histogram_and_traces(spark):
    d = spark.createDataFrame([("s", 0.005), ("s", 0.2), ("s", 99.0)], "stage string, x double")
    got = {r.bound: r.cumulative for r in telemetry.histogram(d, "x", "stage").collect()}
    assert got["0.005"] == 1 and got["0.25"] == 2 and got["10.0"] == 2 and got["+Inf"] == 3 and len(got) == 12


def test_shared_sentences(spark):
    d = spark.createDataFrame([("a", 1, "本办法所称土地承包经营权是指依法取得的权利。另一句话在这里而且足够长了。"), ("b", 1, "本办法所称土地承包经营权是指依法取得的权利。")], "document_id string, page int, text string")
    r = audit.shared_sentences(d).collect()
    assert len(r) == 1 and r[0].documents == 2 and r[0].definitional


def test_reviewer_template(spark):
    d = spark.createDataFrame([("c", "q", 0.5)], "config string, question string, judge double")
    assert answers.reviewer_template(d).columns == ["config", "question", "judge", "correctness", "faithfulness", "completeness", "note"]
    labels = spark.createDataFrame([("c", "q", 1.0), ("c", "z", 0.0)], "config string, question string, correctness double")
    both, left = answers.match_labels(d, labels)
    assert both.count() == 1 and left.first().question == "z"
    with pytest.raises(ValueError):
        answers.match_labels(d.union(d), labels)


def test_chrome(spark):
    d = spark.range(1).select(tx.content_lines(F.lit("正文第一行内容\n网站地图\n× \nx\n" + "a" * 30)).alias("t"))
    assert d.first().t == "正文第一行内容"


def test_nested_lines_split_a_hot_key(spark, tmp_path):
    """A key with nearly all rows takes many lines; a set reads alike as lines and as one value; maps and nulls come back."""
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise("hot").alias("k"), "id", F.create_map(F.lit("m"), F.col("id").cast("double")).alias("x"))
    lines = readers.nested(rows, "k", most=100)
    sizes = [len(r.rows) for r in lines.collect()]
    assert sum(sizes) == 5000 and max(sizes) < 200 and len(sizes) > 50
    readers.write_grouped_json(rows, f"{tmp_path}/out", "k")
    back = spark.read.schema("k string, rows array<struct<id:long,x:map<string,double>>>").json(f"{tmp_path}/out").select("k", F.explode("rows").alias("r")).select("k", "r.id", "r.x")
    assert sorted((r.k or "", r.id, r.x["m"]) for r in back.collect()) == sorted((r.k or "", r.id, r.x["m"]) for r in rows.collect())
    assert readers.nested(rows.limit(0), "k").count() == 0
    one = '{"examples": [{"question": "a", "page": 1}, {"question": "b", "expected_page": 2}]}'
    (tmp_path / "one.json").write_text(one.replace(",", ",\n"))
    (tmp_path / "lines.json").write_text('[{"question": "a", "page": 1}]\n{"examples": [{"question": "b", "expected_page": 2}]}\n')
    read = lambda name, lines: sorted(map(str, readers.label_set(spark, f"{tmp_path}/{name}", lines).collect()))
    assert read("one.json", False) == read("lines.json", True) and len(read("one.json", False)) == 2
