import random
import time

import pytest
from pyspark.sql import functions as F

from passagemill.operators.quota import quota_decisions
from passagemill.streaming import jobs


def write(spark, rows, schema, path):
    d = spark.createDataFrame(rows, schema)
    for c, t in d.dtypes:
        if c in ("ts", "created_at", "event_time", "started_at", "ended_at"):
            d = d.withColumn(c, F.col(c).cast("timestamp"))
    d.coalesce(1).write.mode("append").parquet(path)
    return d.schema


def test_ingest_is_idempotent(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = write(spark, [("d1", 1, "first text"), ("d2", 1, "x" * 900)], "document_id string, page int, text string", src)
    run = lambda: jobs.ingest_documents(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    run()
    write(spark, [("d1", 1, "second text")], "document_id string, page int, text string", src)
    run()
    got = {(r.chunk_id, len(r.text)) for r in jobs.current_rows(spark, out, "document_id").collect()}
    assert got == {("d1:0", 11), ("d2:0", 800), ("d2:1", 220)}


def test_documents_arrive_from_a_file_or_a_folder_of_parts(spark, tmp_path):
    """Every part of the table arrives, documents without id as well, and no other table."""
    from passagemill.plans import catalog, views

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    docs.repartition(5).write.parquet(str(tmp_path / "parts/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    docs.limit(7).write.parquet(str(tmp_path / "parts/documents_old.parquet"))
    for sf in (str(tmp_path), str(tmp_path / "parts")):
        got = catalog.QUERIES["ingest_stream"](spark, sf).collect()
        want = views.chunks(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 100


def test_newest_rows_do_not_move_and_unfinished_versions_are_not_read(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "id string, x int")
    at = str(tmp_path / "t")
    jobs.replace_rows(rows(("a", 1), ("a", 2), (None, 3), ("b", 4)), at, "id", 0)
    moved = lambda: "SortMergeJoin" in jobs.current_rows(spark, at, "id")._jdf.queryExecution().executedPlan().toString()
    auto = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(auto)
    spark.conf.set(auto, "-1")
    assert not moved()
    jobs.replace_rows(rows(("a", 5), (None, 6)), at, "id", 1)
    jobs.replace_rows(rows(("c", 7)), at, "id", 2, rows(("c", 0), ("b", 0)))
    rows(("a", 8)).write.parquet(f"{at}/rows/version=3")  # its keys are not there yet
    for most in (1 << 16, 0):
        monkeypatch.setattr(jobs, "BROADCAST_KEYS", most)
        assert {tuple(r) for r in jobs.current_rows(spark, at, "id").collect()} == {("a", 5), (None, 6), ("c", 7)}
        assert {tuple(r) for r in jobs.current_rows(spark, at, "id", 2).collect()} == {("a", 5), (None, 6), ("b", 4)}
        assert moved() == (most == 0)
    spark.conf.set(auto, before)


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.html").write_text("<p>Hello</p><script>x</script>")
    (tmp_path / "src/b.txt").write_text("plain words")
    jobs.ingest_files(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.text for r in jobs.current_rows(spark, str(tmp_path / "out"), "document_id").collect()} == {"Hello", "plain words"}


def test_changes(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = write(spark, [("d", 2, "2024-01-02", "delete"), ("e", 1, "2024-01-01", "upsert")], "document_id string, seq long, event_time string, operation string", src)
    run = lambda: jobs.apply_changes(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    run()
    write(spark, [("d", 1, "2024-01-01", "upsert"), ("e", 3, "2024-01-03", "delete")], "document_id string, seq long, event_time string, operation string", src)
    run()
    assert {(r.document_id, r.seq, r.operation) for r in jobs.current_rows(spark, out, "document_id").collect()} == {("d", 2, "delete"), ("e", 3, "delete")}


def collect_stream(spark, d, name, mode="append"):
    q = d.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_windows(spark, tmp_path):
    src = str(tmp_path / "fb")
    schema = write(spark, [(1, "t", "up", "2024-01-01 01:00:00"), (1, "t", "up", "2024-01-01 01:00:00"), (2, "t", "up", "2024-01-01 02:00:00"), (3, "t", "up", "2024-02-01 00:00:00")], "feedback_id long, tenant_id string, kind string, created_at string", src)
    got = collect_stream(spark, jobs.feedback_windows(spark.readStream.schema(schema).parquet(src)), "fbw", "complete")
    assert sorted(r.n for r in got) == [1, 2]
    src = str(tmp_path / "rq")
    schema = write(spark, [("2024-01-01 00:10:00", "/a/12345", 200, 0.2), ("2024-01-01 00:20:00", "/a/99999", 200, 0.2)], "ts string, path string, status int, elapsed_s double", src)
    got = collect_stream(spark, jobs.request_windows(spark.readStream.schema(schema).parquet(src)), "rqw", "complete")
    assert [(r.path, r.n) for r in got] == [("/a/{id}", 2)]


@pytest.fixture
def rocks(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": jobs.ROCKS, "spark.sql.execution.arrow.maxRecordsPerBatch": "10"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def moments(n, seed=1):
    """(key, event_id, ts) in disorder: many more rows of a key than an Arrow frame of the fixture has."""
    rng = random.Random(seed)
    rows = [(rng.choice(["k", "k", "k", "l"]), i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for i, s in enumerate(sorted(rng.randint(0, 1500) for _ in range(n)))]
    rng.shuffle(rows)
    return rows


def test_quota_stream_equals_batch(spark, tmp_path, rocks):
    src = str(tmp_path / "ev")
    schema = write(spark, moments(200), "key string, event_id long, ts string", src)
    got = collect_stream(spark, jobs.quota_stream(spark.readStream.schema(schema).parquet(src), 2, 30), "qs")
    batch = quota_decisions(spark.read.parquet(src), 2, 30).collect()
    assert len(got) == 200 and sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_quota_stream_waits_for_late_rows(spark, tmp_path, rocks):
    """Files out of order within the watermark give what the batch gives; rows behind it are dropped."""
    src, flush = str(tmp_path / "ev"), [(k, 900, "2024-01-01 03:00:00") for k in "kl"]
    rows = sorted(moments(120, 5), key=lambda r: r[2])
    parts = [rows[40:80], rows[:40], rows[80:], flush, [("k", 999, "2024-01-01 00:00:01")], [(k, 901, "2024-01-01 09:00:00") for k in "kl"]]
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
        schema = write(spark, part, "key string, event_id long, ts string", src)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [tuple(r) for r in collect_stream(spark, jobs.quota_stream(stream, 2, 30, "1 hour"), "qlate") if r.event_id < 900]
    batch = quota_decisions(spark.read.parquet(src).where("event_id < 900"), 2, 30).collect()
    assert sorted(got) == sorted(map(tuple, batch))


def test_retry_stream_takes_rows_in_order(spark, tmp_path, rocks):
    src, rng = str(tmp_path / "log"), random.Random(2)
    rows = [(f"d{d}", s, rng.choice([None, "claimed", "failed", "failed", "done"]) if s else None) for d in range(3) for s in range(45)]
    rng.shuffle(rows)
    schema = write(spark, rows, "document_id string, seq long, outcome string", src)
    # timers of processing time keep a stream going, so it is stopped once all rows are in
    q = jobs.retry_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("rs").outputMode("update").start()
    try:
        until = time.time() + 40
        while time.time() < until and spark.table("rs").count() < 3:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {r.document_id: (r.failures, r.state) for r in spark.table("rs").collect()}
    for d in ("d0", "d1", "d2"):
        n, state = 0, None
        for _, _, o in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            n = 0 if o is None else n + (o == "failed")
            state = "due" if o is None else {"failed": "parked" if n >= 3 else "due", "claimed": "running"}.get(o, o)
        assert got[d] == (n, state)


def test_evaluate_new(spark, tmp_path):
    src, out = str(tmp_path / "ex"), str(tmp_path / "res")
    schema = write(spark, [(1,), (2,)], "example_id long", src)
    for n in range(2):
        jobs.evaluate_new(spark.readStream.schema(schema).parquet(src), lambda d: d.withColumn("score", F.lit(1.0)), out, "f", str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_versions(spark, tmp_path):
    """A later version replaces its keys only, a batch run again changes nothing, a failed one is not seen."""
    t = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert jobs.current_rows(spark, t, "k") is None
    seen = lambda: sorted(map(tuple, jobs.current_rows(spark, t, "k").collect()))
    jobs.replace_rows(rows(("a", 1), ("a", 2), ("b", 3)), t, "k", 0)
    jobs.replace_rows(rows(("a", 4)), t, "k", 1)
    jobs.replace_rows(rows(("a", 4)), t, "k", 1)
    assert seen() == [("a", 4), ("b", 3)]
    rows(("b", 9)).write.parquet(f"{t}/rows/version=2")  # ended before its keys
    assert seen() == [("a", 4), ("b", 3)]
    jobs.replace_rows(rows(), t, "k", 2, rows(("b", None)))
    assert seen() == [("a", 4)]
