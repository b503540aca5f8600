"""Continuous flows as Structured Streaming jobs. [J1-J10]

Late rows: each job names its watermark; rows behind it are dropped and show in the query's progress. State is bounded
by the watermark or by a timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from passagemill.functions.text import path_template
from passagemill.operators.corpus import chunk_pages
from passagemill.operators.telemetry import bucket, latest_intent
from passagemill.sources import html, readers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replace_rows(batch: DataFrame, path: str, key: str, version: int, keys: DataFrame | None = None) -> None:
    """Adds a batch as the newest version of its keys; nothing that is there is rewritten.

    Rows go to ``path``/rows and then their keys (``keys``: also those without rows, whose old rows go) to
    ``path``/keys, each below the version's number. Readers see a version once its keys are whole, so a batch that
    failed leaves the table as it was, and running it again writes the same folders anew. A table belongs to one stream
    with its checkpoint, whose batch numbers are the versions.
    """
    batch.write.mode("overwrite").parquet(f"{path}/rows/version={version}")
    known = batch.select(key) if keys is None else keys.select(key)
    known.distinct().write.mode("overwrite").parquet(f"{path}/keys/version={version}")


#: Keys that came again, up to which they are broadcast to the rows, so that no row moves.
BROADCAST_KEYS = 1 << 16


def current_rows(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The rows of each key's newest version, of those below ``before`` if given; None if there is no table yet.

    Only keys of several versions have rows that are out of date. They are counted first: where there are none, rows
    are read as they are, and a few are broadcast. A null is a key, too.
    """
    try:
        keys = spark.read.parquet(f"{path}/keys")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = spark.read.parquet(f"{path}/rows")
    if before is not None:  # a batch that is run again must not read what it writes
        keys, rows = keys.where(F.col("version") < before), rows.where(F.col("version") < before)
    rows = rows.join(F.broadcast(keys.select("version").distinct()), "version", "left_semi")  # a number for each batch
    again = keys.groupBy(F.col(key).alias("_key")).agg(F.min("version").alias("_first"), F.max("version").alias("_newest")).where("_first < _newest")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_KEYS else again
        rows = rows.join(again, F.col(key).eqNullSafe(F.col("_key")) & (F.col("version") < F.col("_newest")), "left_anti")
    return rows.drop("version")


def ingest_files(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Arriving files → decoded text → chunks, replacing the chunks of a document that arrives again. [J1]"""
    files = spark.readStream.format("binaryFile").schema(readers.FILE_SCHEMA).option("recursiveFileLookup", "true").load(source)

    def publish(batch: DataFrame, number: int) -> None:
        good, _ = readers.split_files(batch)
        rows = readers.decoded(good.select("path", "modificationTime", "content"))
        newest = rows.groupBy("path").agg(F.max_by("text", "modificationTime").alias("text"))
        page = newest.select(F.col("path").alias("document_id"), F.lit(1).alias("page"), "text")
        is_html = F.lower("document_id").rlike(r"\.html?$")
        pages = page.where(~is_html).unionByName(html.extract(page.where(is_html).withColumnRenamed("text", "html")))
        replace_rows(chunk_pages(pages), table, "document_id", number, pages)

    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(documents: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """A stream of (document_id, page, text) → chunk table, idempotent by document. [J1 A12]"""
    return documents.writeStream.foreachBatch(lambda batch, number: replace_rows(chunk_pages(batch), table, "document_id", number, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(log: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Change log → newest intent of each document; superseded intents drop out, deletes stay as such. [J2]

    A batch meets the stored intents of its own documents, so a late older row can't undo a newer one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = current_rows(batch.sparkSession, state, "document_id", number)
        if known is not None:
            batch = known.join(batch.select("document_id").distinct(), "document_id", "left_semi").unionByName(batch)
        replace_rows(latest_intent(batch), state, "document_id", number)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_windows(feedback: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, tenant_id, kind, n) of feedback(feedback_id, tenant_id, kind, created_at), each id once. [J4]"""
    once = feedback.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["feedback_id"])
    return once.groupBy(F.window("created_at", window), "tenant_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def request_windows(requests: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, path, status, bucket, n, seconds) of requests(ts, path, status, elapsed_s). [J5]"""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", window), path_template(F.col("path")).alias("path"), "status", bucket(F.col("elapsed_s")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_s").alias("seconds"))


def stage_windows(stages: DataFrame, window: str = "2 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, stage, bucket, n) over sliding windows of stages(ts, stage, elapsed_s). [J6]"""
    return stages.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "stage", bucket(F.col("elapsed_s")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def trace_sessions(spans: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(trace_id, spans, duration_ms, errors) of a trace once no span has come for ``gap``. [J8]"""
    d = spans.withWatermark("started_at", late).groupBy("trace_id", F.session_window("started_at", gap))
    out = d.agg(F.count(F.lit(1)).alias("spans"), F.min("started_at").alias("first"), F.max("ended_at").alias("last"), F.count("error").alias("errors"))
    return out.select("trace_id", "spans", ((F.unix_micros("last") - F.unix_micros("first")) / 1000).alias("duration_ms"), "errors")


def finished_answers(tokens: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """(trace_id, answer): token rows (trace_id, ts, position, token) put together in order. [J9]"""
    d = tokens.withWatermark("ts", late).groupBy("trace_id", F.session_window("ts", gap)).agg(F.collect_list(F.struct("position", "token")).alias("t"))
    return d.select("trace_id", F.array_join(F.transform(F.array_sort("t"), lambda x: x["token"]), "").alias("answer"))


_DECISION = ["key", "event_id", "allowed", "remaining", "retry_after"]


class Quota(StatefulProcessor):
    """A key's window starts with its first event and starts anew when it is over; state: start and count. [J7]

    Rows of a key come in several Arrow frames in any order; those of a batch are put in order before they are decided.
    """

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start double, n long")

    def decide(self, key, ordered: Iterable[tuple[float, int]]) -> pd.DataFrame:
        """Decisions on (time, event id) in order, and the window as it then stands."""
        start, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for t, e in ordered:
            if start is None or t - start >= self.seconds:
                start, n = t, 0
            n += 1
            out.append((key[0], e, n <= self.limit, max(0, self.limit - n), max(1, int(self.seconds - (t - start)))))
        if start is not None:
            self.window.update((float(start), int(n)))
        return pd.DataFrame(out, columns=_DECISION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat([frame[["t", "event_id"]] for frame in rows]).sort_values(["t", "event_id"])
        yield self.decide(key, every.itertuples(index=False, name=None))

    def close(self) -> None:
        pass


class LateQuota(Quota):
    """Rows wait in the state until the watermark has passed them, so that batches may come out of order, too. [J7]"""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "t double, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, passed = None, timerValues.getCurrentWatermarkInMs() / 1000
        for frame in rows:
            frame = frame[frame["t"] > passed]
            if frame.empty:
                continue
            self.waiting.appendList([(float(t), int(e)) for t, e in frame[["t", "event_id"]].itertuples(index=False, name=None)])
            first = frame["t"].min() if first is None else min(first, frame["t"].min())
        self._wake(first)
        yield pd.DataFrame([], columns=_DECISION)

    def _wake(self, first: float | None) -> None:
        if first is not None:
            self.handle.registerTimer(int(first * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((r[0], r[1]) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        yield self.decide(key, ready)


def quota_stream(events: DataFrame, limit: int, seconds: float, late: str | None = None) -> DataFrame:
    """Decisions over a stream of events(key, event_id, ts); needs the RocksDB state store. [J7]

    Without ``late`` a batch is decided when it comes, its rows in the order of time; rows that are older than those of
    an earlier batch count in the window that is open. With ``late``, rows are decided once the watermark of so much
    has passed them, in the order of time over all batches; rows behind the watermark are dropped. A task holds the
    rows of one key in a batch, or those that wait; ``maxFilesPerTrigger`` and ``late`` bound them.
    """
    kind = events.schema["key"].dataType.simpleString()
    out = f"key {kind}, event_id long, allowed boolean, remaining long, retry_after long"
    time = (F.unix_micros("ts") / 1e6).alias("t")
    if late is None:
        return events.select("key", "event_id", time).groupBy("key").transformWithStateInPandas(Quota(limit, seconds), out, "Append", "None")
    rows = events.withWatermark("ts", late).select("key", "event_id", time, "ts")
    return rows.groupBy("key").transformWithStateInPandas(LateQuota(limit, seconds), out, "Append", "EventTime")


class Claims(StatefulProcessor):
    """Failures of a document since its last enqueue; a timer marks a claim that nobody finished. [J3]

    Rows of a document come in several Arrow frames in any order; those of a batch are taken in the order of seq. A row
    that comes after one of a higher seq has been taken is too late to change the state and is passed over.
    """

    def __init__(self, budget: int, stale_ms: int) -> None:
        self.budget, self.stale_ms = budget, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int, seq long")
        self.timer = handle.getValueState("timer", "at long")

    def _forget_timer(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleInputRows(self, key, rows, timerValues):
        n, seen = self.failures.get() if self.failures.exists() else (0, None)
        state = None
        every = pd.concat([frame[["seq", "outcome"]] for frame in rows]).sort_values("seq", kind="stable")
        for seq, outcome in every.itertuples(index=False, name=None):
            if seen is not None and seq < seen:
                continue
            seen = int(seq)
            self._forget_timer()
            if outcome is None or pd.isna(outcome):
                n, state = 0, "due"
            elif outcome == "failed":
                n += 1
                state = "parked" if n >= self.budget else "due"
            elif outcome == "claimed":
                state = "running"
                at = timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
                self.handle.registerTimer(at)
                self.timer.update((at,))
            else:
                state = outcome
        if state is not None:
            self.failures.update((n, seen))
        yield pd.DataFrame([(key[0], n, state)] if state is not None else [], columns=["document_id", "failures", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        n = self.failures.get()[0] if self.failures.exists() else 0
        yield pd.DataFrame([(key[0], n, "stale")], columns=["document_id", "failures", "state"])

    def close(self) -> None:
        pass


def retry_stream(log: DataFrame, budget: int = 3, stale_ms: int = 600_000) -> DataFrame:
    """(document_id, failures, state) as log(document_id, seq, outcome) goes on. [J3]"""
    return log.groupBy("document_id").transformWithStateInPandas(Claims(budget, stale_ms), f"document_id {log.schema['document_id'].dataType.simpleString()}, failures int, state string", "Update", "processingTime")


def evaluate_new(examples: DataFrame, score: Callable[[DataFrame], DataFrame], results: str, fingerprint: str, checkpoint: str) -> StreamingQuery:
    """Scores examples that have no result under the fingerprint yet and appends them. [J10 C13]"""

    def run(batch: DataFrame, _: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(results).where(F.col("fingerprint") == fingerprint)
            batch = batch.join(done.select("example_id").distinct(), "example_id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        score(batch).withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").parquet(results)

    return examples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
