"""Operational event data, batch forms. [D19-D22 D25 E5 E6 F7 H12-H14 H22 J2 J3 J8]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import duration_ms, path_template
from passagemill.sources.scratch import discard, materialize

# Upper bounds of the latency histogram in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_counts(requests: DataFrame) -> DataFrame:
    """(path, status, requests, errors) by path template. [D19 H14]"""
    return requests.groupBy(path_template(F.col("path")).alias("path"), "status").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))


def bucket(seconds: Column) -> Column:
    """Number of the first bound that is not below the value; one more for +Inf."""
    return F.coalesce(*(F.when(seconds <= b, i) for i, b in enumerate(BOUNDS)), F.lit(len(BOUNDS)))


def histogram(rows: DataFrame, value: str, label: str) -> DataFrame:
    """(label, bound, cumulative, total, sum): cumulative bucket counts, +Inf last. [D20 E5]

    Counts are added up per bucket first; the running sum goes over 12 rows for each label.
    """
    counted = rows.groupBy(label, bucket(F.col(value)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    per = counted.groupBy(label).agg(F.sum("n").cast("long").alias("total"), F.round(F.sum("s"), 6).alias("sum"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    edges = F.array(*(F.struct(F.lit(i).alias("b"), F.lit(str(b)).alias("bound")) for i, b in enumerate(BOUNDS)), F.struct(F.lit(len(BOUNDS)).alias("b"), F.lit("+Inf").alias("bound")))
    full = per.select(label, "total", "sum", "m", F.explode(edges).alias("e")).withColumn("n", F.coalesce(F.try_element_at("m", F.col("e.b")), F.lit(0)))
    running = F.sum("n").over(Window.partitionBy(label).orderBy("e.b").rowsBetween(Window.unboundedPreceding, 0))
    return full.select(label, F.col("e.bound").alias("bound"), running.cast("long").alias("cumulative"), "total", "sum")


def outcome_totals(rows: DataFrame, label: str, outcome: str, good: str) -> DataFrame:
    """(label, events, good, ratio): hit ratios of caches, success of tasks. [D21]"""
    g = F.count_if(F.col(outcome) == good)
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("events"), g.alias("good"), F.round(g / F.count(F.lit(1)), 6).alias("ratio"))


def usage_totals(calls: DataFrame, expected: DataFrame, price_per_million: float = 42e-3) -> DataFrame:
    """(config, calls, tokens, cost, degraded): paid calls; degraded if fewer came through than were due. [D22 M4]"""
    used = calls.where("ok").groupBy("config").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("long").alias("tokens"))
    d = expected.join(used, "config", "left").na.fill(0, ["calls", "tokens"])
    return d.select("config", "calls", "tokens", F.round(F.col("tokens") / 1e6 * price_per_million, 6).alias("cost"), (F.col("calls") < F.col("expected")).alias("degraded"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(tenant_id, kind, n) without repeated feedback ids. [D25 J4]"""
    return feedback.dropDuplicates(["feedback_id"]).groupBy("tenant_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def latest_intent(log: DataFrame) -> DataFrame:
    """The newest desired state of each document: latest event time, then sequence. [E6 J2]

    Two rows meet in an aggregate with map-side combine, so a document with a very long history is no hot task.
    """
    rest = [c for c in log.columns if c != "document_id"]
    return log.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("event_time", "seq")).alias("x")).select("document_id", "x.*")


def retry_state(log: DataFrame, now: Column, budget: int = 3, stale_after: str = "INTERVAL 10 MINUTES", error_length: int = 2000) -> DataFrame:
    """(document_id, failures, state, last_error): third failure since the last enqueue parks a document. [J3]

    log(document_id, seq, event_time, operation, outcome, error): outcome null = enqueued, claimed, failed or done.
    """
    started = F.max(F.when(F.col("outcome").isNull(), F.col("seq")))
    last = log.groupBy("document_id").agg(started.alias("since"))
    d = log.join(last, "document_id").where(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    own = d.groupBy("document_id").agg(
        F.count_if(F.col("outcome") == "failed").alias("failures"),
        F.max_by(F.coalesce("outcome", F.lit("pending")), "seq").alias("last"),
        F.max("event_time").alias("latest"),
        F.substring(F.max_by("error", F.when(F.col("outcome") == "failed", F.col("seq"))), 1, error_length).alias("last_error"),
    )
    stale = F.col("latest") < now - F.expr(stale_after)
    state = F.when(F.col("last") == "done", "done").when(F.col("failures") >= budget, "parked").when((F.col("last") == "claimed") & ~stale, "running").when((F.col("last") == "claimed") & stale, "stale").otherwise("due")
    return own.select("document_id", "failures", state.alias("state"), "last_error")


def oldest_due(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest due jobs: the claim size is the feature. [F7]"""
    return jobs.where("state = 'due'").orderBy("created_at", "id").limit(n)


def span_depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth): 1 for a span without a parent in its trace, else one more than its parent's.

    Every span points to its parent at first; each round replaces the pointer by that of the span pointed to, so a
    chain of n spans takes log2(n) rounds. Spans that hang on a circle have no root; their depth is 1.
    """
    one = spans.groupBy("trace_id", "span_id").agg(F.min("parent_id").alias("up"))
    there = one.select("trace_id", F.col("span_id").alias("up"), F.lit(True).alias("known"))
    at = one.join(there, ["trace_id", "up"], "left").select("trace_id", "span_id", F.when(F.col("known"), F.col("up")).alias("up"), F.coalesce(F.col("known").cast("long"), F.lit(0).cast("long")).alias("steps"))
    at = materialize(at)
    rounds = max(1, at.count()).bit_length()
    for _ in range(rounds):
        if at.where("up is not null").isEmpty():
            break
        above = at.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        jumped = at.join(above, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0).cast("long"))).alias("steps"))
        before, at = at, materialize(jumped)
        discard(before)
    return at.select("trace_id", "span_id", F.when(F.col("up").isNull(), F.col("steps") + 1).otherwise(1).cast("int").alias("depth"))


def trace_rollup(spans: DataFrame) -> DataFrame:
    """(trace_id, spans, duration_ms, depth, errors). [J8 H22]

    spans(trace_id, span_id, parent_id, started_at, ended_at, error); of any depth.
    """
    deep = span_depths(spans).groupBy("trace_id").agg(F.max("depth").alias("depth"))
    own = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.round(duration_ms(F.min("started_at"), F.max("ended_at")), 6).alias("duration_ms"), F.count("error").alias("errors"))
    return own.join(deep, "trace_id")


def stage_times(spans: DataFrame) -> DataFrame:
    """(trace_id, name, spans, total_ms, own_ms): the time of each stage of a trace, and what its child spans leave of it. [J8 H22]

    spans(trace_id, span_id, parent_id, name, started_at, ended_at). Children are added up by their parent before they
    meet it, so a span with very many children is one row; a span that is still open (no end) counts and adds no time.
    Children that run side by side may take more than their parent: its own time is then 0. Spans of one id are one.
    """
    micros = F.coalesce(F.unix_micros("ended_at") - F.unix_micros("started_at"), F.lit(0).cast("long"))
    one = spans.groupBy("trace_id", "span_id").agg(F.min_by(F.struct("parent_id", "name", micros.alias("took")), F.struct("started_at", "name")).alias("x")).select("trace_id", "span_id", "x.*")
    below = one.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("took").alias("below"))
    own = F.greatest(F.col("took") - F.coalesce("below", F.lit(0).cast("long")), F.lit(0).cast("long"))
    each = one.join(below, ["trace_id", "span_id"], "left").groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("spans"), F.sum("took").alias("took"), F.sum(own).alias("own"))
    return each.select("trace_id", "name", "spans", F.round(F.col("took") / 1000, 3).alias("total_ms"), F.round(F.col("own") / 1000, 3).alias("own_ms"))
