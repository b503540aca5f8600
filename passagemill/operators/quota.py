"""Fixed windows that start at a key's first event, for keys of any size. [J7]

Rows are dealt by ranges of (key, time, event), so a key with very many events lies in several ranges. Each range is
decided as if its keys began there. That is right for all but the first key of a range, which an earlier range may have
begun. Where a key's windows end in one range and go on in the next is then found from the few rows that can be the
first start in a range, by doubled pointers over ranges; only those first keys are decided anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.sources.scratch import discard, materialize

_OUT = ["key", "event_id", "allowed", "remaining", "retry_after"]
_DECISION = "allowed boolean, remaining long, retry_after long"
_PIECE = f"block int, run int, edge boolean, at long, t long, {_DECISION}, candidate boolean, exit_t long, exit_at long"


def quota_decisions(events: DataFrame, limit: int, seconds: float, ranges: int | None = None) -> DataFrame:
    """(key, event_id, allowed, remaining, retry_after) with windows that start at a key's first event. [J7]

    events(key, event_id, ts). Events of a key are taken by time, then event_id; the first ``limit`` of a window are
    allowed, and an event ``seconds`` or more after a window's start begins the next. Null is a key of its own; events
    without a time are in no window and get nulls; repeated rows count each time. A task holds its range of rows (all
    rows by the number of ranges, whatever the keys); ``ranges`` sets that number, which Spark chooses otherwise.
    """
    width = round(seconds * 1_000_000)
    rows = events.select("key", "event_id", F.unix_micros("ts").alias("t"))
    timed = rows.where("t is not null")
    by = [F.col("key"), F.col("t"), F.col("event_id")]
    dealt = (timed.repartitionByRange(*by) if ranges is None else timed.repartitionByRange(ranges, *by)).sortWithinPartitions(*by)
    own = {f.name: f.dataType.simpleString() for f in timed.schema}
    placed = materialize(dealt.mapInArrow(_decide_range(limit, width), f"key {own['key']}, event_id {own['event_id']}, {_PIECE}"))
    split = _split_runs(placed)
    untimed = rows.where("t is null").select("key", "event_id", *(F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in _DECISION.split(", "))))
    if split.isEmpty():
        discard(split)
        return placed.select(*_OUT).unionByName(untimed)
    entered = _entries(placed, split, width)
    # At most one row for each range: the first key of a range that goes on from an earlier one.
    anew = F.broadcast(entered.select("block", "run", "before", "start_t", "start_at"))
    right = placed.join(anew, ["block", "run"], "left_anti").select(*_OUT)
    again = placed.join(anew, ["block", "run"]).select("key", "event_id", "t", "at", "block", "before", "start_t", "start_at")
    again = again.repartition("block").sortWithinPartitions("block", "at")
    redone = again.mapInArrow(_decide_on(limit, width), f"key {own['key']}, event_id {own['event_id']}, {_DECISION}")
    return right.unionByName(redone).unionByName(untimed)


def _verdicts(count: np.ndarray, since: np.ndarray, limit: int, width: int) -> list[pa.Array]:
    """allowed, remaining and retry_after from the place in the window and the time since its start."""
    return [pa.array(count <= limit), pa.array(np.maximum(0, limit - count)), pa.array(np.maximum(1, (width - since) // 1_000_000))]


def _decide_range(limit: int, width: int):
    """Decides a range as if each of its keys began there, and notes where the windows of its outer keys can begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n, t = table.num_rows, table["t"].to_numpy()
        codes = table["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        runs = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, n)))
        at = np.arange(n) - firsts[runs]
        starts = _starts(t, runs, width)
        candidate, exit_t, exit_at = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for low, high in {(0, int(np.append(firsts, n)[1])), (int(firsts[-1]), n)}:
            mine = t[low:high]
            last = _exits(mine, width)
            beyond = int(np.searchsorted(mine, mine[0] + width, "left"))
            new = np.concatenate([[True], mine[1:] != mine[:-1]])
            candidate[low:high] = new & (mine <= mine[min(beyond, len(mine) - 1)])
            exit_t[low:high], exit_at[low:high] = mine[last], last
        edge = (runs == 0) | (runs == runs[-1])
        block = np.full(n, TaskContext.get().partitionId(), np.int32)
        count, since = np.arange(n) - starts + 1, t - t[starts]
        made = [block, runs.astype(np.int32), edge, at, t, *_verdicts(count, since, limit, width), candidate, exit_t, exit_at]
        names = ["key", "event_id", *(x.split()[0] for x in _PIECE.split(", "))]
        yield from pa.table([table["key"], table["event_id"], *made], names=names).to_batches(max_chunksize=65_536)

    return run


def _starts(t: np.ndarray, runs: np.ndarray, width: int) -> np.ndarray:
    """The position of the first event of each event's window; every run begins one."""
    out = np.empty(len(t), np.int64)
    begun = own = start = -1
    for low in range(0, len(t), 65_536):
        for i, (x, r) in enumerate(zip(t[low : low + 65_536].tolist(), runs[low : low + 65_536].tolist(), strict=True), low):
            if r != own or x - start >= width:
                own, start, begun = r, x, i
            out[i] = begun
    return out


def _exits(t: np.ndarray, width: int) -> np.ndarray:
    """For each position of a key's times in order: the last start of the windows that begin there, by doubled steps."""
    step = np.searchsorted(t, t + width, "left")
    step = np.where(step < len(t), step, np.arange(len(t)))
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return step
        step = further


def _split_runs(placed: DataFrame) -> DataFrame:
    """(chain, block, run, t0, t1, before, previous) of the keys that lie in several ranges; at most two rows a range.

    chain: the key's first range, which names the key, as only the last key of a range goes on. before: its events in
    earlier ranges; previous: the last time there.
    """
    outer = placed.where("edge").groupBy("block", "run").agg(F.first("key").alias("key"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("key").orderBy("block")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    named = outer.select(
        F.min("block").over(every).alias("chain"), F.max("block").over(every).alias("end"), "block", "run", "t0", "t1",
        F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"), F.lag("t1").over(ordered).alias("previous"),
    )
    return materialize(named.where("chain < end").drop("end"))


def _entries(placed: DataFrame, split: DataFrame, width: int) -> DataFrame:
    """(block, run, before, start_t, start_at): the window that is open when a range of a split key begins."""
    starts = placed.where("edge and candidate").select("block", "run", "t", "at", "exit_t", "exit_at")
    nodes = materialize(starts.join(F.broadcast(split.select("chain", "block", "run", "before")), ["block", "run"]))
    steps = materialize(_next_starts(nodes, split, width))
    reached = materialize(split.where("block = chain").select("chain", "block", F.col("t0").alias("t")))
    # A chain has one start in a range at most, so the doubled steps have met all of them after log2(ranges) rounds.
    most = split.groupBy("chain").count().agg(F.max("count")).first()[0]
    rounds = (int(most) - 1).bit_length()
    for i in range(rounds):
        onward = reached.join(steps, ["chain", "block", "t"]).select("chain", F.col("to_block").alias("block"), F.col("to_t").alias("t"))
        grown = materialize(reached.unionByName(onward).distinct())
        if i + 1 < rounds:
            second = steps.select("chain", F.col("block").alias("to_block"), F.col("t").alias("to_t"), F.col("to_block").alias("b2"), F.col("to_t").alias("t2"))
            doubled = materialize(steps.join(second, ["chain", "to_block", "to_t"]).select("chain", "block", "t", F.col("b2").alias("to_block"), F.col("t2").alias("to_t")))
            discard(steps)
            steps = doubled
        discard(reached)
        reached = grown
    met = nodes.join(reached, ["chain", "block", "t"]).select("chain", "block", F.struct(F.col("exit_t").alias("t"), (F.col("before") + F.col("exit_at")).alias("at")).alias("left"))
    earlier = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = split.join(met, ["chain", "block"], "left").withColumn("open", F.last("left", ignorenulls=True).over(earlier))
    out = materialize(full.where("block > chain").select("block", "run", "before", F.col("open.t").alias("start_t"), F.col("open.at").alias("start_at")))
    discard(nodes, steps, reached, split)
    return out


def _next_starts(nodes: DataFrame, split: DataFrame, width: int) -> DataFrame:
    """(chain, block, t, to_block, to_t): from a first start in a range to the first start in a later one.

    The range is the first whose last time reaches the end of the window; within it, the first time that does. Rows of
    a range meet in order of time, latest first, so a running value suffices.
    """
    asked = nodes.select("chain", "block", "t", (F.col("exit_t") + width).alias("x"))
    there = split.select(F.col("chain").alias("c"), F.col("block").alias("to_block"), "t1", "previous")
    hit = (F.col("chain") == F.col("c")) & (F.col("t1") >= F.col("x")) & (F.col("previous") < F.col("x"))
    asks = asked.join(F.broadcast(there), hit).select("chain", "to_block", "x", "block", "t")
    have = nodes.select("chain", F.col("block").alias("to_block"), F.col("t").alias("x"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("long").alias("t"))
    latest_first = Window.partitionBy("chain", "to_block").orderBy(F.desc("x"), F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    to_t = F.last(F.when(F.col("block").isNull(), F.col("x")), ignorenulls=True).over(latest_first)
    return asks.unionByName(have).withColumn("to_t", to_t).where("block is not null").select("chain", "block", "t", "to_block", "to_t")


def _decide_on(limit: int, width: int):
    """Decides the rows of a range's first key in order, from the window that was open before; constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start = begun = None
        for b in batches:
            block, t, place = (b.column(c).to_numpy() for c in ("block", "t", "at"))
            place = place + b.column("before").to_numpy()
            open_t, open_at = b.column("start_t").to_numpy(), b.column("start_at").to_numpy()
            starts, since = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
            for i, (k, x, p) in enumerate(zip(block.tolist(), t.tolist(), place.tolist(), strict=True)):
                if k != own:
                    own, start, begun = k, int(open_t[i]), int(open_at[i])
                if x - start >= width:
                    start, begun = x, p
                starts[i], since[i] = begun, x - start
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), *_verdicts(place - starts + 1, since, limit, width)], names=_OUT)

    return run
