"""Exact order statistics of groups of any size: histograms that narrow to the asked rank. [D11 D12 D15 D16 I22 K17]"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.sources.scratch import discard, materialize

#: Buckets of a histogram, values of a bracket that are counted one by one, and asked ranks that are broadcast.
BUCKETS, FEW, BROADCAST_ASKED = 1 << 10, 1 << 14, 1 << 16
Rank = Callable[[Column], Column]


def disc(p: float) -> Rank:
    """The first rank whose share of the n rows reaches p."""

    def rank(n: Column) -> Column:
        up = F.greatest(F.ceil(F.lit(float(p)) * n), F.lit(1)).cast("long")
        return F.when((up > 1) & ((up - 1) / n >= p), up - 1).otherwise(up)

    return rank


def place(share: float) -> Rank:
    """The place int(share * n), counted from 0, the last one at most."""
    return lambda n: F.least(n, F.floor(F.lit(float(share)) * n) + 1)


#: Both middle ranks; they are one where n is odd.
MEDIAN: dict[str, Rank] = {"lower": lambda n: F.floor((n + 1) / 2), "upper": lambda n: F.floor(n / 2) + 1}


def at_ranks(rows: DataFrame, value: str, asks: dict[str, Rank], group: tuple[str, ...] = ()) -> DataFrame:
    """(group, one column for each ask): the value of the asked rank (from 1) among the group's values, as a double.

    Nulls are passed over; groups without a value are left out. -inf, inf and NaN stand at the ends, in this order.
    Extremes and counts of each group come first. As long as a bracket holds more than FEW values, these are counted in
    BUCKETS equal steps between its ends; the bucket with the rank, from its least to its greatest value, is the next
    bracket, which is smaller in any case. Then equal values are counted. Counts combine in tasks, and no task gets
    more than BUCKETS or FEW rows of a group, however large or equal its values are.
    """
    d = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    v = F.col("_v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    ends = d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(v == float("-inf")).alias("_under"), F.count_if(finite).alias("_n"), F.count_if(v == float("inf")).alias("_over"),
        F.min(F.when(finite, v)).alias("_low"), F.max(F.when(finite, v)).alias("_high"),
    )
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("ask"), rank(F.col("_all")).cast("long").alias("rank")) for name, rank in asks.items())))
    own = F.col("_rank") - F.col("_under")
    known = F.when(own <= 0, float("-inf")).when(own > F.col("_n") + F.col("_over"), float("nan")).when(own > F.col("_n"), float("inf")).when(F.col("_low") == F.col("_high"), F.col("_low"))
    first = ends.where("_all > 0").select("*", each.alias("_x")).withColumn("_ask", F.col("_x.ask")).withColumn("_rank", F.col("_x.rank"))
    state = materialize(first.select(*group, "_ask", own.alias("_rank"), "_n", "_low", "_high", known.alias("_value")))
    made, done = [state], []
    while True:
        done.append(state.where("_value is not null").select(*group, "_ask", "_value"))
        left = state.where("_value is null")
        size = left.agg(F.count(F.lit(1)).alias("asked"), F.max("_n").alias("n")).first()
        if not size.asked:
            break
        hint = F.broadcast if size.asked <= BROADCAST_ASKED else lambda x: x
        both = d.join(hint(_renamed(left, group)), reduce(lambda a, b: a & b, [v.between(F.col("_low"), F.col("_high")), *(F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group)]))
        if size.n <= FEW:
            done.append(_picked(both.groupBy(*group, "_ask", "_rank", v.alias("_at")).agg(F.count(F.lit(1)).alias("_c")), group).select(*group, "_ask", F.col("_at").alias("_value")))
            break
        # halves of large numbers, so that the distance of both ends can't overflow; it is over 0, as both differ
        half = F.when(F.greatest(F.abs("_low"), F.abs("_high")) > 1, 0.5).otherwise(1.0)
        step = F.least(F.lit(BUCKETS - 1), F.floor((v * half - F.col("_low") * half) / (F.col("_high") * half - F.col("_low") * half) * BUCKETS))
        counted = both.groupBy(*group, "_ask", "_rank", step.alias("_at")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        narrowed = _picked(counted, group).select(*group, "_ask", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_c").alias("_n"), "_low", "_high", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_value"))
        state = materialize(narrowed)
        made.append(state)
    found = materialize(reduce(DataFrame.unionByName, done))
    discard(*made)
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("_ask") == name, F.col("_value"))).alias(name) for name in asks))


def _renamed(state: DataFrame, group: tuple[str, ...]) -> DataFrame:
    return state.select(*(F.col(g).alias(f"_g_{g}") for g in group), "_ask", "_rank", "_low", "_high")


def _picked(counted: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Of counted(group, _ask, _rank, _at, _c) the row that holds the rank, with the number of values before it."""
    upto = F.sum("_c").over(Window.partitionBy(*group, "_ask").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_before", upto - F.col("_c")).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_c")))


def with_ranks(one: DataFrame, rows: DataFrame, value: str, asks: dict[str, Rank], group: tuple[str, ...] = ()) -> DataFrame:
    """one(group, ...), a row for each group, plus the asked columns; null where a group has no value."""
    found = at_ranks(rows, value, asks, group)
    if not group:
        return one.join(F.broadcast(found), F.lit(True), "left")  # one row
    named = found.select(*(F.col(g).alias(f"_g_{g}") for g in group), *asks)
    return one.join(named, reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group)), "left").drop(*(f"_g_{g}" for g in group))
