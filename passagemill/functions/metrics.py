"""Retrieval metrics as expressions on one example's row. [I6-I14]

``ids``: document ids of the retrieved passages in rank order; ``targets``: distinct expected ids; ``mode``: all or any.
An example without targets (a refusal) has no metric: the callers keep it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_ranks(ids: Column, targets: Column) -> Column:
    """First rank of each target, 0 if absent. [E4]"""
    return F.transform(targets, lambda t: F.coalesce(F.array_position(ids, t), F.lit(0)).cast("int"))


def _found(ranks: Column, k: int | Column) -> Column:
    return F.size(F.filter(ranks, lambda r: (r > 0) & (r <= k)))


def all_targets(ranks: Column, k) -> Column:
    """1 if every target is within the first k. [I8]"""
    return F.when(F.size(ranks) == 0, 0.0).otherwise((_found(ranks, k) == F.size(ranks)).cast("double"))


def any_target(ranks: Column, k) -> Column:
    """1 if some target is within the first k. [I8]"""
    return (_found(ranks, k) > 0).cast("double")


def satisfied(ranks: Column, mode: Column, k) -> Column:
    return F.when(mode == "any", any_target(ranks, k)).otherwise(all_targets(ranks, k))


def recall(ranks: Column, mode: Column, k) -> Column:
    """Share of the targets within the first k; all or nothing in mode any. [I7]"""
    share = F.when(F.size(ranks) == 0, 0.0).otherwise(_found(ranks, k) / F.size(ranks))
    return F.when(mode == "any", any_target(ranks, k)).otherwise(share)


def _inverse(ranks: Column) -> Column:
    return F.transform(ranks, lambda r: F.when(r > 0, 1 / r).otherwise(0.0))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) == 0, 0.0).otherwise(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))


def mrr(ranks: Column, mode: Column) -> Column:
    """Mean reciprocal rank over targets, the best one in mode any. [I9]"""
    return F.when(mode == "any", F.coalesce(F.array_max(_inverse(ranks)), F.lit(0.0))).otherwise(_mean(_inverse(ranks)))


def precision(ids: Column, targets: Column, k) -> Column:
    """Share of k passages whose document is a target; k divides even if fewer came back. [I10]"""
    return F.size(F.filter(F.slice(ids, 1, k), lambda d: F.array_contains(targets, d))) / F.lit(k)


def ndcg(ranks: Column, mode: Column, k) -> Column:
    """Gain over the targets by that of the ideal ranking; the best target's gain in mode any. [I11]"""
    gains = F.transform(ranks, lambda r: F.when((r > 0) & (r <= k), 1 / F.log2(r + 1.0)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(ranks), F.lit(k).cast("int")))), lambda i: 1 / F.log2(i + 1.0)))
    return F.when(F.size(ranks) == 0, 0.0).when(mode == "any", F.array_max(gains)).otherwise(total(gains) / ideal)


def passage_ranks(texts: Column, quotes: Column) -> Column:
    """First rank of a passage that contains each quote (both without white space), 0 if none. [I13]"""
    return F.transform(quotes, lambda q: F.coalesce(F.array_position(F.transform(texts, lambda t: F.contains(t, q)), True), F.lit(0)).cast("int"))


def passage_hit(ranks: Column, mode: Column) -> Column:
    found = F.size(F.filter(ranks, lambda r: r > 0))
    return F.when(F.size(ranks) == 0, None).when(mode == "any", (found > 0).cast("double")).otherwise((found == F.size(ranks)).cast("double"))


def passage_at_1(ranks: Column, mode: Column) -> Column:
    first = F.size(F.filter(ranks, lambda r: r == 1))
    return F.when(F.size(ranks) == 0, None).when(mode == "any", (first > 0).cast("double")).otherwise((first == F.size(ranks)).cast("double"))


def passage_mrr(ranks: Column, mode: Column) -> Column:
    return F.when(F.size(ranks) == 0, None).when(mode == "any", F.array_max(_inverse(ranks))).otherwise(_mean(_inverse(ranks)))
