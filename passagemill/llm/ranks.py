"""Places of rows in one order over a whole table, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

_ROW_BITS = 33  # monotonically_increasing_id has the row of a partition in these


def with_rank(rows: DataFrame, order: list[Column], name: str = "rank", group: str | None = None) -> DataFrame:
    """rows plus their place (from 1) in ``order``; with ``group``, in their group (``order`` must start with it).

    Rows are dealt out by ranges of the order, sorted within and written with their place in the partition; a row
    count for each partition (and the first place of each group) gives what to add. Equal rows share no place.
    """
    here, part = f"_{name}_here", f"_{name}_part"
    cut = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(here, F.monotonically_increasing_id()))
    local = F.col(here).bitwiseAND((1 << _ROW_BITS) - 1)
    placed = cut.withColumn(part, F.shiftright(here, _ROW_BITS))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = sizes.select(F.col(part).alias("_p"), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("_before"))
    out = placed.join(F.broadcast(before), F.col(part) == F.col("_p")).withColumn(name, F.col("_before") + local + 1)
    if group is not None:
        first = out.groupBy(F.col(group).alias("_g")).agg((F.min(name) - 1).alias("_first"))
        out = out.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col(name) - F.col("_first")).drop("_g", "_first")
    return out.drop(here, part, "_p", "_before")


