"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round joins every node to its smallest neighbour (or itself) and carries the edges over to those; a chain of
    n nodes takes about log n rounds. The smallest node of a component always stays, so it names the component. Only
    aggregations with map-side combine and joins that Spark can split on skew; one row count goes to the driver.
    Self-loops and repeated edges are harmless; edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = materialize(pairs)
    labels = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while pairs.limit(1).count():
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")))
        of = lambda name: least.select(F.col("u").alias(name), F.col("to").alias(f"{name}_to"))
        known, labels = labels, materialize(
            labels.join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component"))
        )
        before, pairs = pairs, materialize(
            pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v")).where("u <> v").distinct()
        )
        discard(known, before, least)
    return labels
