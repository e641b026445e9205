"""Connected components of an edge table, wholly in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.llm.store import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b longs); component is the least id that can be reached.

    Each round takes the least label among a node's neighbours and then the label of that label (pointer jumping), so long
    chains halve.  A hub's labels meet in a partial aggregation, never in a list.  No edges: no rows.  Null ends are ignored;
    repeated edges and loops change nothing.
    """
    edges = edges.where("a is not null and b is not null")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = written(labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low")), "cc-step")
        roots = step.select(F.col("id").alias("low"), F.col("low").alias("root"))
        after = written(step.join(roots, "low").select("id", F.least("low", "root").alias("component"), (F.col("component") != F.least("low", "root")).alias("moved")), "cc-labels")
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            return labels
