"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges (a, b) -> (node, label): the smallest node reachable. No edges give no rows.

    A round takes each node's smallest neighbouring label (a grouped minimum, so hubs are pre-aggregated) and then the
    label of that label, which halves chains; every round is written, so none depends on executors' local state.
    """
    both = tables.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = tables.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = tables.put(lower.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = not new.filter("label < was").isEmpty()
        tables.drop(labels)
        labels = new
        if not changed:
            tables.drop(both)
            return labels.select("node", "label")
