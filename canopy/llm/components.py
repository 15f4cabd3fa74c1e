"""Connected components of a table of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.stage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round takes the smallest component among neighbours and then follows the
    component's own component, so paths shorten by more than half. Rounds are written
    tables; hubs are joined as skewed keys (both sides are read from tables) and their
    minima are aggregated before the shuffle.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).filter("x <> y").distinct(), "edges")
    state = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")), "components")
    while True:
        seen = both.join(state, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("near"))
        best = state.join(seen, F.col("node") == F.col("x")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        best = written(best, "components")
        up = best.select(F.col("node").alias("__up"), F.col("near").alias("__near"))
        after = best.join(up, F.col("near") == F.col("__up")).select("node", "old", F.least("near", "__near").alias("component"))
        after = written(after, "components")
        if after.filter("old <> component").isEmpty():
            return after.select("node", "component")
        state = after.select("node", "component")
