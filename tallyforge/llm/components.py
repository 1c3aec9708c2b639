"""Connected components of an edge table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges`` (``a, b``): the smallest id that edges lead to.

    Each round hooks every component to its smallest neighbour, follows the hooks to their ends and contracts the
    edges, so at least every second component that still has edges disappears; the number of rounds grows with
    the logarithm of the largest component.  Labels and edges stay in tables; nothing is collected.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        hooks = written(hooks)
        while True:  # halves the paths to the ends each time
            ends = hooks.select(F.col("id").alias("mid"), F.col("to").alias("end"))
            jumped = written(hooks.join(ends, F.col("to") == F.col("mid")).select("id", "to", "end"))
            done = jumped.where("to <> end").isEmpty()
            hooks = jumped.select("id", F.col("end").alias("to"))
            if done:
                break
        if labels is None:
            labels = hooks.select("id", F.col("to").alias("component"))
        else:
            moved = labels.join(hooks.withColumnRenamed("id", "component"), "component", "left")
            labels = moved.select(moved["id"], F.coalesce("to", "component").alias("component"))
        labels = written(labels)
        a, b = hooks.select(F.col("id").alias("a"), F.col("to").alias("ca")), hooks.select(F.col("id").alias("b"), F.col("to").alias("cb"))
        left = written(left.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
