"""Connected components of an edge list by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrack.plans.lineage import cut, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", large: bool = False) -> DataFrame:
    """``(node, component)`` for every node on an edge; component is the least node reachable.

    Each round takes the least label among the neighbours and then follows the
    label's own label (pointer jumping), so long chains close in about a
    logarithmic number of rounds. Only a count of changed labels reaches the
    driver. Self-loops, repeated edges and either direction are allowed; rows
    with a null end are ignored. An edge table without rows gives none. A
    ``large`` graph is never broadcast: its tables are small as files and many
    times that as rows on the driver.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    old, kept = labels, lambda df: df.hint("merge") if large else df
    while True:
        near = (both.join(kept(labels.withColumnRenamed("node", "b")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        step = labels.join(kept(near), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        if large:  # all nodes that share a label follow the least that one of them has met, and its own
            hook = step.groupBy("was").agg(F.min("label").alias("h"))
            far = hook.join(kept(hook.select(F.col("was").alias("h"), F.col("h").alias("up"))), "h").select("was", F.least("h", "up").alias("up"))
            new = cut(step.join(kept(far), "was").select("node", "was", F.least("label", "up").alias("label")))
        else:
            up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new = cut(step.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        done = new.where("label <> was").isEmpty()
        release(old)
        old, labels = new, new.select("node", "label")
        if done:
            release(both)
            return labels.select("node", F.col("label").alias("component"))
