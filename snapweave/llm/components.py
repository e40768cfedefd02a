"""Connected components of an edge table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(edges: DataFrame, shelf: Shelf, name: str, most: int = 60) -> DataFrame:
    """(v, c) for every end of `edges` (a, b): c is the smallest vertex of v's component.

    Each round takes the least label among neighbours and then the label's own label, so paths shrink by
    half or better; all tables are written, and a hub's edges are pre-aggregated before they meet.
    """
    both = shelf.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = shelf.put(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")), f"{name}-0")
    for k in range(1, most):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        low = shelf.put(labels.join(near, "v").select("v", F.least("c", "n").alias("c"), F.col("c").alias("was")), f"{name}-{k}-low")
        jump = low.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = shelf.put(low.join(jump, "c").select("v", F.col("j").alias("c"), (F.col("j") != F.col("was")).alias("changed")), f"{name}-{k}")
        shelf.drop(f"{name}-{k}-low", f"{name}-{k - 1}")
        labels = new.select("v", "c")
        if not new.where("changed").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
