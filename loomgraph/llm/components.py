"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the least node of each node's component, for the nodes of edges (a, b).

    Labels sink along edges and then to their labels' labels, so that paths
    halve with each round; every round is written to the shared folder.
    Repeated edges and loops do no harm; null ends are left out.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    made: list[str] = []
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", made)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels", made)
    while True:
        ends = labels.select(F.col("node").alias("a"), "label")
        low = both.join(ends, "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("low"))
        nearer = written(labels.join(low, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")), f"{name}-near", made)
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(nearer.join(jump, "label").select("node", "old", F.col("further").alias("label")), f"{name}-labels", made)
        for path in made[1:-1]:
            drop_path(spark, path)
        made[1:-1] = []
        changed = after.where("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            drop_path(spark, made[0])
            return labels
