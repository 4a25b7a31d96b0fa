"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: longs) -> v, label: the smallest vertex that can be reached. Labels go over the edges, then each
    takes its label's label; every round is a written table. Vertices without edges have no row.

    A vertex of very many edges is on the side that Spark splits in its join, and its edges are summed up before they
    are shuffled."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = written(step.join(jump, "label").select("v", F.least("label", "next").alias("label"), (F.col("old") != F.least("label", "next")).alias("moved")), "labels")
        labels = new.select("v", "label")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components: no end of the rounds")
    return labels
