"""One-to-one matching, best pairs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import buckets, written

#: Rounds between two written tables.
STEP = 2


def best_pairs(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """The pairs that are taken if, within each group of keys, the first pair in order is taken, all others of its left
    and right side go, and so on. Columns: those of pairs.

    In rounds: a pair that is the first of both its left and its right side is taken, wherever it stands, and what shares
    a side with it goes. As the order is total (left and right end it), that is the same as one after another, but all
    groups and all such pairs advance at once. A round is four windows within the groups' partitioning, without a shuffle
    of its own; it ends when no pair is open."""
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    rows = pairs.withColumn("__n", F.row_number().over(group.orderBy(*order, left, right))).withColumn("__taken", F.lit(False))
    of_left, of_right = W.partitionBy(*keys, left), W.partitionBy(*keys, right)

    def round_(df: DataFrame) -> DataFrame:
        open_ = F.when(~F.col("__taken"), F.col("__n"))
        df = df.withColumn("__l", F.min(open_).over(of_left)).withColumn("__r", F.min(open_).over(of_right))
        df = df.withColumn("__taken", F.col("__taken") | ((F.col("__n") == F.col("__l")) & (F.col("__n") == F.col("__r"))))
        df = df.withColumn("__busy", F.max("__taken").over(of_right)).withColumn("__busy", F.col("__busy") | F.max("__taken").over(of_left))
        return df.where("__taken or not __busy").drop("__l", "__r", "__busy")

    n = buckets(pairs)
    while True:
        for _ in range(STEP):
            rows = round_(rows)
        rows = written(rows, "matching", keys, n)
        if rows.where("not __taken").isEmpty():
            return rows.drop("__n", "__taken")
