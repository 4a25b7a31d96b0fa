"""Helpers that every operator here uses: tables, the shared folder, Arrow batch sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import CLEANUP, scratch, shared_dir, written  # noqa: F401  the operators' own

#: Rows in an Arrow batch. Texts may be long, so a batch stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 8192) -> Iterator[pa.Table]:
    """Sorted batches as tables of `least` rows and more that end where the key changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        if rows >= least:
            k = b.column(key).to_numpy()
            at = int((k != held[-1].column(key)[-1].as_py()).argmax())
            if k[at] != held[-1].column(key)[-1].as_py():
                yield pa.Table.from_batches([*held, b.slice(0, at)])
                held, rows, b = [], 0, b.slice(at)
        held.append(b)
        rows += len(b)
    if held:
        yield pa.Table.from_batches(held)


def starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]


def numbered(df: DataFrame, order: list[Column], *keep: Column | str) -> DataFrame:
    """keep with `at`: the rows' numbers from 0 in a global order. Rows are dealt out by ranges of the order, so that no
    task has them all, and written in it; each range then starts where those before it end. Only the ranges' sizes (one
    row a partition) meet in one task. Rows of equal order get their numbers as they come."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("__id"))
    rows = written(rows, "ordered").withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts_at = F.broadcast(sizes.select("__part", before.alias("__start")))
    return rows.join(starts_at, "__part").withColumn("at", F.col("__start") + F.col("__in")).drop("__part", "__in", "__id", "__start")
