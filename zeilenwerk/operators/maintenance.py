"""Sum checks that are kept, and corrected after an edit instead of made anew.

A store has two tables, `facts` (rows that hold their cells) and `checks` (one row a page and column), both partitioned by
a bucket of the document. An edit changes cells or rows; its buckets are read, the changed pages found by a semi-join, and
only their sums made again. Buckets without an edit are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from .reconcile import page_checks

#: Partitions of a store. Their numbers come to the driver for pruning, so this bounds what comes.
BUCKETS = 64
PAGE = ["doc_id", "page_index"]


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")


def _checked(facts: DataFrame, buckets: int) -> DataFrame:
    return page_checks(facts).withColumn("bucket", bucket(buckets))


def replace(df: DataFrame, path: str) -> None:
    """Only the partitions at hand are replaced, when the job commits; each bucket is one task's."""
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(facts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """facts: doc_id, page_index, row_seq, kind, cells (array of column_index, count)."""
    kept = facts.select("doc_id", "page_index", "row_seq", "kind", F.transform("cells", lambda c: F.struct(c["column_index"].cast("int").alias("column_index"), c["count"].cast("double").alias("count"))).alias("cells"), bucket(buckets).alias("bucket"))
    replace(kept, f"{path}/facts")
    replace(_checked(kept, buckets), f"{path}/checks")


def checks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/checks").drop("bucket")


def _edited(facts: DataFrame, cells: DataFrame | None, kinds: DataFrame | None) -> DataFrame:
    key = ["doc_id", "row_seq"]
    if cells is not None:
        new = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("column_index").cast("int"), F.struct(F.col("count").cast("double").alias("count"))))).alias("__new"))
        facts = facts.join(new, key, "left")
        had = F.transform("cells", lambda c: F.struct(c["column_index"].alias("column_index"), F.coalesce(F.element_at("__new", c["column_index"]), F.struct(c["count"].alias("count")))["count"].alias("count")))
        more = F.transform(F.array_except(F.map_keys("__new"), F.col("cells.column_index")), lambda i: F.struct(i.alias("column_index"), F.element_at("__new", i)["count"].alias("count")))
        facts = facts.withColumn("cells", F.when(F.col("__new").isNull(), F.col("cells")).otherwise(F.concat(had, more))).drop("__new")
    if kinds is not None:
        facts = facts.join(kinds.select(*key, F.col("kind").alias("__kind")), key, "left").withColumn("kind", F.coalesce("__kind", "kind")).drop("__kind")
    return facts


def edit(spark: SparkSession, path: str, cells: DataFrame | None = None, kinds: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Applies edits to a store and gives the pages whose checks were made again. cells: doc_id, row_seq, column_index,
    count (null: the cell has none), once a cell; kinds: doc_id, row_seq, kind, once a row. Edits of rows that aren't
    there change nothing. Edits may be as many as the facts; texts of a page are not read."""
    key = ["doc_id", "row_seq"]
    touched = [e.select(*key) for e in (cells, kinds) if e is not None]
    if not touched:
        raise ValueError("no edits")
    rows = touched[0].unionByName(touched[1]) if len(touched) > 1 else touched[0]
    rows = written(rows.distinct().withColumn("bucket", bucket(buckets)), "edits")
    hit = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # BUCKETS at most
    facts = spark.read.parquet(f"{path}/facts").where(F.col("bucket").isin(hit))
    pages = facts.join(rows.drop("bucket"), key, "left_semi").select(*PAGE).distinct()
    pages = written(pages, "pages")
    # the new state first, then both tables are replaced from it
    new = written(_edited(facts, cells, kinds), "facts")
    old_checks = spark.read.parquet(f"{path}/checks").where(F.col("bucket").isin(hit)).join(pages, PAGE, "left_anti")
    again = _checked(new.join(pages, PAGE, "left_semi"), buckets)
    again = written(old_checks.unionByName(again.select(old_checks.columns)), "checks")
    replace(new, f"{path}/facts")
    replace(again, f"{path}/checks")
    # a bucket whose last check goes has no rows that would replace it
    left = {r[0] for r in again.select("bucket").distinct().collect()}
    for b in set(hit) - left:
        drop(spark, f"{path}/checks/bucket={b}")
    return pages


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
