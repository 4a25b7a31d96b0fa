"""A store of documents that hold their children: one row a document, partitioned by project.

A document is written with the arrays of its rows (which hold their cells), columns and footnotes, so reading one needs no
join, and Spark prunes what isn't asked for: projects by partition, documents by pushed filters, children and their fields
by the scan's schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import write_documents
from ..tables import buckets


def nested(documents: DataFrame, order: dict[str, list[str]], **children: DataFrame) -> DataFrame:
    """documents with an array for each kind of children (tables with doc_id), in the order given for it; empty where a
    document has none."""
    out = documents
    for name, df in children.items():
        cols = [c for c in df.columns if c != "doc_id"]
        first = [c for c in order.get(name, []) if c in cols]
        item = F.struct(*first, *[c for c in cols if c not in first])
        one = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias(name))
        out = out.join(one, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{df.select(item.alias('x')).schema['x'].dataType.simpleString()}>")))
    return out


def write(documents: DataFrame, path: str) -> None:
    """Replaces the projects at hand, in files that are sorted by document, so that filters skip row groups."""
    n = buckets(documents)
    # a project may be most of the store: its documents are dealt out, too
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n // 4 + 1))
    write_documents(documents.repartition(n, "project", part).sortWithinPartitions("project", "doc_id"), path, ("project",))


def read(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("project") == project) if project is not None else df


def newest_first(documents: DataFrame) -> DataFrame:
    """Latest import first, then by name."""
    return documents.orderBy(F.col("importiert_am").desc_nulls_last(), "datei", "doc_id")


def children(documents: DataFrame, name: str) -> DataFrame:
    """doc_id and the children of a kind, one row each, with n, their place."""
    each = documents.select("doc_id", F.posexplode(name).alias("n", "__x"))
    return each.select("doc_id", "n", "__x.*")


def latest(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Of documents of equal keys the one that was imported last."""
    order = W.partitionBy(*keys).orderBy(F.col("importiert_am").desc_nulls_last(), F.col("doc_id").desc())
    return documents.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
