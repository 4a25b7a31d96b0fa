"""Projects: folders of tables under one root, each table partitioned by a bucket of the document.

A project's folder is the slug of its name, its name stands in `projekt.txt`. Folders are made, emptied and removed by
Hadoop's file system, so a root may be anywhere Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..tables import written
from .maintenance import BUCKETS, bucket, drop, replace
from .store import without

#: Fixed value: the project of those who name none.
DEFAULT = "Standard"
NAME, TABLES = "projekt.txt", "tabellen"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession, root: str, name: str | None = None) -> str:
    return f"{root}/{spark.range(1).select(slug(F.lit(name or DEFAULT))).first()[0]}"


def create(spark: SparkSession, root: str, name: str | None = None) -> str:
    """The project's folder; made if it isn't there. Making it again changes nothing but the name's spelling."""
    path = folder(spark, root, name)
    fs, at = _at(spark, f"{path}/{TABLES}")
    fs.mkdirs(at)
    out = fs.create(_at(spark, f"{path}/{NAME}")[1], True)
    out.write(bytearray((name or DEFAULT).encode()))
    out.close()
    return path


def listing(spark: SparkSession, root: str) -> DataFrame:
    """folder, project: a project without a name's file is named as its folder; by folder. An empty root gets the default."""
    fs, at = _at(spark, root)
    found = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []
    if not found:
        create(spark, root)
        return listing(spark, root)
    dirs = spark.createDataFrame([(x,) for x in found], "folder string")
    named = [f"{root}/{x}/{NAME}" for x in found if fs.exists(_at(spark, f"{root}/{x}/{NAME}")[1])]
    if not named:
        return dirs.withColumn("project", F.col("folder")).orderBy("folder")
    names = spark.read.text(named, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("__f"), F.btrim("value").alias("project"))
    names = names.withColumn("folder", F.expr("url_decode(replace(__f, '+', '%2B'))")).drop("__f")
    return dirs.join(names, "folder", "left").select("folder", F.coalesce("project", "folder").alias("project")).orderBy("folder")


def remove(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there was such a project; it goes with its tables."""
    fs, at = _at(spark, folder(spark, root, name))
    return fs.delete(at, True)


def clear(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there is such a project; its tables go, it stays."""
    path = folder(spark, root, name)
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return False
    tables = _at(spark, f"{path}/{TABLES}")[1]
    fs.delete(tables, True)
    fs.mkdirs(tables)
    return True


def write(df: DataFrame, project: str, table: str, buckets: int = BUCKETS) -> None:
    """df (doc_id and more) as a project's table."""
    replace(df.withColumn("bucket", bucket(buckets)), f"{project}/{TABLES}/{table}")


def read(spark: SparkSession, project: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{project}/{TABLES}/{table}").drop("bucket")


def tables(spark: SparkSession, project: str) -> list[str]:
    fs, at = _at(spark, f"{project}/{TABLES}")
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete_documents(spark: SparkSession, project: str, gone: DataFrame, buckets: int = BUCKETS) -> None:
    """Documents (doc_id) go out of every table of a project. Only their buckets are read and written; ids may be many.
    Null ids and ids that aren't there change nothing."""
    ids = written(gone.where("doc_id is not null").select("doc_id").distinct().withColumn("bucket", bucket(buckets)), "gone")
    hit = sorted(r[0] for r in ids.select("bucket").distinct().collect())  # BUCKETS at most
    for name in tables(spark, project) if hit else []:
        path = f"{project}/{TABLES}/{name}"
        old = spark.read.parquet(path).where(F.col("bucket").isin(hit))
        had = {r[0] for r in old.select("bucket").distinct().collect()}
        rest = written(without(old, ids, "doc_id"), "rest")
        left = {r[0] for r in rest.select("bucket").distinct().collect()}
        replace(rest, path)
        for b in had - left:
            drop(spark, f"{path}/bucket={b}")
