"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark drop a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Off, joins of tables in equal buckets move no rows even where they have more keys than the buckets.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: Bytes of files that a bucket of a keyed table comes from, about, and buckets at most.
BUCKET, BUCKETS = 4 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. Where that is unset, a temporary
    folder on a single machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="zeilenwerk-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def buckets(df: DataFrame) -> int:
    """How many buckets a keyed table made of df should have: as many as the keyed table that it comes from, else more for
    larger files, so that a task's part stays small."""
    spark, files = df.sparkSession, df.inputFiles()
    known = re.search(r"-(\d+)b-[0-9a-f]{32}/", files[0]) if files else None
    if known:
        return int(known[1])
    size = spark.read.format("binaryFile").load(list(files)).agg({"length": "sum"}).first()[0] if files else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, (size or 0) // BUCKET))


def written(df: DataFrame, name: str, keys: list[str] | None = None, n: int = 0) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors lose nothing. What was shuffled
    for it isn't needed any more, so its files go at once.

    With keys the table is kept in n buckets of them (0: as df's source asks for): what groups by these keys and more, or
    joins such tables of as many buckets, moves no row again. It's never sent to all tasks: files of like rows are far
    smaller than the rows. CO_PARTITION stays off in the session, as plans are made when they run."""
    spark, schema = df.sparkSession, df.schema
    if keys:
        n = n or buckets(df)
        name = f"{name}-{n}b"
        spark.conf.set(CO_PARTITION, "false")
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        if not keys:
            df.write.parquet(path)
        else:
            table = "zeilenwerk_" + path.rsplit("-", 1)[1]
            df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.table(table).hint("merge") if keys else spark.read.schema(schema).parquet(path)
