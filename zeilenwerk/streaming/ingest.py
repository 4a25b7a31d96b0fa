"""Importing documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import write_documents
from ..sources.files import SUPPORTED


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, project: str, extract: Callable[[DataFrame], DataFrame]):
    """A query that stores what extract() makes of each new file, once a content: files of a hash that is stored
    already replace their own partition."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)

    def store(batch: DataFrame, _: int) -> None:
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        new = batch.withColumn("suffix", suffix).where(suffix.isin(*SUPPORTED)).withColumn("file_hash", F.sha2("content", 256)).dropDuplicates(["file_hash"])
        # no file, no row, and dynamic overwriting leaves all partitions as they are
        write_documents(extract(new).withColumn("project", F.lit(project)), out)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events no more than `gap` apart, on a stream or a table."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
