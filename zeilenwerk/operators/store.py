"""Keeping documents: idempotent storage by content hash, merges and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import present


def upsert(old: DataFrame, new: DataFrame, key: str, keep_existing: bool = False) -> DataFrame:
    """old with new's documents in place of those with the same key; with keep_existing, old ones stay. An empty key
    never matches."""
    keyed = lambda df: df.where(present(F.col(key).cast("string")).isNotNull()).select(key)
    if keep_existing:
        return old.unionByName(new.join(keyed(old), key, "left_anti"))
    return old.join(keyed(new), key, "left_anti").unionByName(new)


def write_documents(df: DataFrame, path: str, keys: tuple[str, ...] = ("project", "file_hash")) -> None:
    """Only the partitions of the documents at hand are replaced: importing again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def richest(df: DataFrame, keys: list[str], n_cells: str, tie: list[str]) -> DataFrame:
    """Of rows that say the same, the one with the most cells, the first among equals."""
    order = W.partitionBy(*keys).orderBy(F.col(n_cells).desc(), *tie)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_present(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each field's first value that isn't empty, in order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(F.col(f), F.when(present(F.col(f).cast("string")).isNotNull(), at)).alias(f) for f in fields])


def overlay(stored: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """Stored values under edited ones."""
    e = edits.select(key, F.col(value).alias("__new"))
    return stored.join(e, key, "full_outer").select(key, F.coalesce("__new", value).alias(value))


def migrated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that older tables lack, at their defaults."""
    for name, default in columns.items():
        df = df.withColumn(name, F.coalesce(name, default) if name in df.columns else default)
    return df


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows of documents that go; every table of a document is treated so."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unit prices (spalte_key, profil, label, preis, at): the latest price of a key; where it comes without a name or a
    profile, the old ones stay. By key."""
    at = F.struct("at", "preis")
    kept = lambda c: F.coalesce(F.max_by(c, F.when(present(F.col(c)).isNotNull(), at)), F.lit("")).alias(c)
    both = old.unionByName(new)
    return both.groupBy("spalte_key").agg(kept("profil"), kept("label"), F.max_by("preis", at).alias("preis"), F.max("at").alias("at")).orderBy("spalte_key")


def price_literals(texts: DataFrame) -> DataFrame:
    """texts (text: KEY=WERT, decimal comma or point) -> spalte_key, preis; others go."""
    key, value = F.btrim(F.substring_index("text", "=", 1)), F.btrim(F.regexp_extract("text", "=(.*)$", 1))
    return texts.where(F.col("text").contains("=")).select(key.alias("spalte_key"), F.replace(value, F.lit(","), F.lit(".")).try_cast("double").alias("preis")).where("preis is not null")


def write_prices(prices: DataFrame, path: str) -> None:
    """A price list as text with semicolons and a head, one file a task."""
    prices.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def projects(stored: DataFrame) -> DataFrame:
    """The projects of a store by name, with their documents and latest import."""
    return stored.groupBy("project").agg(F.count_distinct("file_hash").alias("dokumente"), F.max("importiert_am").alias("stand")).orderBy("project")
