"""Reported against computed sums, in three scopes that differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import exact
from .rows import TOLERANCE


def with_cells(rows: DataFrame, cells: DataFrame | None, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each cell that has a count: doc_id, row_seq, page_index, kind, more, column_index, count. Where cells is
    None, rows hold them (an array), so nothing has to be joined to them."""
    own = ["doc_id", "row_seq", "page_index", "kind", *more]
    if cells is None:
        return rows.select(*own, F.inline("cells")).select(*own, "column_index", "count").where("count is not null")
    return cells.select("doc_id", "row_seq", "column_index", "count").join(rows.select(*own), ["doc_id", "row_seq"]).where("count is not null")


def values_of(rows: DataFrame, cells: DataFrame | None) -> DataFrame:
    """rows with value, the sum of their counts; those without a count go."""
    if cells is None:
        counts = F.transform(F.filter("cells", lambda c: c["count"].isNotNull()), lambda c: c["count"].cast("decimal(28,6)"))
        total = F.aggregate(counts, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)")).cast("double")
        return rows.withColumn("value", F.when(F.size(counts) > 0, total)).where(F.exists("cells", lambda c: c["count"].isNotNull())).drop("cells")
    value = cells.where("count is not null").groupBy("doc_id", "row_seq").agg(exact(F.col("count")).alias("value"))
    return rows.join(value, ["doc_id", "row_seq"])


def _sums(rows: DataFrame, cells: DataFrame | None, keys: list[str]) -> DataFrame:
    """own (data), carry and reported sums by keys and column; null where there is no such cell."""
    facts = with_cells(rows, cells)
    of = lambda kind: exact(F.when(F.col("kind") == kind, F.col("count")))
    return facts.groupBy(*keys, "column_index").agg(of("daten").alias("own"), of("uebertrag").alias("carry"), of("summe").alias("reported"))


def page_checks(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """By page, carried sums added to its own. Pages without own or without reported sums are left out; a column that
    isn't reported matches."""
    from pyspark.sql import Window as W

    page = W.partitionBy("doc_id", "page_index")
    s = _sums(rows, cells, ["doc_id", "page_index"])
    s = s.withColumn("__ok", F.bool_or(F.col("own").isNotNull()).over(page) & F.bool_or(F.col("reported").isNotNull()).over(page)).where("__ok")
    computed = F.coalesce("own", F.lit(0.0)) + F.coalesce("carry", F.lit(0.0))
    s = s.withColumn("computed", F.round(computed, 2))
    return s.select("doc_id", "page_index", "column_index", "reported", "computed", (F.col("reported").isNull() | (F.abs(F.col("reported") - F.col("computed")) < TOLERANCE)).alias("matches"))


def page_findings(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """By page, without carried sums: reported columns that differ."""
    from pyspark.sql import Window as W

    page = W.partitionBy("doc_id", "page_index")
    s = _sums(rows, cells, ["doc_id", "page_index"])
    s = s.withColumn("__own", F.bool_or(F.col("own").isNotNull()).over(page)).where("__own and reported is not null")
    s = s.withColumn("own", F.coalesce("own", F.lit(0.0))).where(F.abs(F.col("reported") - F.col("own")) >= TOLERANCE)
    return s.select("doc_id", "page_index", "column_index", F.lit("abweichung").alias("art"), "reported", "own")


def excluded_findings(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Rows that don't count though they hold values; sum rows of pages where every reported column matches not."""
    # a page is fine if it has own and reported sums, and no reported column differs from its own sum
    differs = F.col("reported").isNotNull() & (F.abs(F.col("reported") - F.coalesce("own", F.lit(0.0))) >= TOLERANCE)
    pages = _sums(rows, cells, ["doc_id", "page_index"]).groupBy("doc_id", "page_index")
    pages = pages.agg(F.bool_or(F.col("own").isNotNull()).alias("__own"), F.bool_or(F.col("reported").isNotNull()).alias("__reported"), F.bool_or(differs).alias("__bad"))
    fine = pages.where("__own and __reported and not __bad").select("doc_id", "page_index", F.lit(True).alias("__fine"))
    out = values_of(rows.where("kind not in ('daten', 'leer')"), cells).join(fine, ["doc_id", "page_index"], "left")
    return out.where(~(F.coalesce("__fine", F.lit(False)) & (F.col("kind") == "summe"))).select("doc_id", "page_index", "row_seq", "kind", F.lit("ausgeschlossen").alias("art"), "value")


def verdict(reported: Column, own: Column) -> Column:
    return F.when(reported.isNull(), "nicht in der Liste ausgewiesen").when(F.abs(reported - own) < TOLERANCE, "stimmt überein").otherwise("ABWEICHUNG")


def audit(rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """By document and column, carried sums left out."""
    s = _sums(rows.withColumn("page_index", F.lit(0)), cells, ["doc_id"]).where("own is not null or reported is not null")
    own = F.coalesce("own", F.lit(0.0))
    return s.select("doc_id", "column_index", own.alias("own"), "reported", verdict(F.col("reported"), own).alias("verdict"))
