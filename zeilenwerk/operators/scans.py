"""A table's head on a scanned page: its columns are a profile's, placed at the centres that were measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import PAGE


def header_grid(centres: DataFrame, profile_columns: DataFrame) -> DataFrame:
    """centres (doc_id, page_index, profile_id, x) and profile_columns (profile_id, ordinal from 0, address, label,
    group_name, subgroup, abbrev) -> the page's columns from left to right: column_index, x_center, section, column_no and
    the profile's texts. Centres or columns that the other side lacks go. A section is the address up to its last dot,
    the whole address where it has none."""
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("x")) - 1
    at = centres.withColumn("ordinal", place)
    section = F.when(F.col("address").contains("."), F.regexp_replace("address", r"\.[^.]*$", "")).otherwise(F.lit(""))
    section = F.when(section == "", F.col("address")).otherwise(section)
    both = at.join(profile_columns, ["profile_id", "ordinal"])
    texts = ["group_name", "subgroup", "label", "abbrev"]
    return both.select(*PAGE, "profile_id", F.col("ordinal").alias("column_index"), F.col("x").alias("x_center"), section.alias("section"), F.substring_index("address", ".", -1).alias("column_no"), *texts)


def edges(centres: DataFrame) -> DataFrame:
    """doc_id, page_index, note_left: remarks begin a column's mean width right of the last column's centre."""
    n = F.count(F.lit(1))
    width = (F.max("x") - F.min("x")) / F.greatest(F.lit(1), n - 1)
    return centres.groupBy(*PAGE).agg((F.max("x") + width).alias("note_left"))


def by_lines_or_words(pages: DataFrame, by_lines: DataFrame, by_words: DataFrame, least: int = 20) -> DataFrame:
    """Rows of pages (doc_id, page_index, n_lines, n_words): those found between level lines where a page has some; else
    those found from its words, if it has `least` of them."""
    lined = pages.where("n_lines > 0").select(*PAGE)
    loose = pages.where(~F.coalesce(F.col("n_lines") > 0, F.lit(False)) & (F.col("n_words") >= least)).select(*PAGE)
    return by_lines.join(lined, PAGE, "left_semi").unionByName(by_words.join(loose, PAGE, "left_semi"))
