"""Tables of pages put together, with columns bound to a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_address, present
from .editing import display


def identity(columns: DataFrame) -> Column:
    """What makes a column the same on several pages: its key, else its address, else its names."""
    by_name = F.lower(display(F.col("address"), F.col("group_name"), F.col("subgroup"), F.col("label")))
    return F.coalesce(F.concat(F.lit("key:"), present(F.col("column_key"))), F.concat(F.lit("adr:"), present(F.col("address"))), F.concat(F.lit("lbl:"), by_name))


def merged_columns(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """columns (doc_id, page_index, column_index, column_key, address, group_name, subgroup, label) of pages ->
    (one row a column and document with its new dense index, in order of first sight, with the first label that isn't
    empty; doc_id, page_index, column_index, new_index). The number of columns of a document is small."""
    at = F.struct("page_index", "column_index")
    named = columns.withColumn("__id", identity(columns))
    first = F.min_by(F.struct("column_key", "address", "group_name", "subgroup", "label"), at)
    one = named.groupBy("doc_id", "__id").agg(F.min(at).alias("__at"), first.alias("__first"), F.min_by("label", F.when(present(F.col("label")).isNotNull(), at)).alias("__label"))
    one = one.withColumn("new_index", F.row_number().over(W.partitionBy("doc_id").orderBy("__at")) - 1)
    out = one.select("doc_id", F.col("new_index").alias("column_index"), "__first.column_key", "__first.address", "__first.group_name", "__first.subgroup", F.coalesce("__label", "__first.label").alias("label"))
    return out, named.join(one.select("doc_id", "__id", "new_index"), ["doc_id", "__id"]).select("doc_id", "page_index", "column_index", "new_index")


def merged_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells (doc_id, page_index, row_seq, column_index, ...) with the merged index; those of no known column go."""
    return cells.join(mapping, ["doc_id", "page_index", "column_index"]).withColumn("column_index", F.col("new_index")).drop("new_index")


def merged(columns: DataFrame, rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, rows, cells) of pages (doc_id, page_index, ...) as one table a document: columns as `merged_columns`, rows
    numbered through the pages. A document's rows are in one order; documents are many."""
    own, mapping = merged_columns(columns)
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", "row_seq")) - 1
    placed = rows.withColumn("new_seq", at)
    key = ["doc_id", "page_index", "row_seq"]
    moved = merged_cells(cells, mapping).join(placed.select(*key, "new_seq"), key)
    again = lambda df: df.withColumn("row_seq", F.col("new_seq")).drop("new_seq")
    return own, again(placed), again(moved)


def merged_footnotes(footnotes: DataFrame, known: DataFrame) -> DataFrame:
    """footnotes (doc_id, page_index, marker, text): the first of each marker, replaced by the catalogue's text where it
    has one (known: marker, text), which every document gets; by length of the marker, then marker."""
    first = footnotes.groupBy("doc_id", "marker").agg(F.min_by("text", "page_index").alias("text"))
    texts = known.where(present(F.col("text")).isNotNull()).select("marker", F.col("text").alias("__known"))
    every = footnotes.select("doc_id").distinct().join(F.broadcast(texts))  # a catalogue's footnotes, some ten rows
    out = first.join(every, ["doc_id", "marker"], "full_outer").select("doc_id", "marker", F.coalesce("__known", "text").alias("text"))
    return out.orderBy("doc_id", F.length("marker"), "marker")


def by_address(headers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """headers with the catalogue's key of the same normalised address (catalogue: column_key, address)."""
    known = catalogue.select(F.col("column_key").alias("__key"), normalize_address(F.col("address")).alias("__address")).where("__address <> ''")
    known = known.groupBy("__address").agg(F.min("__key").alias("__key"))
    return headers.join(F.broadcast(known), normalize_address(F.col("address")) == F.col("__address"), "left").withColumn("column_key", F.col("__key")).drop("__key", "__address")


def enriched(headers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What a header lacks is taken from the catalogue's column of its key."""
    fields = ("group_name", "subgroup", "abbrev", "label")
    known = catalogue.select("column_key", *[F.col(f).alias(f"__{f}") for f in fields], F.col("footnotes").alias("__footnotes"))
    out = headers.join(F.broadcast(known), "column_key", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(present(F.col(f)), f"__{f}", F.lit("")))
    out = out.withColumn("footnote_markers", F.when(F.size("footnote_markers") > 0, F.col("footnote_markers")).otherwise(F.coalesce("__footnotes", "footnote_markers")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def catalogue_address(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """keys (column_key) with the address that the catalogue of the highest priority gives; catalogue: profile_id,
    priority, column_key, address."""
    best = catalogue.groupBy("column_key").agg(F.min_by("address", F.struct(-F.col("priority"), "profile_id")).alias("address"))
    return keys.join(F.broadcast(best), "column_key", "left").fillna("", ["address"])


def block_profile(sizes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """sizes (doc_id, sizes: array<int>) with the profile whose sections have these sizes, the first by priority; else the
    only one with as many columns. catalogue: profile_id, priority, place, address."""
    section = F.regexp_extract("address", r"^(.*?)\.?[^.]*$", 1)
    order = W.partitionBy("profile_id").orderBy("place")
    new = F.coalesce((section != F.lag(section).over(order)).cast("int"), F.lit(1))
    runs = catalogue.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("profile_id", "priority", "__run").agg(F.count(F.lit(1)).cast("int").alias("n"))
    known = runs.groupBy("profile_id", "priority").agg(F.transform(F.array_sort(F.collect_list(F.struct("__run", "n"))), lambda x: x["n"]).alias("sizes"), F.sum("n").cast("int").alias("total"))
    exact = known.groupBy("sizes").agg(F.min_by("profile_id", F.struct(-F.col("priority"), "profile_id")).alias("__exact"))
    total = known.groupBy("total").agg(F.count(F.lit(1)).alias("k"), F.first("profile_id").alias("__total")).where("k = 1").drop("k")
    out = sizes.withColumn("total", F.aggregate("sizes", F.lit(0), lambda a, x: a + x.cast("int"))).join(F.broadcast(exact), "sizes", "left").join(F.broadcast(total), "total", "left")
    return out.select("doc_id", "sizes", F.coalesce("__exact", "__total").alias("profile_id"))
