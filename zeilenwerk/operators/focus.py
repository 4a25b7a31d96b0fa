"""Which focus (group code) a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_label, parse_focus, present


def own_focus(label: Column, *others: Column) -> Column:
    """The focus that a row names: with label in its text, without in its other fields."""
    bare = lambda c: F.when(parse_focus(c).isNotNull(), F.struct(parse_focus(c)["code"].alias("code"), F.lit("").alias("label")))
    return F.coalesce(parse_focus(label), *map(bare, others))


def of_metadata(asp: Column, isp: Column, system: Column, trade: Column) -> Column:
    """The focus that a sheet's fields name: the fields of their kind (a number is enough there), then the system, then
    the trade. A focus without a name takes the system's."""
    kind = lambda c, k: F.coalesce(parse_focus(c), parse_focus(F.concat(F.lit(k + " "), c)))
    found = F.coalesce(kind(present(asp), "ASP"), kind(present(isp), "ISP"), parse_focus(present(system)), parse_focus(present(trade)))
    name = F.coalesce(present(found["label"]), clean_label(system), F.lit(""))
    return F.when(found.isNotNull(), F.struct(found["code"].alias("code"), name.alias("label")))


def assign(rows: DataFrame, header: Column | None = None, default: Column | None = None) -> DataFrame:
    """rows (doc_id, page_index, row_seq, kind, label, own: struct, has_values) with focus and focus_label.

    A code without a label takes the text of one of the next two rows. A code holds until the next one, a sum row or
    the page's end; then the page's default holds: its header's focus, or the only code of the page, or the
    document's default. Labels that a code has anywhere in the document fill those that are missing."""
    none = F.lit(None).cast("struct<code:string,label:string>")
    header, default = (none if x is None else x for x in (header, default))
    doc = W.partitionBy("doc_id").orderBy("page_index", "row_seq")
    at = lambda i: F.struct(F.lead("label", i).over(doc).alias("label"), F.lead("own", i).over(doc).isNotNull().alias("named"), F.lead("has_values", i).over(doc).alias("full"))
    rows = rows.withColumn("__1", at(1)).withColumn("__2", at(2))
    open_1, open_2 = ~(F.col("__1.named") | F.col("__1.full")), ~(F.col("__2.named") | F.col("__2.full"))
    found = F.when(open_1, F.coalesce(present(F.btrim("__1.label")), F.when(open_2, present(F.btrim("__2.label")))))
    rows = rows.withColumn("__own", F.when(F.col("own").isNotNull(), F.struct(F.col("own.code").alias("code"), F.coalesce(present(F.col("own.label")), found, F.lit("")).alias("label"))))
    page = W.partitionBy("doc_id", "page_index")
    whole = page.orderBy("row_seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    only = F.when(F.size(F.collect_set("__own.code").over(page)) == 1, F.first("__own", True).over(whole))
    rows = rows.withColumn("__default", F.coalesce(header, only, default))
    reset = F.col("kind").isin("summe", "uebertrag")
    event = F.when(reset, F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("label"))).otherwise(F.col("__own"))
    rows = rows.withColumn("__event", event)
    held = F.last("__event", True).over(page.orderBy("row_seq").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__held", F.when(held["code"].isNotNull(), held).otherwise(F.col("__default")))
    label = F.coalesce(present(F.col("__held.label")), F.first(present(F.col("__held.label")), True).over(W.partitionBy("doc_id", F.col("__held.code")).orderBy("page_index", "row_seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(""))
    out = rows.withColumn("focus", F.coalesce("__held.code", F.lit(""))).withColumn("focus_label", F.when(F.col("__held.code").isNotNull(), label).otherwise(""))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
