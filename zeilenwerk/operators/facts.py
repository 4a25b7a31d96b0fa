"""The central relation of cell facts and what is summed over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import UNASSIGNED, present

DIMENSIONS = ("projekt", "anlage", "gewerk", "fassung", "schwerpunkt", "gruppe", "spalte_key", "profil")


def exact(x: Column) -> Column:
    """Sums of money and counts are taken as decimals of six places, so that they don't depend on the order of rows."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def _relation(facts: DataFrame, documents: DataFrame, columns: DataFrame) -> DataFrame:
    kept = columns.where(~F.col("is_note"))
    facts = facts.join(documents, "doc_id").join(F.broadcast(kept), "column_index")  # a catalogue's columns, some fifty rows
    return facts.select(
        "doc_id", "datei", "fassung", "profil", F.coalesce(present(F.col("projekt")), F.col("auftraggeber")).alias("projekt"), "auftraggeber", "anlage",
        F.coalesce(present(F.col("focus")), F.lit(UNASSIGNED)).alias("schwerpunkt"), F.coalesce("focus_label", F.lit("")).alias("schwerpunkt_bezeichnung"),
        "gewerk", "planersteller", "blatt_nr", (F.col("page_index") + 1).alias("seite"), "row_seq", "row_no", "datenpunkt", "bas", "qualifier", "remark",
        "adresse", "spalte_key", "gruppe", "untergruppe", "label", F.coalesce("count", F.lit(0.0)).alias("wert"), "raw_value", "note", "importiert_am",
    )


def raw(documents: DataFrame, rows: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """A record for each cell of a data row outside note columns. columns is a catalogue (column_index, ...)."""
    return _relation(cells.join(rows.where("kind = 'daten'"), ["doc_id", "row_seq"]), documents, columns)


def raw_of_rows(documents: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The same of rows that hold their cells (an array), as a stored list does: nothing has to be joined to them."""
    data = rows.where("kind = 'daten'")
    return _relation(data.select(*[c for c in data.columns if c != "cells"], F.inline("cells")), documents, columns)


def column_summary(facts: DataFrame) -> DataFrame:
    """Columns of equal key and unlike names are kept apart: lists that differ shall be seen."""
    return facts.groupBy("profil", "adresse", "spalte_key", "gruppe", "untergruppe", "label").agg(exact(F.col("wert")).alias("menge"), F.count_distinct("doc_id").alias("dokumente"), F.count("datenpunkt").alias("n_cells"))


def by_dimension(facts: DataFrame, dimension: str) -> DataFrame:
    """Quantity, rows and documents by a dimension, the largest quantity first, then by name; no rows for one that doesn't
    exist. Rows are summed up first."""
    if dimension not in facts.columns:
        return facts.sparkSession.createDataFrame([], f"{dimension} string, menge double, n_rows bigint, dokumente bigint")
    one = facts.groupBy(dimension, "doc_id", "row_seq").agg(F.sum(F.col("wert").cast("decimal(28,6)")).alias("wert"))
    by_doc = one.groupBy(dimension, "doc_id").agg(F.sum("wert").alias("wert"), F.count(F.lit(1)).alias("n"))
    out = by_doc.groupBy(dimension).agg(F.sum("wert").cast("double").alias("menge"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("dokumente"))
    return out.orderBy(F.desc("menge"), dimension)


def group_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fassung", "gruppe").agg(exact(F.col("wert")).alias("menge"))


def focus_summary(facts: DataFrame) -> DataFrame:
    """By focus and its name; lists that name a focus differently are kept apart. Rows are summed up before the foci, so
    that no distinct count expands the cells."""
    one = facts.groupBy("schwerpunkt", "schwerpunkt_bezeichnung", "doc_id", "row_seq").agg(F.first("datei").alias("datei"), F.sum(F.col("wert").cast("decimal(28,6)")).alias("wert"))
    by_doc = one.groupBy("schwerpunkt", "schwerpunkt_bezeichnung", "doc_id").agg(F.first("datei").alias("datei"), F.count(F.lit(1)).alias("n"), F.sum("wert").alias("wert"))
    out = by_doc.groupBy("schwerpunkt", F.col("schwerpunkt_bezeichnung").alias("bezeichnung")).agg(F.sum("n").alias("n_rows"), F.sum("wert").cast("double").alias("menge"), F.count(F.lit(1)).alias("dokumente"), F.array_join(F.sort_array(F.collect_set("datei")), ", ").alias("dateien"))
    return out.withColumn("art", F.when(F.col("schwerpunkt").startswith("ASP"), "ASP").when(F.col("schwerpunkt").startswith("ISP"), "ISP").otherwise(""))


def pivot_margins(facts: DataFrame, keys: list[str], pivot: str, values: list[str]) -> DataFrame:
    """Sums by keys and, in a row of `Gesamt`, over all; one column a value of pivot and one for the whole."""
    sums = [F.coalesce(exact(F.when(F.col(pivot) == v, F.col("wert"))), F.lit(0.0)).alias(v) for v in values]
    sets = facts.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*sums, exact(F.col("wert")).alias("Gesamt"), F.grouping_id().alias("__all"))
    return sets.select(*[F.when(F.col("__all") > 0, "Gesamt").otherwise(F.col(k)).alias(k) for k in keys], *values, "Gesamt")


def matrix(facts: DataFrame, keys: list[str], values: list[str], every: DataFrame | None = None) -> DataFrame:
    """One row for each of keys and one column for each column key; `every` holds keys that stay without facts."""
    out = facts.groupBy(*keys).agg(*[F.coalesce(exact(F.when(F.col("spalte_key") == v, F.col("wert"))), F.lit(0.0)).alias(v) for v in values], F.count_distinct("row_seq").alias("n_rows"))
    return out if every is None else every.join(out, keys, "left").fillna(0.0, values).fillna(0, ["n_rows"])


def layout(rows: DataFrame, cells: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each countable row, one column for each key (the last cell wins). Notes: see reports.remarks."""
    c = cells.join(columns, "column_index")
    wide = [F.max_by(F.when(F.col("spalte_key") == k, F.col("count")), F.when(F.col("spalte_key") == k, F.col("column_index"))).alias(k) for k in keys]
    out = c.groupBy("doc_id", "row_seq").agg(*wide, F.bool_or(F.col("count").isNotNull()).alias("__full"))
    return rows.where("kind = 'daten'").join(out.where("__full").drop("__full"), ["doc_id", "row_seq"])


def with_cost(summary: DataFrame, prices: DataFrame) -> DataFrame:
    priced = summary.join(prices, "spalte_key", "left").withColumn("preis", F.coalesce("preis", F.lit(0.0)))
    return priced.withColumn("kosten", F.round(F.col("menge") * F.col("preis"), 2))


def price_template(columns: DataFrame, prices: DataFrame, summary: DataFrame) -> DataFrame:
    """Every column of the catalogue with its price and quantity, 0 where there is none."""
    return columns.select("spalte_key", "adresse", "gruppe").join(prices, "spalte_key", "left").join(summary.select("spalte_key", "menge"), "spalte_key", "left").fillna(0.0, ["preis", "menge"])


def kpis(facts: DataFrame) -> DataFrame:
    """Documents and rows are counted within each document first, the few names by themselves."""
    by_doc = facts.groupBy("doc_id").agg(F.count_distinct("row_seq").alias("n"), F.sum(F.col("wert").cast("decimal(28,6)")).alias("wert"))
    sums = by_doc.agg(F.count("doc_id").alias("dokumente"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("n_rows"), F.sum("wert").cast("double").alias("menge"))
    names = facts.select(F.when(F.col("schwerpunkt") != UNASSIGNED, F.col("schwerpunkt")).alias("s"), "spalte_key").distinct()
    return sums.crossJoin(names.agg(F.count_distinct("s").alias("schwerpunkte"), F.count_distinct("spalte_key").alias("spalten")))


def overview(documents: DataFrame, rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Per document: pages, countable rows, quantity of data rows, excluded rows by kind, foci in document order.
    Each part is summed by itself before it joins, so nothing fans out. sums: doc_id, row_seq, value."""
    r = rows.join(sums, ["doc_id", "row_seq"], "left")
    data = F.col("kind") == "daten"
    main = r.groupBy("doc_id").agg(F.count_distinct("page_index").alias("seiten"), F.count_if(data & F.col("value").isNotNull()).alias("n_countable"), F.coalesce(exact(F.when(data, F.col("value"))), F.lit(0.0)).alias("menge"))
    kinds = rows.where(~data).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "kind", "n"))), ", ").alias("ausgeschlossen"))
    foci = rows.where(data & present(F.col("focus")).isNotNull()).groupBy("doc_id", "focus").agg(F.min("row_seq").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "focus"))).alias("f")).select("doc_id", F.array_join("f.focus", ", ").alias("schwerpunkte"))
    out = documents.select("doc_id", "projekt", "anlage").join(main, "doc_id", "left").join(kinds, "doc_id", "left").join(foci, "doc_id", "left")
    return out.fillna(0, ["seiten", "n_countable"]).fillna(0.0, ["menge"]).fillna("", ["ausgeschlossen", "schwerpunkte"])


def focus_split(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Foci of each document in document order, the unassigned last."""
    r = rows.where("kind = 'daten'").join(sums, ["doc_id", "row_seq"]).withColumn("focus", F.coalesce(present(F.col("focus")), F.lit(UNASSIGNED)))
    out = r.groupBy("doc_id", "focus").agg(F.count(F.lit(1)).alias("n_rows"), exact(F.col("value")).alias("menge"), F.min("row_seq").alias("first"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy((F.col("focus") == UNASSIGNED).cast("int"), "first"))
    return out.withColumn("place", place).drop("first")
