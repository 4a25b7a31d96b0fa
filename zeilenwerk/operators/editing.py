"""The editable table of documents, and what an edited one changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_focus, present


def display(address: Column, group: Column, subgroup: Column, label: Column) -> Column:
    """Address and the names of a column that there are."""
    return F.concat_ws(" ", present(address), present(F.concat_ws(" / ", *map(present, (group, subgroup, label)))))


def row_label(klartext: Column, bas: Column, row_no: Column) -> Column:
    return F.coalesce(present(klartext), present(bas), F.concat(F.lit("Zeile "), F.coalesce(row_no, F.lit(""))))


def column_title(address: Column, index: Column, label: Column, key: Column, most: int = 60) -> Column:
    return F.substring(F.concat(F.coalesce(present(address), index.cast("string")), F.lit(" · "), F.coalesce(present(label), present(key), F.lit(""))), 1, most)


def focus_text(code: Column, label: Column) -> Column:
    return F.concat_ws(" ", present(code), present(label))


def focus_kind(code: Column) -> Column:
    return F.when(F.upper(code).startswith("ASP"), "ASP").when(F.upper(code).startswith("ISP"), "ISP").otherwise("")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'daten'").withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("row_seq")) - 1)


def edit_table(rows: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, position, row_no, schwerpunkt, datenpunkt, and values: a map from column titles to counts. Only data rows
    are shown; columns: column_index, adresse, label, spalte_key."""
    titles = columns.select("column_index", column_title(F.col("adresse"), F.col("column_index"), F.col("label"), F.col("spalte_key")).alias("title"))
    own = cells.where("count is not null").join(F.broadcast(titles), "column_index")
    values = own.groupBy("doc_id", "row_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "count")))).alias("values"))
    return _placed(rows).join(values, ["doc_id", "row_seq"], "left").select("doc_id", "position", "row_no", focus_text(F.col("focus"), F.col("focus_label")).alias("schwerpunkt"), "datenpunkt", "values")


def marked(edited: DataFrame) -> DataFrame:
    """Positions of the rows that are ticked for deletion."""
    return edited.where(F.coalesce("loeschen", F.lit(False))).select("doc_id", "position")


def written_back(edited: DataFrame, rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) after an edit: edited rows stand at their positions among the data rows. A focus that the text names
    is taken with its name; other text is the name of the focus that the row has; an empty text takes both away. Values
    that are null are no cells."""
    text = F.btrim(F.coalesce("schwerpunkt", F.lit("")))
    found = parse_focus(text)
    both = _placed(rows).select("doc_id", "row_seq", "position", "focus").join(edited.withColumnRenamed("row_no", "__no").withColumnRenamed("datenpunkt", "__dp"), ["doc_id", "position"])
    new = both.select("doc_id", "row_seq", F.coalesce("__no", F.lit("")).alias("row_no"), F.when(text == "", "").when(found.isNotNull(), found["code"]).otherwise(F.col("focus")).alias("focus"), F.when(text == "", "").when(found.isNotNull(), found["label"]).otherwise(text).alias("focus_label"), F.coalesce("__dp", F.lit("")).alias("datenpunkt"))
    titles = columns.select("column_index", column_title(F.col("adresse"), F.col("column_index"), F.col("label"), F.col("spalte_key")).alias("title"))
    cells = both.select("doc_id", "row_seq", F.explode("values").alias("title", "count")).where("count is not null").join(F.broadcast(titles), "title")
    return new, cells.select("doc_id", "row_seq", "column_index", F.col("count").cast("string").alias("raw_value"), "count")


def cleaned(df: DataFrame) -> DataFrame:
    """A frame for a sheet: times without fractions of seconds, lists joined, nulls of texts ''."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        c = F.date_trunc("second", c) if kind.startswith("timestamp") else F.concat_ws(", ", c) if kind == "array<string>" else F.coalesce(c, F.lit("")) if kind == "string" else c
        out.append(c.alias(name))
    return df.select(*out)


def german_time(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy HH:mm")


def midpoints(edges: Column) -> Column:
    """Centres between edges that follow each other."""
    n = F.size(edges)
    return F.when(n > 1, F.zip_with(F.slice(edges, F.lit(1), n - 1), F.slice(edges, F.lit(2), n - 1), lambda a, b: (a + b) / 2)).otherwise(F.array().cast("array<double>"))
