"""Answers of models and texts of readers as tables; the calls themselves are other programs'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import footnote_markers, normalize, parse_count, present, natural_number
from ..operators import rows as rules
from .files import tolerant_json

# The kinds that an answer may name, and the words that tell a read page's kind.
KINDS = {"funktionsliste": "funktionsliste", "regelschema": "regelschema", "schema": "regelschema", "sonstiges": "sonstiges"}
SCHEMA_WORDS = ("regelschema", "prinzipschaltbild", "anlagenschema", "strangschema", "funktionsschema", "schaltplan")
TABLE_WORDS = ("summe funktionen", "funktionsliste", "datenpunktliste", "abschnitt", "verarbeitungsfunktionen", "anwendungsfunktionen", "benennung")
FIELDS = ("projekt", "auftraggeber", "anlage", "gewerk", "planersteller", "protokoll", "planstand", "blatt_nr", "blatt_von", "datum", "vdi_blatt", "informationsschwerpunkt", "automationsschwerpunkt")
ROWS = "zeilen array<struct<zeile_nr:string,bas:string,klartext:string,qualifikation:string,bemerkung:string,summenzeile:boolean,werte:map<string,string>>>"
COLUMNS = "spalten array<struct<index:int,gruppe:string,untergruppe:string,bezeichnung:string,abschnitt:string,spalte_nr:string,fussnoten:array<string>>>"


def replayed(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """asked (purpose, n) with the recorded answer of `purpose#n`, else of `purpose`, else {}. recorded: name, answer."""
    a = recorded.select(F.col("name").alias("__exact"), F.col("answer").alias("__a"))
    b = recorded.select(F.col("name").alias("__any"), F.col("answer").alias("__b"))
    name = F.concat("purpose", F.lit("#"), F.col("n").cast("string"))
    out = asked.join(F.broadcast(a), name == F.col("__exact"), "left").join(F.broadcast(b), F.col("purpose") == F.col("__any"), "left")
    return out.select("purpose", "n", F.coalesce("__a", "__b", F.lit("{}")).alias("answer"))


def page_answer(answer: Column) -> Column:
    """struct(kind, confidence, reason) of an answer about a page."""
    x = tolerant_json(answer, "typ string, konfidenz string, begruendung string")
    kind = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])[F.replace(normalize(x["typ"]), F.lit(" "), F.lit(""))]
    return F.struct(F.coalesce(kind, F.lit("sonstiges")).alias("kind"), F.coalesce(x["konfidenz"].try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(x["begruendung"], F.lit("")).alias("reason"))


def read_page_kind(text: Column, most: int = 3) -> Column:
    """struct(kind, confidence, words) of a page by the text that a reader found on it."""
    n = normalize(text)
    hits = F.filter(F.array(*map(F.lit, TABLE_WORDS)), lambda w: F.contains(n, w))
    of = lambda kind, c, words="": F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"), (F.lit(words) if isinstance(words, str) else words).alias("words"))
    return (
        F.when(F.length(n) < 40, of("regelschema", 0.6))
        .when(n.rlike("(" + "|".join(SCHEMA_WORDS) + ")"), of("regelschema", 0.85))
        .when(F.size(hits) > 0, of("funktionsliste", 0.8, F.array_join(F.slice(hits, 1, most), ", ")))
        .otherwise(of("sonstiges", 0.5))
    )


def answered_columns(answers: DataFrame) -> DataFrame:
    """doc_id, page_index, column_index and the names of the columns that an answer lists."""
    x = tolerant_json(F.col("answer"), COLUMNS)
    each = answers.select("doc_id", "page_index", F.posexplode(x["spalten"]).alias("n", "s"))
    text = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    label = text(F.col("s.bezeichnung"))
    marks = F.when(F.size("s.fussnoten") > 0, F.col("s.fussnoten")).otherwise(footnote_markers(label))
    return each.select("doc_id", "page_index", F.coalesce("s.index", "n").alias("column_index"), text(F.col("s.gruppe")).alias("group_name"), text(F.col("s.untergruppe")).alias("subgroup"), label.alias("label"), text(F.col("s.abschnitt")).alias("section"), text(F.col("s.spalte_nr")).alias("column_no"), marks.alias("footnote_markers"))


def answered_rows(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) of answers (doc_id, page_index, n_columns, answer). Values outside the columns and blank ones are no
    cells; rows without label, address and cells go; a row that the model calls a sum is one. A row counts its own cells,
    so each answer is parsed once and nothing is joined."""
    x = tolerant_json(F.col("answer"), ROWS)
    each = answers.select("doc_id", "page_index", "n_columns", F.posexplode(x["zeilen"]).alias("row_seq", "z"))
    values = F.coalesce("z.werte", F.create_map().cast("map<string,string>"))
    index = lambda k: natural_number(F.btrim(k))
    own = F.map_filter(values, lambda k, v: (F.btrim(v) != "") & (index(k) < F.greatest("n_columns", F.lit(1))))
    cells = each.select("doc_id", "page_index", "row_seq", F.explode(own).alias("k", "v"))
    cells = cells.select("doc_id", "page_index", "row_seq", index(F.col("k")).alias("column_index"), F.btrim("v").alias("raw_value")).withColumn("count", parse_count(F.col("raw_value")))
    cells = cells.withColumn("note", F.when(F.col("count").isNull(), F.col("raw_value")).otherwise(""))
    text = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    rows = each.select("doc_id", "page_index", "row_seq", text("z.zeile_nr").alias("row_no"), text("z.bas").alias("bas"), text("z.klartext").alias("label"), text("z.qualifikation").alias("qualifier"), text("z.bemerkung").alias("remark"), own.alias("__own"), F.coalesce("z.summenzeile", F.lit(False)).alias("__sum"))
    full = F.exists(F.map_values("__own"), lambda v: parse_count(F.btrim(v)).isNotNull())
    rows = rows.select("*", F.size("__own").cast("long").alias("n_cells"), full.alias("has_values"), rules.row_kind(F.col("label"), full).alias("__kind")).where("label <> '' or n_cells > 0 or bas <> ''")
    said = F.col("__sum") & (F.col("__kind") == "daten")
    rows = rows.withColumn("kind", F.when(said, "summe").otherwise(F.col("__kind"))).withColumn("reason", F.when(said, "Vom Modell als Summenzeile gemeldet").otherwise(rules.reason(F.col("__kind"))))
    return rows.drop("__sum", "__own", "__kind"), cells


def answered_fields(answers: DataFrame) -> DataFrame:
    """doc_id, page_index, field, value of what an answer says about the sheet."""
    x = tolerant_json(F.col("answer"), ", ".join(f"{f} string" for f in FIELDS))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.btrim(x[f]).alias("value")) for f in FIELDS]))
    return answers.select("doc_id", "page_index", pairs.alias("p")).select("doc_id", "page_index", "p.field", "p.value").where(present(F.col("value")).isNotNull())


def warnings_of(text: Column) -> Column:
    """The list that a JSON text holds, an empty one if it's no such text."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def as_json(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, json: each document with its rows, times as ISO texts."""
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_seq", *[c for c in rows.columns if c not in ("doc_id", "row_seq")]))).alias("rows"))
    return documents.join(own, "doc_id", "left").select("doc_id", F.to_json(F.struct(*documents.columns, "rows")).alias("json"))
