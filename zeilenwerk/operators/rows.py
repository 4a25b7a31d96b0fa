"""Which rows count: kinds of rows, sums without a label, the end of the table, rows taken out by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize

# The words that name a row's kind, in the order in which they are tried.
CARRY = ("uebertrag", "ubertrag", "vortrag", "uebertrag von", "uebertrag auf", "seitensumme", "seitenuebertrag", "zwischenuebertrag")
SUM = ("summe", "summen", "zwischensumme", "gesamtsumme", "endsumme", "summe funktionen", "anzahl funktionen", "total", "gesamt")
FOOTER = (
    "ausgabedatum", "planersteller", "informationsschwerpunkt", "geprueft", "auftraggeber", "planstand", "blatt nr", "msr zeichnung nr", "zeichnungs nr",
    "datenkommunikationsprotokoll", "aenderungsindex", "index", "revision", "rev", "bearbeiter", "erstellt", "freigabe", "massstab", "plannummer",
    "anmerkung", "definition der funktionen", "bibbs", "legende",
)
HEADER = (
    "benennung", "datenpunkt", "benutzeradresse", "zeile nr", "abschnitt", "spalte", "bemerkung", "gewerk", "anlage", "funktionsliste",
    "ein ausgabefunktionen", "verarbeitungsfunktionen", "anwendungsfunktionen", "managementfunktionen", "bedienfunktionen", "b a funktionen",
)
# Why a row doesn't count.
REASONS = {
    "summe": "Summenzeile - Werte sind bereits in den Einzelzeilen enthalten",
    "uebertrag": "Uebertragszeile - Werte stammen von einem anderen Blatt",
    "fussbereich": "Zeile des Kopf-/Fussbereichs, kein Datenpunkt",
    "kopf": "Wiederholte Kopfzeile",
    "leer": "Leere Zeile",
}
FITS = "Summenzeile ohne Beschriftung erkannt: die Werte entsprechen spaltenweise der Summe der Zeilen darueber"
LAST = "Unbeschriftete Schlusszeile - als Summenzeile gewertet, die Werte gehen jedoch nicht auf (siehe Summenpruefung)"
TOLERANCE = 1e-6


def row_kind(label: Column, has_values: Column) -> Column:
    # as an argument the normal form is made once, not for each branch
    return F.transform(F.array(normalize(label)), lambda n: kind_of_name(n, label, has_values))[0]


def kind_of_name(n: Column, label: Column, has_values: Column) -> Column:
    """The kind of a row whose label's normal form is n."""
    starts = lambda words: n.rlike("^(" + "|".join(words) + ")")
    return (
        F.when(n == "", F.when(has_values, "daten").otherwise("leer"))
        .when(n.rlike("(^| )(" + "|".join(CARRY) + ")"), "uebertrag")
        .when(starts(SUM), "summe")
        .when(starts(FOOTER) | label.rlike(r"^\s*\d{4,5}\s+[A-Za-zÄÖÜäöüß]"), "fussbereich")
        .when(n.isin(*HEADER), "kopf")
        .otherwise("daten")
    )


def reason(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[kind], F.lit(""))


def cut_after_footer(rows: DataFrame, keys: list[str], seq: str, kind: str = "kind") -> DataFrame:
    """Rows before the first footer or header row, without empty ones at the end."""
    w = W.partitionBy(*keys).orderBy(seq)
    stop = F.max(F.col(kind).isin("fussbereich", "kopf").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rest = rows.withColumn("__stop", stop).where("__stop = 0")
    back = W.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(W.unboundedPreceding, 0)
    return rest.withColumn("__full", F.max((F.col(kind) != "leer").cast("int")).over(back)).where("__full = 1").drop("__stop", "__full")


def is_footer(label: Column) -> Column:
    return row_kind(label, F.lit(False)) == "fussbereich"


def mark_unlabelled_sums(rows: DataFrame, keys: list[str], seq: str = "row_seq", bas: str | None = None) -> DataFrame:
    """rows (keys, seq, kind, label, values: map<int,double>) with a kind of `summe` and a reason where a data row
    without a label (and without an address, column `bas`) is a sum. It is one if it has, in two columns or more, the
    sums of the data rows since the last sum in all columns where these aren't 0; and if it's the page's last row with
    values and two data rows or more stand above it, whatever its values are. Null values count as none.

    One state machine over each page's rows; a page is bounded, a document isn't."""
    none = F.create_map().cast("map<int,double>")
    bare = normalize(F.col("label")) == ""
    bare = bare & (normalize(F.col(bas)) == "") if bas else bare
    held = F.map_filter(F.coalesce("values", none), lambda k, v: v.isNotNull())
    own = F.struct(F.col(seq).cast("int").alias("seq"), "kind", bare.alias("bare"), held.alias("values"))
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(own), lambda a, b: a["seq"] - b["seq"]).alias("__page"))
    marks = pages.select(*keys, F.inline(unlabelled_sums(F.col("__page"))))
    return rows.drop("kind").join(marks.withColumnRenamed("seq", seq), [*keys, seq])


def unlabelled_sums(page: Column) -> Column:
    """The same of a page's rows as an array in order (seq, kind, bare: without a label, values without nulls): an array of
    seq, kind and reason."""
    kind_of, none = "struct<seq:int,kind:string,reason:string>", F.create_map().cast("map<int,double>")
    last = F.array_max(F.transform(F.filter(page, lambda x: F.size(x["values"]) > 0), lambda x: x["seq"]))
    start = F.struct(none.alias("run"), F.lit(0).alias("n"), F.array().cast(f"array<{kind_of}>").alias("out"))

    def step(acc, x, last):
        v, run = x["values"], F.map_filter(acc["run"], lambda k, s: s != 0)
        data = (x["kind"] == "daten") & (F.size(v) > 0)
        same = F.array_sort(F.map_keys(v)) == F.array_sort(F.map_keys(run))
        near = F.forall(F.map_keys(v), lambda k: F.abs(F.try_element_at(v, k) - F.try_element_at(run, k)) < TOLERANCE)
        fits = (F.size(v) >= 2) & same & near
        is_sum = data & x["bare"] & (acc["n"] >= 1) & (fits | ((x["seq"] == last) & (acc["n"] >= 2)))
        explicit = x["kind"].isin("summe", "uebertrag")
        merged = F.map_zip_with(acc["run"], v, lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        why = F.when(is_sum, F.when(fits, FITS).otherwise(LAST)).otherwise("")
        mark = F.struct(x["seq"].alias("seq"), F.when(is_sum, "summe").otherwise(x["kind"]).alias("kind"), why.alias("reason"))
        return F.struct(
            F.when(is_sum | explicit, none).when(data, merged).otherwise(acc["run"]).alias("run"),
            F.when(is_sum | explicit, 0).when(data, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.concat(acc["out"], F.array(mark)).alias("out"),
        )

    return F.transform(F.array(last), lambda z: F.aggregate(page, start, lambda acc, x: step(acc, x, z))["out"])[0]


def remove_positions(rows: DataFrame, positions: list[int], keys: list[str], seq: str, kind: str = "kind") -> DataFrame:
    """rows without the data rows at these positions (from 0, data rows only)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(seq)) - 1
    gone = rows.where(F.col(kind) == "daten").withColumn("__place", place).where(F.col("__place").isin(*positions)).select(*keys, seq)
    return rows.join(gone, [*keys, seq], "left_anti")


def page_kind(text: Column, drawings: Column, n_words: Column) -> Column:
    """struct(kind, confidence) of a page by its text; white space of any kind at its ends doesn't count."""
    n = normalize(text)
    has = lambda words: n.rlike("(" + "|".join(words) + ")")
    # Words that tell a diagram and a table, normalised.
    schema = ("regelschema", "prinzipschaltbild", "anlagenschema", "strangschema", "funktionsschema", "schaltplan", "r i", "rls schema")
    table = ("summe funktionen", "funktionsliste", "datenpunktliste", "verarbeitungsfunktionen", "anwendungsfunktionen")
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    return F.when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < 30, of("unbekannt", 0.0)).when(has(schema), of("regelschema", 0.85)).when(has(table), of("funktionsliste", 0.7)).when((drawings > 150) & (n_words < 400), of("regelschema", 0.7)).otherwise(of("sonstiges", 0.5))
