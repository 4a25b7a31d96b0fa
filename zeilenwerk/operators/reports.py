"""Listings, findings and audit over stored documents: what a reader of the lists looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import UNASSIGNED, general_number, present
from . import reconcile
from .facts import exact

# The order in which findings are shown.
FINDING_ORDER = {"abweichung": 0, "ausgeschlossen": 1, "hinweis": 2}


def footnote_listing(documents: DataFrame, footnotes: DataFrame) -> DataFrame:
    """datei, fassung, marker, text, bezieht_sich_auf of every footnote; markers by length, then text."""
    out = footnotes.join(documents.select("doc_id", "datei", "fassung"), "doc_id")
    return out.select("datei", "fassung", "marker", "text", F.concat_ws(", ", "referenced_columns").alias("bezieht_sich_auf")).orderBy("datei", F.length("marker"), "marker")


def profiles_in_use(documents: DataFrame) -> DataFrame:
    return documents.select(present(F.col("profil")).alias("profil")).where("profil is not null").distinct().orderBy("profil")


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("importiert_am"), "datei")


def in_profile_order(summary: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A column summary by profile, the columns' places in the catalogue (unknown ones last) and address, as text."""
    place = catalogue.select("spalte_key", F.col("column_index").alias("__place"))
    return summary.join(F.broadcast(place), "spalte_key", "left").orderBy("profil", F.coalesce("__place", F.lit(9999)), "adresse", "spalte_key").drop("__place")


def foci_per_page(rows: DataFrame) -> DataFrame:
    """The foci of a page's rows, sorted, in one text."""
    named = rows.where(present(F.col("focus")).isNotNull())
    return named.groupBy("doc_id", "page_index").agg(F.array_join(F.sort_array(F.collect_set("focus")), ", ").alias("schwerpunkte"))


def selected(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Rows that have one of the chosen values in every column; an empty choice takes all."""
    for column, values in choices.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def total_cost(priced: DataFrame) -> DataFrame:
    """The whole cost (0 for nothing) and how many columns have a price."""
    return priced.agg(F.coalesce(exact(F.col("kosten")), F.lit(0.0)).alias("gesamt"), F.count_if(F.col("preis") > 0).alias("mit_preis"), F.count(F.lit(1)).alias("spalten"))


def with_costs_only(priced: DataFrame) -> DataFrame:
    """Rows that cost something; all of them if none does."""
    some = priced.agg(F.coalesce(F.bool_or(F.col("kosten") > 0), F.lit(False)).alias("__some"))  # one row
    return priced.crossJoin(F.broadcast(some)).where((F.col("kosten") > 0) | ~F.col("__some")).drop("__some")


def occupied(matrix: DataFrame, keys: list[str]) -> list[str]:
    """The columns of a matrix whose sum isn't 0: one row of sums tells which columns a view needs."""
    sums = matrix.agg(*[F.sum(k).alias(k) for k in keys]).first()
    return [k for k in keys if sums[k]]


def with_total(matrix: DataFrame, name: str, keys: list[str], title: str = "Summe Funktionen") -> DataFrame:
    """A matrix with a column of row totals and a last row of column totals; other columns are '' there."""
    wide = matrix.select(F.col(name).cast("string").alias(name), *keys, sum((F.coalesce(F.col(k), F.lit(0.0)) for k in keys), F.lit(0.0)).alias("gesamt"))
    sums = wide.agg(*[exact(F.col(k)).alias(k) for k in (*keys, "gesamt")]).select(F.lit(title).alias(name), *keys, "gesamt")
    return wide.unionByName(sums)


def workbook_info(facts: DataFrame) -> DataFrame:
    """Files, different names of data points, functions and foci of an export."""
    return facts.agg(
        F.count_distinct("doc_id").alias("dateien"),
        F.count_distinct("datenpunkt").alias("datenpunkte"),
        exact(F.col("wert")).alias("funktionen"),
        F.count_distinct(F.when(F.col("schwerpunkt") != UNASSIGNED, F.col("schwerpunkt"))).alias("schwerpunkte"),
    )


def sum_pages(rows: DataFrame) -> DataFrame:
    """Pages with sum or carry rows and no countable one. rows: doc_id, page_index, kind, has_values."""
    sums, own = F.col("kind").isin("summe", "uebertrag"), (F.col("kind") == "daten") & F.col("has_values")
    pages = rows.groupBy("doc_id", "page_index").agg(F.bool_or(sums).alias("sums"), F.bool_or(own).alias("own"))
    return pages.where("sums and not own").select("doc_id", "page_index")


def to_read(pages: DataFrame, least: float = 0.7) -> DataFrame:
    """Pages that aren't skipped: diagrams and other pages that are surely so are."""
    return pages.where(~(F.col("kind").isin("regelschema", "sonstiges") & (F.col("confidence") >= least)))


def skipped_listing(pages: DataFrame) -> DataFrame:
    """Per document: pages, read ones, and the others as `S.n (kind)` by page."""
    skipped = F.col("kind") != "funktionsliste"
    listed = F.array_sort(F.collect_list(F.when(skipped, F.struct("page_index", "kind"))))
    text = F.array_join(F.transform(listed, lambda p: F.concat(F.lit("S."), (p["page_index"] + 1).cast("string"), F.lit(" ("), p["kind"], F.lit(")"))), "; ")
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("seiten"), F.count_if(~skipped).alias("seiten_ausgewertet"), text.alias("seiten_uebersprungen"))


def unmatched_columns(columns: DataFrame, most: int = 5) -> DataFrame:
    """Per document: how many columns have no key, and the first names of them. columns: doc_id, column_index, column_key, display."""
    bare = columns.where(present(F.col("column_key")).isNull())
    names = F.transform(F.array_sort(F.collect_list(F.struct("column_index", "display"))), lambda c: c["display"])
    out = bare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), names.alias("__names"))
    more = F.when(F.col("n") > most, " ...").otherwise("")
    return out.select("doc_id", "n", F.concat(F.array_join(F.slice("__names", 1, most), ", "), more).alias("namen"))


def _pages(flag: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(F.sort_array(F.collect_set(F.when(flag, F.col("page_index") + 1))), 1, most), lambda p: p.cast("string")), ", ")


def deviation_message(checks: DataFrame, most: int = 8) -> DataFrame:
    """Per document with deviating checks: their number, pages, and the first pages as text."""
    bad = ~F.col("matches")
    out = checks.groupBy("doc_id").agg(F.count_if(bad).alias("abweichungen"), F.count_distinct(F.when(bad, F.col("page_index"))).alias("n_seiten"), _pages(bad, most).alias("__first"))
    return out.where("abweichungen > 0").select("doc_id", "abweichungen", "n_seiten", F.concat("__first", F.when(F.col("n_seiten") > most, " ...").otherwise("")).alias("seiten"))


def check_text(documents: DataFrame, checks: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, text: the check of sums in a few words."""
    bad = ~F.col("matches")
    own = checks.groupBy("doc_id").agg(F.count_distinct("page_index").alias("n"), F.count_distinct(F.when(bad, F.col("page_index"))).alias("m"), _pages(bad, most).alias("s"))
    text = F.when(F.col("n").isNull(), "keine Summenzeile").when(F.col("m") == 0, F.format_string("%d Seiten exakt", "n")).otherwise(F.format_string("%d von %d Seiten abweichend (S. %s)", "m", "n", "s"))
    return documents.select("doc_id").join(own, "doc_id", "left").select("doc_id", text.alias("text"))


def excluded_listing(rows: DataFrame) -> DataFrame:
    """How many rows of each other kind a document has."""
    return rows.where("kind <> 'daten'").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def warnings_listing(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "datei", F.posexplode("warnings").alias("n", "hinweis"))


def findings(documents: DataFrame, pages: DataFrame, rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Everything worth a look, in its order: deviating sums, rows left out that hold values, and warnings. The focus is
    the row's, else its page's; a sum's place is the first sum row of its page and column. Rows may hold their cells."""
    names = documents.select("doc_id", "datei")
    focus = pages.select("doc_id", "page_index", present(F.col("focus")).alias("__page"))
    bad = reconcile.page_findings(rows, cells)
    place = reconcile.with_cells(rows.where("kind = 'summe'"), cells, ("bbox",))
    place = place.groupBy("doc_id", "page_index", "column_index").agg(F.min_by("bbox", "row_seq").alias("bbox"), F.min("row_seq").alias("row_seq"))
    title = F.concat(F.lit("Seite "), (F.col("page_index") + 1).cast("string"), F.lit(", Spalte "), F.col("column_index").cast("string"), F.lit(": Liste "), general_number(F.col("reported")), F.lit(", eigene Zaehlung "), general_number(F.col("own")))
    one = bad.join(place, ["doc_id", "page_index", "column_index"], "left").join(focus, ["doc_id", "page_index"], "left")
    one = one.select("doc_id", "art", "page_index", "row_seq", "column_index", title.alias("titel"), F.coalesce("__page", F.lit("")).alias("schwerpunkt"), F.col("reported").alias("wert"), "bbox")
    left = reconcile.excluded_findings(rows, cells).join(rows.select("doc_id", "row_seq", "row_no", "datenpunkt", present(F.col("focus")).alias("__own"), "bbox"), ["doc_id", "row_seq"]).join(focus, ["doc_id", "page_index"], "left")
    title = F.concat(F.lit("Zeile "), F.coalesce(present(F.col("row_no")), F.lit("-")), F.lit(": "), F.coalesce(present(F.col("datenpunkt")), F.lit("(ohne Beschriftung)")), F.lit(" ("), "kind", F.lit(")"))
    two = left.select("doc_id", "art", "page_index", "row_seq", F.lit(None).cast("int").alias("column_index"), title.alias("titel"), F.coalesce("__own", "__page", F.lit("")).alias("schwerpunkt"), F.col("value").alias("wert"), "bbox")
    three = warnings_listing(documents).select("doc_id", F.lit("hinweis").alias("art"), F.lit(None).cast("int").alias("page_index"), F.col("n").alias("row_seq"), F.lit(None).cast("int").alias("column_index"), F.substring("hinweis", 1, 90).alias("titel"), F.lit("").alias("schwerpunkt"), F.lit(None).cast("double").alias("wert"), F.lit(None).cast("string").alias("bbox"))
    every = one.unionByName(two).unionByName(three).join(names, "doc_id")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in FINDING_ORDER.items() for x in kv])[F.col("art")], F.lit(9))
    return every.orderBy(rank, "datei", "page_index", "row_seq", "column_index")


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("art").agg(F.count(F.lit(1)).alias("n"))


def audit_report(documents: DataFrame, rows: DataFrame, cells: DataFrame | None, columns: DataFrame) -> DataFrame:
    """Both parts of the audit in one relation: sums of each column, and every row that isn't counted with its reason.
    Where a part has no such value, numbers are null and texts ''. Where cells is None, rows hold them: then both parts come
    out of one pass, in which a row gives its cells and, if it isn't counted, itself."""
    names, label = documents.select("doc_id", "datei"), columns.select("column_index", F.col("adresse").alias("__spalte"), F.col("label").alias("__label"))
    if cells is not None:
        own = cells.groupBy("doc_id", "row_seq").agg(F.collect_list(F.struct("column_index", "count")).alias("cells"))
        rows = rows.join(own, ["doc_id", "row_seq"], "left")
    none, count = lambda kind: F.lit(None).cast(kind), lambda c: c["count"].cast("decimal(28,6)")
    held = F.filter("cells", lambda c: c["count"].isNotNull())
    line = lambda c, kind, out, value: F.struct(c.alias("column_index"), F.lit(kind).alias("kind"), out.alias("row"), value.alias("value"))
    out = F.struct(F.col("row_seq").cast("long").alias("row_seq"), F.col("datenpunkt").alias("bezeichnung"), (F.col("page_index") + 1).alias("seite"), F.col("row_no").alias("zeile"), F.col("kind").alias("bewertung"), F.col("reason").alias("begruendung"))
    uncounted = "struct<row_seq:bigint,bezeichnung:string,seite:int,zeile:string,bewertung:string,begruendung:string>"
    facts = lambda kind: F.when(F.col("kind") == kind, F.transform(held, lambda c: line(c["column_index"], kind, none(uncounted), count(c))))
    total = F.aggregate(F.transform(held, count), F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)"))
    left = F.when(F.col("kind") != "daten", F.array(line(none("int"), "", out.cast(uncounted), F.coalesce(total, F.lit(0)).cast("decimal(28,6)"))))
    empty = F.array().cast(f"array<struct<column_index:int,kind:string,row:{uncounted},value:decimal(28,6)>>")
    each = rows.select("doc_id", F.inline(F.concat(*[F.coalesce(x, empty) for x in (facts("daten"), facts("summe"), left)])))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value"))).cast("double")
    # a row that isn't counted is a group of its own; a column's cells are one
    both = each.groupBy("doc_id", "column_index", "row").agg(of("daten").alias("__own"), of("summe").alias("reported"), of("").alias("__left"))
    both = both.join(F.broadcast(label), "column_index", "left")
    row, is_sum, nothing = F.col("row"), F.col("row").isNull(), F.lit("")
    own = F.coalesce("__own", F.lit(0.0))
    both = both.select(
        "doc_id", F.when(is_sum, "Summenabgleich").otherwise("nicht gezählte Zeile").alias("art"), F.when(is_sum, F.coalesce("__spalte", F.col("column_index").cast("string"))).otherwise("").alias("spalte"),
        F.when(is_sum, F.coalesce("__label", nothing)).otherwise(row["bezeichnung"]).alias("bezeichnung"), row["seite"].alias("seite"), F.when(is_sum, "").otherwise(row["zeile"]).alias("zeile"),
        F.when(is_sum, F.col("reported")).otherwise(F.coalesce("__left", F.lit(0.0))).alias("wert_liste"), F.when(is_sum, own).otherwise(0.0).alias("wert_eigene_zaehlung"),
        F.when(is_sum, reconcile.verdict(F.col("reported"), own)).otherwise(row["bewertung"]).alias("bewertung"), F.when(is_sum, "").otherwise(row["begruendung"]).alias("begruendung"),
    )
    return both.join(names, "doc_id").drop("doc_id")


def remarks(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, row_seq, bemerkungen: a row's remark and its cells' notes in order, joined."""
    notes = cells.where(present(F.col("note")).isNotNull()).groupBy("doc_id", "row_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "note"))), lambda n: n["note"]).alias("__notes"))
    out = rows.where("kind = 'daten'").join(notes, ["doc_id", "row_seq"], "left")
    own = F.filter(F.concat(F.array(F.coalesce("remark", F.lit(""))), F.coalesce("__notes", F.array().cast("array<string>"))), lambda x: x != "")
    return out.select("doc_id", "row_seq", F.array_join(own, " | ").alias("bemerkungen"))


def source_file(documents: DataFrame, files: DataFrame) -> DataFrame:
    """The first of stored_path and source_path that exists. files: path."""
    there = lambda c: documents.select("doc_id", F.col(c).alias("path")).join(files.select("path"), "path", "left_semi").select("doc_id", F.col("path").alias(f"__{c}"))
    return documents.select("doc_id").join(there("stored_path"), "doc_id", "left").join(there("source_path"), "doc_id", "left").select("doc_id", F.coalesce("__stored_path", "__source_path").alias("quelle"))


def ordered_foci(focus_summary: DataFrame) -> DataFrame:
    return focus_summary.orderBy((F.col("schwerpunkt") == UNASSIGNED).cast("int"), "schwerpunkt")


def linked_overview(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """What the overview's formulas give: quantity and rows of the detail rows that carry the document's key."""
    one_row = facts.groupBy("doc_id", "row_seq").agg(exact(F.col("wert")).alias("wert"))
    detail = one_row.groupBy(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("key")).agg(exact(F.col("wert")).alias("menge"), F.count(F.lit(1)).alias("datenpunkte"))
    keyed = documents.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("key"))
    return keyed.join(detail, "key", "left").fillna(0.0, ["menge"]).fillna(0, ["datenpunkte"])


def merged_heads(columns: DataFrame, by: str = "gruppe") -> DataFrame:
    """Runs of neighbouring columns of one group, as first and last column: what a table's head merges."""
    order = W.orderBy("column_index")  # a catalogue, some fifty rows
    new = F.coalesce((~F.col(by).eqNullSafe(F.lag(by).over(order))).cast("int"), F.lit(1))
    runs = columns.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("__run", by).agg(F.min("column_index").alias("von"), F.max("column_index").alias("bis")).drop("__run")
