"""Function lists out of workbook cells (doc_id, sheet, r, c, value; empty cells have no row).

What several steps read is written once, in buckets of the sheets: no step after that moves the cells again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let, places
from ..functions.text import footnote_markers, normalize, normalize_address, parse_count
from ..tables import CO_PARTITION, buckets, written
from . import rows as rules

SHEET = ["doc_id", "sheet"]
# Labels of a sheet's head and foot, normalised, with the fields they name.
FIELDS = {
    "gewerk": "gewerk",
    "anlage": "anlage",
    "projekt": "projekt",
    "auftraggeber projekt": "auftraggeber",
    "auftraggeber": "auftraggeber",
    "planersteller": "planersteller",
    "planstand": "planstand",
    "blatt nr": "blatt_nr",
    "informationsschwerpunkt": "informationsschwerpunkt",
    "isp": "informationsschwerpunkt",
    "automationsschwerpunkt": "automationsschwerpunkt",
    "asp": "automationsschwerpunkt",
    "datenkommunikationsprotokoll": "protokoll",
    "datenkommunikationsprotokoll ae asp": "protokoll",
    "ausgabedatum": "datum",
    "datum": "datum",
}
#: The sections whose columns hold notes.
NOTE_SECTIONS = ("4", "9")


def _field(value: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])[normalize(F.regexp_replace(value, ":+$", ""))]


def metadata(grid: DataFrame) -> DataFrame:
    """doc_id, sheet, field, value: the first value of each field, in order of the sheet. It stands one or two cells right
    of its label, or below it where a row holds two labels and more; other labels and what ends in : are none."""
    cells = grid.withColumn("field", _field(F.col("value")))
    many = F.count("field").over(W.partitionBy(*SHEET, "r")) >= 2
    labels = cells.withColumn("__many", many).where("field is not null").select(*SHEET, "r", "c", "field", "__many")
    good = cells.where(F.col("field").isNull() & ~F.col("value").endswith(":")).select(*SHEET, F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("value").alias("__v"))
    places = F.array(F.when(F.col("__many"), F.struct(F.lit(0).alias("n"), (F.col("r") + 1).alias("__r"), F.col("c").alias("__c"))), *[F.struct(F.lit(k).alias("n"), F.col("r").alias("__r"), (F.col("c") + k).alias("__c")) for k in (1, 2)])
    tries = labels.select(*SHEET, "r", "c", "field", F.inline(F.filter(places, lambda p: p.isNotNull())))
    return tries.join(good, [*SHEET, "__r", "__c"]).groupBy(*SHEET, "field").agg(F.min_by("__v", F.struct("r", "c", "n")).alias("value"))


def lines(grid: DataFrame) -> DataFrame:
    """doc_id, sheet, r, cells: a row of a sheet holds its cells (c, value) in order."""
    return grid.groupBy(*SHEET, "r").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("cells"))


def _last(found: Column, c: Column, value: str) -> Column:
    """This field of the last of some cells, in order of c, that isn't right of c."""
    return F.element_at(F.filter(F.concat(F.array(F.lit(None)), found), lambda x: x.isNull() | (x["c"] <= c)), -1)[value]


def _columns(rows: Column, section_row: Column, label_col: Column, number_row: Column, texts: bool) -> Column:
    """A head's columns out of its rows (r, cells), an array in order, with their texts or without; null without four numbers."""
    at = lambda r: F.flatten(F.transform(F.filter(rows, lambda x: x["r"] == r), lambda x: x["cells"]))
    numbers = F.filter(at(number_row), lambda x: (x["c"] > label_col) & x["value"].rlike(r"^\d+$"))
    sections = F.transform(F.filter(at(section_row), lambda x: x["c"] > label_col), lambda x: F.struct(x["c"].alias("c"), normalize_address(x["value"]).alias("section")))
    sections = F.filter(sections, lambda s: s["section"] != "")

    def sectioned(n: Column, s: Column) -> Column:
        # as many blocks as sections: in order, unless these are empty; else the last section to the left
        starts = places(F.size(n), lambda i: F.get(n, i)["value"].isin("1", "1.0") | (i == 0))
        block = lambda k, i: F.size(F.filter(k, lambda x: x <= i)) - 1
        section = lambda k, x, i: F.when(F.size(k) == F.size(s), F.get(s, block(k, i))["section"]).otherwise(F.coalesce(_last(s, x["c"], "section"), F.lit("")))
        return let(starts, lambda k: F.transform(n, lambda x, i: F.struct(x["c"].alias("c"), i.cast("int").alias("column_index"), x["value"].alias("column_no"), section(k, x, i).alias("section"))))

    def labelled(cols: Column) -> Column:
        first, last = F.get(cols, F.lit(0))["c"], F.element_at(cols, -1)["c"]
        # the row of labels: the most different texts within eight rows over the sections, the lower of equals
        above = F.filter(rows, lambda x: (x["r"] < section_row) & (x["r"] >= section_row - 8))
        above = F.transform(above, lambda x: F.struct(x["r"].alias("r"), F.filter(x["cells"], lambda y: y["c"].between(first, last)).alias("cells")))
        different = lambda x: F.size(F.array_distinct(F.transform(F.filter(x["cells"], lambda y: F.length(y["value"]) > 3), lambda y: y["value"])))
        best = lambda ab: F.array_max(F.filter(F.transform(ab, lambda x: F.struct(different(x).alias("n"), x["r"].alias("r"))), lambda x: x["n"] >= 3))["r"]
        return let(above, lambda ab: let(best(ab), lambda r: named(cols, ab, r)))

    def named(cols: Column, above: Column, label_row: Column) -> Column:
        # groups: the last text at or to the left, from the first function column on, in the two rows over the labels
        over = lambda k: F.flatten(F.transform(F.filter(above, lambda x: x["r"] == F.coalesce(label_row, section_row) - k), lambda x: x["cells"]))
        label = lambda ls, x: F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(ls, lambda y: y["c"] == x["c"]), lambda y: F.btrim(y["value"]))), -1), F.lit(""))
        groups = lambda u, w, x, t: F.filter(F.array(_last(u, x["c"], "value"), _last(w, x["c"], "value")), lambda g: g.isNotNull() & (g != t))
        one = lambda x, t, g: F.struct(
            *[x[k].alias(k) for k in ("c", "column_index", "column_no", "section")], F.concat_ws(".", F.nullif(x["section"], F.lit("")), normalize_address(x["column_no"])).alias("address"), t.alias("label"),
            F.coalesce(F.get(g, F.lit(0)), F.lit("")).alias("group_name"), F.coalesce(F.get(g, F.lit(1)), F.lit("")).alias("subgroup"), x["section"].isin(*NOTE_SECTIONS).alias("is_note"), footnote_markers(t).alias("footnote_markers"),
            (number_row + 1).alias("first_row"), section_row.alias("section_row"), label_col.alias("label_col"), label_row.alias("label_row"),
        )
        each = lambda ls, u, w: F.transform(cols, lambda x: let(label(ls, x), lambda t: let(groups(u, w, x, t), lambda g: one(x, t, g))))
        return let(at(label_row), lambda ls: let(over(2), lambda u: let(over(1), lambda w: each(ls, u, w))))

    bare = lambda cols: F.transform(cols, lambda x: F.struct(x["c"].alias("c"), x["column_index"].alias("column_index"), x["section"].isin(*NOTE_SECTIONS).alias("is_note"), (number_row + 1).alias("first_row"), label_col.alias("label_col")))
    return let(numbers, lambda n: F.when(F.size(n) >= 4, let(let(sections, lambda s: sectioned(n, s)), labelled if texts else bare)))


def heads(lines: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, sheet, columns (an array) of the sheets that have the labels Abschnitt and Spalte; null without four numbers.
    The rows down to the lower label are put together, one row a sheet; the rows below are not. Without texts a column has
    only what a body needs."""
    name = F.transform("cells", lambda x: F.struct(x["c"].alias("c"), normalize(x["value"]).alias("name")))
    first = lambda label: F.min(F.when(F.exists("names", lambda x: x["name"] == label), F.struct("r", F.element_at(F.filter("names", lambda x: x["name"] == label), 1)["c"].alias("c"))))
    # a name is no shorter than six letters and holds no digit
    some = F.exists("cells", lambda x: (F.char_length(x["value"]) >= 6) & ~x["value"].rlike("[0-9]"))
    named = lines.withColumn("names", F.when(some, name).otherwise(F.array().cast("array<struct<c:int,name:string>>")))
    sheet = W.partitionBy(*SHEET)
    at = named.withColumn("a", first("abschnitt").over(sheet)).withColumn("s", first("spalte").over(sheet)).where("r <= greatest(a.r, s.r) and a is not null and s is not null")
    own = at.groupBy(*SHEET, F.col("a.r").alias("section_row"), F.col("a.c").alias("label_col"), F.col("s.r").alias("number_row")).agg(F.sort_array(F.collect_list(F.struct("r", "cells"))).alias("rows"))
    columns = let(F.col("rows"), lambda rows: _columns(rows, F.col("section_row"), F.col("label_col"), F.col("number_row"), texts))
    # out of a generator, as what is asked of its rows is not made again below it
    return own.select(*SHEET, F.explode(F.array(columns)).alias("columns"))


def head(grid: DataFrame) -> DataFrame:
    """A row for each function column of each sheet that has the labels Abschnitt and Spalte and four numbered columns:
    c, column_index, column_no, section, address, label, group_name, subgroup, is_note, footnote_markers, first_row (of
    the body), section_row, label_col, label_row."""
    return heads(lines(grid)).select(*SHEET, F.inline("columns"))


def body(grid: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) under the heads. A row's label is what stands left of the first function column, without its number
    and what stands in the column of the labels Abschnitt and Spalte (the qualifier). Rows from the first footer or
    header row on go, then empty ones at the end; sums without a label are marked."""
    own = columns.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("c", "column_index", "is_note", "first_row", "label_col"))).alias("columns"))
    return tables(lines(grid), own)


def tables(lines: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rows that hold their cells and heads that hold their columns."""
    lines.sparkSession.conf.set(CO_PARTITION, "false")  # both are dealt out by documents
    own = heads.select(*SHEET, F.transform("columns", lambda x: F.struct(*[x[k].alias(k) for k in ("c", "column_index", "is_note")])).alias("columns"), *[F.get("columns", F.lit(0))[k].alias(f"__{n}") for k, n in (("c", "first"), ("first_row", "top"), ("label_col", "q"))])
    some = F.exists("cells", lambda x: (x["c"] < F.col("__first")) | F.array_contains(F.col("columns")["c"], x["c"]))
    rows = lines.hint("merge").join(own, SHEET).where("r >= __top").where(some)
    # a row's cells with their columns
    hit = lambda x: F.filter("columns", lambda k: k["c"] == x["c"])
    count = lambda x, k: F.when(~k["is_note"], parse_count(x["value"]))
    cell = lambda x, k, n: F.struct(k["column_index"].alias("column_index"), k["is_note"].alias("is_note"), x["value"].alias("raw_value"), n.alias("count"), F.when(n.isNull(), x["value"]).otherwise("").alias("note"))
    right = F.filter("cells", lambda x: x["c"] >= F.col("__first"))
    right = F.flatten(F.transform(right, lambda x: F.transform(hit(x), lambda k: let(count(x, k), lambda n: cell(x, k, n)))))
    left = F.filter("cells", lambda x: x["c"] < F.col("__first"))
    rows = rows.select(*SHEET, F.col("r").alias("row_seq"), right.alias("cells"), F.transform(left, lambda x: x["value"]).alias("__t"), F.array_max(F.transform(F.filter(left, lambda x: x["c"] == F.col("__q")), lambda x: x["value"])).alias("qualifier"))
    number = F.when(F.get("__t", F.lit(0)).rlike(r"^\d+$"), F.get("__t", F.lit(0))).otherwise("")
    rows = rows.withColumn("row_no", number).withColumn("__at", F.array_position("__t", F.coalesce("qualifier", F.lit(""))))
    texts = F.filter("__t", lambda x, i: ~((i == 0) & (F.col("row_no") != "")) & (i + 1 != F.col("__at")))
    remark = F.array_join(F.transform(F.filter("cells", lambda x: x["is_note"]), lambda x: x["raw_value"]), " ")
    rows = rows.select(*SHEET, "row_seq", "row_no", F.btrim(F.array_join(texts, " ")).alias("label"), F.coalesce("qualifier", F.lit("")).alias("qualifier"), remark.alias("remark"), F.exists("cells", lambda x: x["count"].isNotNull()).alias("has_values"), "cells")
    rows = rows.withColumn("__name", normalize(F.col("label")))
    rows = rows.withColumn("kind", rules.kind_of_name(F.col("__name"), F.col("label"), F.col("has_values")))
    rows = rules.cut_after_footer(rows, SHEET, "row_seq").withColumn("first_reason", rules.reason(F.col("kind")))
    # sums without a label are looked for only in sheets that have a row of numbers without a label
    bare = F.max((F.col("__name") == "") & F.col("has_values")).over(W.partitionBy(*SHEET))
    rows = written(rows.withColumn("__bare", bare).drop("__name"), "body_rows")
    values = F.map_from_entries(F.transform("cells", lambda x: F.struct(x["column_index"].cast("int").alias("k"), x["count"].alias("v"))))
    rows = rows.withColumn("values", values)
    names = [*SHEET, "row_seq", "row_no", "label", "qualifier", "remark", "values", "has_values", "kind", "first_reason", "reason"]
    marked = rules.mark_unlabelled_sums(rows.where("__bare").drop("cells", "__bare"), SHEET).select(*names)
    every = marked.unionByName(rows.where("not __bare").withColumn("reason", F.lit("")).select(*names))
    every = every.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), "first_reason")).drop("first_reason")
    return every, rows.select(*SHEET, "row_seq", F.inline("cells")).drop("is_note")


def footnotes(grid: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, sheet, marker, text over the head: `1)` with what stands in the next two cells; longer texts up to five rows
    below and two columns aside go on with the nearest one."""
    top = columns.groupBy(*SHEET).agg(F.min(F.greatest(F.coalesce("label_row", "section_row") - 2, F.lit(0))).alias("__top"))
    own = written(grid.join(top, SHEET).where("r < __top").withColumn("value", F.btrim("value")), "notes", SHEET, buckets(grid))
    mark = own.where(F.col("value").rlike(r"^\d{1,2}\)$")).select(*SHEET, F.col("r").alias("ar"), (F.col("c") + 1).alias("ac"), F.regexp_extract("value", r"^(\d+)", 1).alias("marker"))
    near = mark.join(own.select(*SHEET, F.col("r").alias("ar"), "c", "value"), [*SHEET, "ar"]).where("c = ac or c = ac + 1")
    body_ = near.groupBy(*SHEET, "marker", "ar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "value"))), lambda x: x["value"]), " ").alias("text"))
    lines = [body_.select(*SHEET, "marker", F.col("ar").alias("r"), F.lit(0).alias("c"), "text")]
    tail = own.where(F.length("value") > 10).select(*SHEET, "r", "c", F.col("value").alias("text")).join(mark, SHEET).where("abs(ac - c) <= 2 and r >= ar and r - ar <= 5")
    tail = tail.groupBy(*SHEET, "r", "c", "text").agg(F.bool_or(F.col("r") == F.col("ar")).alias("__own"), F.min(F.struct((F.col("r") - F.col("ar")).alias("d"), "marker")).alias("m")).where("not __own")
    lines.append(tail.select(*SHEET, "m.marker", "r", "c", "text"))
    every = lines[0].unionByName(lines[1])
    known = mark.select(*SHEET, "marker").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "text"))), lambda x: x["text"]), " ")
    return known.join(every.groupBy(*SHEET, "marker").agg(text.alias("text")), [*SHEET, "marker"], "left").fillna("", ["text"]).orderBy(*SHEET, F.col("marker").cast("int"))
