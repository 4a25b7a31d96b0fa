"""A page's fields out of its positioned words: what stands beside or below a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize
from . import words
from .words import PAGE

# Labels, normalised, with the fields they name; words that are labels of other things.
LABELS = {
    "gewerk": "gewerk",
    "anlage": "anlage",
    "projekt": "projekt",
    "auftraggeber projekt": "auftraggeber",
    "auftraggeber": "auftraggeber",
    "planersteller": "planersteller",
    "planstand": "planstand",
    "blatt nr": "blatt_nr",
    "von": "blatt_von",
    "informationsschwerpunkt": "informationsschwerpunkt",
    "isp": "informationsschwerpunkt",
    "automationsschwerpunkt": "automationsschwerpunkt",
    "asp": "automationsschwerpunkt",
    "datenkommunikationsprotokoll": "protokoll",
    "ausgabedatum": "datum",
    "datum": "datum",
}
STOPS = ("name", "geprueft", "inhalt", "index", "rev", "blatt", "datei", "seite", "stand")
#: How far apart a value's words stand, its length, lines below a label, how far left of it.
GAP, LENGTH, BELOW, ASIDE = 40.0, 60, 3, 6.0


def _field(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), key)


def _key(text: Column) -> Column:
    return normalize(F.regexp_replace(text, ":+$", ""))


def _beside(after: Column, label: Column, right: Column, edge: Column) -> Column:
    """The words right of a label, one after another, until another label or stop word, a gap, the table's edge or enough
    text."""
    start = F.struct(F.array().cast("array<string>").alias("texts"), right.alias("right"), F.lit(False).alias("done"))

    def step(acc, w):
        ends = w["field"].isNotNull() | w["key"].isin(*STOPS) | (w["x0"] - acc["right"] > GAP) | F.coalesce((label["x0"] < edge) & (edge <= w["x0"]), F.lit(False))
        more = F.concat(acc["texts"], F.array(w["text"]))
        full = F.length(F.array_join(more, " ")) > LENGTH
        took = F.struct(more.alias("texts"), w["x1"].alias("right"), full.alias("done"))
        ended = F.struct(acc["texts"].alias("texts"), acc["right"].alias("right"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(ends, ended).otherwise(took)

    return F.aggregate(after, start, step, lambda acc: acc["texts"])


def _below(lines: Column, label: Column, border: Column, field: Column) -> Column:
    """The words under a label in the first of the next lines that has any; a bare number is none but for sheet numbers."""
    under = F.transform(lines, lambda ws: F.transform(F.filter(ws, lambda w: (w["x0"] >= label["x0"] - ASIDE) & (w["x0"] < border) & w["field"].isNull() & ~w["key"].isin(*STOPS)), lambda w: w["text"]))
    good = F.filter(under, lambda t: (F.size(t) > 0) & ~((F.size(t) == 1) & F.btrim(F.get(t, 0)).rlike(r"^\d+$") & ~field.isin("blatt_nr", "blatt_von")))
    return F.coalesce(F.get(good, 0), F.array().cast("array<string>"))


def fields(page_words: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """doc_id, page_index, field, value: the first value of each field in reading order. page_words: doc_id, page_index,
    word_id, x0, y0, x1, y1, text; edges: doc_id, page_index, label_left (where the table's columns begin).

    A label is a word or two. Its value stands right of it; in a line of two labels and more it may stand in one of the
    next lines instead, between the label and the next one. The second number of a sheet counts only after the first. A
    line is one array, as short as a page is wide, and lines meet only the three that follow."""
    w = words.lines(page_words.where(~words.is_rotated()), 3.0)
    word = F.struct("x0", "word_id", "x1", "text", "key", _field(F.col("key")).alias("field"))
    lines = w.withColumn("key", _key(F.col("text"))).groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    order = W.partitionBy(*PAGE).orderBy("line")
    lines = lines.withColumn("next", F.filter(F.array(*[F.lead("ws", k).over(order) for k in range(1, BELOW + 1)]), lambda x: x.isNotNull()))
    if edges is None:
        lines = lines.withColumn("label_left", F.lit(None).cast("double"))
    else:
        lines = lines.join(edges.select(*PAGE, "label_left"), PAGE, "left")
    many = F.size(F.filter("ws", lambda x: x["field"].isNotNull())) >= 2
    each = lines.withColumn("many", many).select(*PAGE, "line", "ws", "next", "label_left", "many", F.posexplode("ws").alias("i", "label"))
    two = _field(normalize(F.regexp_replace(F.concat(F.col("label.text"), F.lit(" "), F.get("ws", F.col("i") + 1)["text"]), ":+$", "")))
    single = F.col("label.field").isNotNull()
    each = each.withColumn("field", F.coalesce("label.field", two)).where("field is not null").withColumn("skip", F.when(single, 0).otherwise(1))
    after = F.slice("ws", F.col("i") + F.col("skip") + 2, F.size("ws"))
    right = F.get("ws", F.col("i") + F.col("skip"))["x1"]
    border = F.coalesce(F.array_min(F.transform(F.filter(after, lambda x: x["field"].isNotNull()), lambda x: x["x0"])), F.lit(float("inf")))
    each = each.withColumn("value", _beside(after, F.col("label"), right, F.col("label_left")))
    each = each.withColumn("value", F.when((F.size("value") == 0) & F.col("many"), _below(F.col("next"), F.col("label"), border, F.col("field"))).otherwise(F.col("value")))
    each = each.where(F.size("value") > 0).select(*PAGE, "field", F.struct("line", "i").alias("at"), F.btrim(F.array_join("value", " ")).alias("value"))
    sheet = F.min(F.when(F.col("field") == "blatt_nr", F.col("at"))).over(W.partitionBy(*PAGE))
    each = each.withColumn("sheet", sheet).where((F.col("field") != "blatt_von") | (F.col("at") > F.col("sheet")))
    return each.groupBy(*PAGE, "field").agg(F.min_by("value", "at").alias("value"))
