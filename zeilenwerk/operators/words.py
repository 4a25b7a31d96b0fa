"""Tables out of positioned words (doc_id, page_index, word_id, x0, y0, x1, y1, text); pages never mix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_count
from . import geometry
from .binding import greedy

PAGE = ["doc_id", "page_index"]
#: Lines of a table's head lie so close together, and rows when nothing tells their distance.
LABEL_ROW, ROW = 3.5, 3.0
INTEGER, ADDRESS = r"^\d{1,3}$", r"^\d{1,2}(\.\d{1,2})*\.?$"


def cx() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def cy() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def is_rotated() -> Column:
    """Text set upright: much higher than wide."""
    h = F.col("y1") - F.col("y0")
    return (h > 1.6 * (F.col("x1") - F.col("x0"))) & (h > 12.0)


def lines(words: DataFrame, tolerance: float | Column, out: str = "line") -> DataFrame:
    return geometry.gap_clusters(words.withColumn("__cy", cy()), PAGE, "__cy", tolerance, "word_id", out).drop("__cy")


def boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """The rectangle around the words of each group."""
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def row_pitch(words: DataFrame, tolerance: float = ROW) -> DataFrame:
    """doc_id, page_index, pitch: the upper median of the distances between lines, those from 1 to 200."""
    first = lines(words, tolerance).groupBy(*PAGE, "line").agg(F.min_by(cy(), F.struct("x0", "word_id")).alias("cy"))
    gap = F.col("cy") - F.lag("cy").over(W.partitionBy(*PAGE).orderBy("cy"))
    gaps = first.withColumn("gap", gap).where("gap > 1 and gap < 200")
    return gaps.groupBy(*PAGE).agg(geometry.upper_median(F.collect_list("gap")).alias("pitch"))


def number_anchor(words: DataFrame, anchors: DataFrame, pattern: str = INTEGER, least: int = 4, tolerance: float = LABEL_ROW) -> DataFrame:
    """Of a page's anchor words the one with the most matching words on its line to the right (at least so many); the
    first of equals."""
    a = anchors.select(*PAGE, F.col("word_id").alias("anchor"), cy().alias("__ay"), cx().alias("__ax"))
    w = words.where(F.btrim("text").rlike(pattern)).select(*PAGE, "word_id", cy().alias("__y"), cx().alias("__x"))
    hits = geometry.band_join(a, w, PAGE, "__ay", "__y", tolerance).where("__x > __ax")
    counts = hits.groupBy(*PAGE, "anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.groupBy(*PAGE).agg(F.max_by("anchor", F.struct("n", -F.col("anchor"))).alias("anchor"), F.max("n").alias("n"))


def number_row(words: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """The line of column numbers on each page: eight integers and more, most of the line, none above 30, mostly counting
    up or starting at 1 again; the best one by numbers, restarts and steps. Gives line and score."""
    return number_row_of_lines(lines(words, tolerance))


def number_row_of_lines(words: DataFrame) -> DataFrame:
    """The same of words with their line."""
    w = words.withColumn("__n", F.when(F.btrim("text").rlike(INTEGER), F.btrim("text").cast("int"))).withColumn("__cx", cx())
    size = w.groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("k"))
    after = F.lead("__n").over(W.partitionBy(*PAGE, "line").orderBy("__cx", "word_id"))
    step = w.where("__n is not null").withColumn("__after", after)
    s = step.groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("n"), F.max("__n").alias("most"), F.count_if(F.col("__n") == 1).alias("ones"), F.count_if((F.col("__after") == F.col("__n") + 1) | (F.col("__after") == 1)).alias("up"))
    s = s.join(size, [*PAGE, "line"]).where("n >= 8 and n >= 0.6 * k and most <= 30 and up >= 0.7 * n")
    return s.withColumn("score", F.col("n") + 2 * F.col("ones") + F.col("up")).groupBy(*PAGE).agg(F.max_by("line", F.struct("score", -F.col("line"))).alias("line"), F.max("score").alias("score"))


def section_row(words: DataFrame, tops: DataFrame) -> DataFrame:
    """The lowest line of addresses within four heights above the number row. tops: doc_id, page_index, top, height."""
    near = words.join(tops, PAGE).withColumn("__cy", cy()).where((F.col("__cy") >= F.col("top") - 4 * F.col("height")) & (F.col("__cy") < F.col("top")) & F.btrim("text").rlike(ADDRESS))
    low = F.max("__cy").over(W.partitionBy(*PAGE))
    return near.withColumn("__low", low).where(F.abs(F.col("__cy") - F.col("__low")) <= F.col("height")).drop("__low", "__cy", "top", "height")


def blocks_of(numbers: DataFrame) -> DataFrame:
    """numbers (doc_id, page_index, place, number, x) with their block: one starts at each 1."""
    start = F.col("number").isin("1", "1.0").cast("int")
    first = (F.row_number().over(W.partitionBy(*PAGE).orderBy("place")) == 1).cast("int")
    n = numbers.withColumn("__s", F.greatest(start, first))
    return n.withColumn("block", F.sum("__s").over(W.partitionBy(*PAGE).orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__s")


def sections_in_order(numbers: DataFrame, sections: DataFrame) -> DataFrame:
    """The n-th block's section is the n-th one, where there are as many of both, else ''. sections: place, section."""
    b = blocks_of(numbers)
    order = F.row_number().over(W.partitionBy(*PAGE).orderBy("place")) - 1
    s = sections.withColumn("block", order).select(*PAGE, "block", "section")
    n_blocks = b.groupBy(*PAGE).agg(F.max("block").alias("__b"))
    n_sections = s.groupBy(*PAGE).agg(F.max("block").alias("__s"))
    same = n_blocks.join(n_sections, PAGE, "left").select(*PAGE, (F.col("__b") == F.col("__s")).alias("__same"))
    out = b.join(s, [*PAGE, "block"], "left").join(same, PAGE)
    return out.select(*PAGE, "place", "number", "block", F.when(F.col("__same"), F.coalesce("section", F.lit(""))).otherwise("").alias("section"))


def sections_by_place(numbers: DataFrame, sections: DataFrame) -> DataFrame:
    """Each block gets the section whose text stands nearest to its middle or its left end, each section once, nearest
    pairs first. A page has some ten of both."""
    b = blocks_of(numbers)
    middle = b.groupBy(*PAGE, "block").agg(F.avg("x").alias("middle"), F.min_by("x", "place").alias("left"))
    s = sections.select(*PAGE, F.col("place").alias("s"), "section", F.col("x").alias("__x"))
    near = F.least(F.abs(F.col("__x") - F.col("middle")), F.abs(F.col("__x") - F.col("left")))
    pairs = middle.join(s, PAGE).withColumn("score", -near).select(*PAGE, F.col("block").cast("long").alias("block"), F.col("s").cast("long").alias("s"), "section", "score")
    taken = greedy(pairs, PAGE, "block", "s", "score", -math.inf).select(*PAGE, "block", "section")
    return b.join(taken, [*PAGE, "block"], "left").select(*PAGE, "place", "number", "block", F.coalesce("section", F.lit("")).alias("section"))


def label_stacks(words: DataFrame, columns: DataFrame, gap: float = 8.0) -> DataFrame:
    """A column's upright label: the words over the head's lower edge within its width, from below up to the first gap.
    columns: doc_id, page_index, column_index, x_center, bottom, pitch."""
    reach = F.greatest(F.lit(3.0), 0.45 * F.col("pitch"))
    pages = columns.groupBy(*PAGE).agg(F.first("pitch").alias("pitch"), F.first("bottom").alias("bottom")).withColumn("__reach", reach)
    over = words.withColumn("__cx", cx()).join(pages, PAGE).where((F.col("y1") <= F.col("bottom")) & (F.col("x1") - F.col("x0") <= 1.15 * F.col("pitch")))
    own = columns.select(*PAGE, "column_index", "x_center").join(pages.select(*PAGE, F.col("__reach").alias("__r")), PAGE)
    w = geometry.band_join(over.withColumn("__at", F.col("__cx") / F.col("__reach")), own.withColumn("__of", F.col("x_center") / F.col("__r")).drop("__r"), PAGE, "__at", "__of", 1.01)
    w = w.where(F.abs(F.col("__cx") - F.col("x_center")) <= F.col("__reach"))
    order = W.partitionBy(*PAGE, "column_index").orderBy(F.col("y0").desc(), "word_id")
    apart = F.coalesce((F.lag("y0").over(order) - F.col("y1") > gap).cast("int"), F.lit(0))
    w = w.withColumn("__apart", apart).withColumn("__island", F.sum("__apart").over(order.rowsBetween(W.unboundedPreceding, 0))).where("__island = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "word_id", "text"))), lambda x: x["text"]), " ")
    return w.groupBy(*PAGE, "column_index").agg(text.alias("label"), F.min("y0").alias("top"))


def cells(words: DataFrame, columns: DataFrame, share: float) -> DataFrame:
    """What stands in each line and column: words (with line) whose middle is within this share of the columns' pitch,
    joined by x, with their rectangle and count. columns: doc_id, page_index, column_index, x_center, pitch (a page's)."""
    pitch = columns.groupBy(*PAGE).agg(F.first("pitch").alias("__pitch"))
    at = words.join(pitch, PAGE).withColumn("__at", cx() / F.col("__pitch")).drop("__pitch")
    own = columns.select(*PAGE, "column_index", "x_center", "pitch", (F.col("x_center") / F.col("pitch")).alias("__of"))
    w = geometry.band_join(at, own, PAGE, "__at", "__of", 1.01 * share)
    w = w.where(F.abs(cx() - F.col("x_center")) <= share * F.col("pitch"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ")
    out = w.groupBy(*PAGE, "line", "column_index").agg(parts.alias("raw_value"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    count = parse_count(F.col("raw_value"))
    return out.withColumn("count", count).withColumn("note", F.when(count.isNull(), F.col("raw_value")).otherwise(""))


def row_labels(words: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, page_index, line, row_no, label of the words left of the first column. edges: doc_id, page_index, label_left."""
    w = words.join(edges, PAGE).where(cx() < F.col("label_left"))
    text = F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " "))
    out = w.groupBy(*PAGE, "line").agg(text.alias("label"))
    number = F.regexp_extract("label", r"^(\d{1,3})( .*)?$", 1)
    return out.select(*PAGE, "line", number.alias("row_no"), F.when(number != "", F.regexp_extract("label", r"^\d{1,3} (.*)$", 1)).otherwise(F.col("label")).alias("label"))


def below_table(rows: DataFrame) -> DataFrame:
    """rows (kind, y, bottom, tolerance): under the table's lower edge only sums and carried sums stay."""
    return rows.where(~(F.col("y") > F.col("bottom") + F.col("tolerance")) | F.col("kind").isin("summe", "uebertrag") | F.col("bottom").isNull())


def regressions(rows: DataFrame) -> DataFrame:
    """Numbered data rows whose number isn't above the one before: row_seq, before, number."""
    n = rows.where((F.col("kind") == "daten") & F.col("row_no").rlike(r"^\d+$")).withColumn("number", F.col("row_no").cast("int"))
    n = n.withColumn("before", F.lag("number").over(W.partitionBy(*PAGE).orderBy("row_seq")))
    return n.where("number <= before").select(*PAGE, "row_seq", "before", "number")


def not_empty(rows: DataFrame) -> DataFrame:
    """Rows with a label, a cell, a remark or a number. n_cells: number of cells."""
    return rows.where((F.col("label") != "") | (F.col("n_cells") > 0) | (F.col("remark") != "") | (F.col("row_no") != ""))


def cleaned_ocr(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Words without the noise of read lines: right of the labels only numbers and crosses, left of them no single sign."""
    text = F.btrim(F.translate("text", "|_", "  "), F.lit(" .:;"))
    w = words.join(edges, PAGE).withColumn("text", text).where("text <> ''")
    cell = F.col("text").rlike(r"^(\d{1,3}|[xX✓])$")
    return w.where(F.when(cx() > F.col("label_left"), cell).otherwise((F.length("text") > 1) | F.col("text").rlike(r"(?U)^\w$") & (F.col("text") != "_"))).drop("label_left")


def vertical(segments: DataFrame) -> DataFrame:
    """Upright lines of drawings: narrower than 1.5 and longer than 20."""
    return segments.where((F.abs(F.col("x1") - F.col("x0")) < 1.5) & (F.abs(F.col("y1") - F.col("y0")) > 20))


def table_bottom(segments: DataFrame) -> DataFrame:
    """Where most upright lines of a page end, the lowest among equals."""
    return geometry.mode_largest(vertical(segments).withColumn("__y", F.rint(F.greatest("y0", "y1"))), PAGE, "__y").withColumnRenamed("mode", "bottom")


def usual(values: DataFrame, keys: list[str], value: str, order: str, grid: float = 4.0) -> DataFrame:
    """The most frequent value on a grid, the one seen first among equals."""
    q = values.withColumn("__q", F.rint(F.col(value) / grid) * grid).groupBy(*keys, "__q").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return q.groupBy(*keys).agg(F.max_by("__q", F.struct("n", -F.col("__first"))).alias(value))


def loose_block_sizes(numbers: DataFrame) -> DataFrame:
    """Sizes of blocks where numbers may be unreadable (null): a block starts at 1, at a null before a 2, and at first."""
    order = W.partitionBy(*PAGE).orderBy("place")
    start = (F.col("number") == 1) | (F.col("number").isNull() & (F.lead("number").over(order) == 2))
    start = F.coalesce(start, F.lit(False)) | (F.row_number().over(order) == 1)
    b = numbers.withColumn("__s", start.cast("int")).withColumn("block", F.sum("__s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return geometry.block_sizes(b, PAGE)


def separators(marks: DataFrame, gap: float = 3.0) -> DataFrame:
    """Lines out of marks (x, top, bottom) at most `gap` apart: mean x, highest top, lowest bottom."""
    c = geometry.gap_clusters(marks, PAGE, "x", gap, "top")
    return c.groupBy(*PAGE, "cluster").agg(F.avg("x").alias("x"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def cell_edges(separated: DataFrame, factor: float = 0.5) -> DataFrame:
    """Pairs of lines that follow each other, without those much narrower or wider than the upper median."""
    pairs = separated.withColumn("right", F.lead("x").over(W.partitionBy(*PAGE).orderBy("x"))).where("right is not null").withColumn("width", F.col("right") - F.col("x"))
    median = pairs.groupBy(*PAGE).agg(geometry.upper_median(F.collect_list("width")).alias("__m"))
    return pairs.join(median, PAGE).where((F.col("width") >= factor * F.col("__m")) & (F.col("width") <= F.col("__m") / factor)).select(*PAGE, F.col("x").alias("left"), "right", "width")


def more_bands(frames: DataFrame) -> DataFrame:
    """Rows looked for under a frame (bottom, height): at 1.0, 2.2 and 3.4 heights."""
    at = F.explode(F.array(*map(F.lit, (1.0, 2.2, 3.4))))
    return frames.select(*PAGE, at.alias("k"), "bottom", "height").select(*PAGE, (F.col("bottom") + F.col("k") * F.col("height")).alias("y"))


def footnotes(texts: DataFrame) -> DataFrame:
    """Footnotes out of lines (doc_id, page_index, line, text) such as `1) text 2) text`; what a marker has in several
    lines is joined. By marker as a number."""
    mark = r"(?<![\d.,])(\d{1,2})\)\s*"
    found, parts = F.regexp_extract_all("text", F.lit(mark), F.lit(1)), F.split("text", mark, -1)
    each = texts.where(F.col("text").rlike(mark)).select(*PAGE, "line", F.posexplode(F.arrays_zip(found.alias("marker"), F.slice(parts, F.lit(2), F.size(found)).alias("body"))).alias("n", "x"))
    each = each.select(*PAGE, "line", "n", "x.marker", F.btrim("x.body").alias("body")).where("body <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "n", "body"))), lambda b: b["body"]), " ")
    return each.groupBy(*PAGE, "marker").agg(joined.alias("text")).orderBy(*PAGE, F.col("marker").cast("int"))
