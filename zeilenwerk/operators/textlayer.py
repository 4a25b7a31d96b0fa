"""A page's text layer: whether it can be used, and its words made anew out of characters where a font is defective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import repair_glyphs
from .raster import runs
from .words import PAGE

#: Fixed value: a page of so many characters has a text layer.
LEAST = 200
#: White space of any kind, the separators 28 to 31 too.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{CLASS}+|{CLASS}+$", "")


def has_text(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_index, text) -> doc_id, has_text: whether any page has LEAST characters."""
    return pages.groupBy("doc_id").agg(F.bool_or(F.length(stripped(F.col("text"))) >= LEAST).alias("has_text"))


def defective_pages(spans: DataFrame) -> DataFrame:
    """Pages with a control character. spans: doc_id, page_index, span, chars (array of c, x0, y0, x1, y1)."""
    bad = F.exists("chars", lambda c: c["c"].rlike(r"[\x01-\x1f]"))
    return spans.where(bad).select(*PAGE).distinct()


def from_characters(spans: DataFrame) -> DataFrame:
    """doc_id, page_index, span, n, x0, y0, x1, y1, text: a span's characters between white space, glyphs repaired. A
    word never crosses spans; its box holds its characters' boxes. Null and empty characters end a word, too."""
    ink = F.transform("chars", lambda c: F.coalesce((c["c"] != "") & ~c["c"].isin(*WHITE), F.lit(False)))
    # cut before they become rows: no word carries its whole span
    pieces = F.transform(runs(F.col("__ink")), lambda r: F.slice("chars", r["start"] + 1, r["stop"] - r["start"]))
    own = spans.withColumn("__ink", ink).select(*PAGE, "span", F.posexplode(pieces).alias("n", "chars"))
    edge = [f(F.col("chars")[c]).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
    return own.select(*PAGE, "span", "n", *edge, repair_glyphs(F.array_join("chars.c", "")).alias("text"))


def words(spans: DataFrame, read: DataFrame, chars: Column | None = None) -> DataFrame:
    """The words as they were read (columns as from_characters has them); those of defective pages out of characters.
    Where spans hold what their characters are made of, chars makes them: after the join, as they are many times as
    large as the text."""
    chars = F.col("chars") if chars is None else chars
    bad = defective_pages(spans.withColumn("chars", chars))
    made = from_characters(spans.join(bad, PAGE, "left_semi").withColumn("chars", chars))
    return read.join(bad, PAGE, "left_anti").select(made.columns).unionByName(made)
