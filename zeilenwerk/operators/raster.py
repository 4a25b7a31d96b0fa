"""Lines of a scanned page out of rows of pixels (doc_id, page_index, y, pixels: array of grey values, 0 is black).

Runs of dark pixels along a row are found in the row's array; down a column they are islands of consecutive rows, found by
a window over the dark pixels of each column, so a page's rows may be dealt out. A page has as many columns as it is wide,
and only dark pixels become rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import geometry
from .words import PAGE

# Grey that counts as dark on a page of no contrast, and its share of a page's mean.
DARKEST, SHARE = 60, 0.6
#: A line's length in pixels and as shares of the page's height.
LENGTH, UPRIGHT, SEPARATOR = 20, 0.08, 0.15
#: Lines so many rows or columns apart are one.
THICK = 3


def thresholds(pixel_rows: DataFrame) -> DataFrame:
    """doc_id, page_index, threshold, height: what is darker is ink."""
    of_row = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    sums = pixel_rows.select(*PAGE, of_row.alias("s"), F.size("pixels").alias("n")).groupBy(*PAGE).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("height"))
    return sums.where("n > 0").select(*PAGE, F.greatest(F.lit(DARKEST), F.floor(F.col("s") / F.col("n") * SHARE)).cast("int").alias("threshold"), "height")


def runs(dark: Column) -> Column:
    """array of (start, stop) of the runs of true in an array; stop is exclusive."""
    at = F.sequence(F.lit(0), F.size(dark))
    before = lambda i: F.coalesce(F.get(dark, i - 1), F.lit(False))
    here = lambda i: F.coalesce(F.get(dark, i), F.lit(False))
    return F.arrays_zip(F.filter(at, lambda i: here(i) & ~before(i)).alias("start"), F.filter(at, lambda i: ~here(i) & before(i)).alias("stop"))


def _dark(pixel_rows: DataFrame) -> DataFrame:
    return pixel_rows.join(thresholds(pixel_rows), PAGE).withColumn("dark", F.transform("pixels", lambda p: p < F.col("threshold")))


def level_runs(pixel_rows: DataFrame, least: int) -> DataFrame:
    """doc_id, page_index, y, start, stop of dark runs of at least so many pixels along a row."""
    each = _dark(pixel_rows).select(*PAGE, "y", F.inline(runs(F.col("dark"))))
    return each.where(F.col("stop") - F.col("start") >= least)


def level_lines(pixel_rows: DataFrame, least: int) -> DataFrame:
    """doc_id, page_index, y of level lines: of rows that hold a run, those more than THICK below the last one taken."""
    ys = level_runs(pixel_rows, least).groupBy(*PAGE).agg(F.array_sort(F.collect_set("y")).alias("ys"))
    none = F.array().cast(ys.schema["ys"].dataType)
    taken = F.aggregate("ys", none, lambda acc, y: F.when((F.size(acc) > 0) & (y - F.element_at(acc, -1) <= THICK), acc).otherwise(F.concat(acc, F.array(y))))
    return ys.select(*PAGE, F.explode(taken).alias("y"))


def upright_runs(pixel_rows: DataFrame, share: float = UPRIGHT) -> DataFrame:
    """doc_id, page_index, x, start, stop of dark runs down a column, at least LENGTH or this share of the page's height."""
    ink = _dark(pixel_rows).select(*PAGE, "y", "height", F.explode(F.filter(F.sequence(F.lit(0), F.size("dark") - 1), lambda i: F.get("dark", i))).alias("x"))
    island = F.col("y") - F.row_number().over(W.partitionBy(*PAGE, "x").orderBy("y"))
    each = ink.withColumn("__i", island).groupBy(*PAGE, "x", "__i").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("stop"), F.first("height").alias("height"))
    return each.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(LENGTH), F.floor(F.col("height") * share))).select(*PAGE, "x", "start", "stop")


def separators(pixel_rows: DataFrame) -> DataFrame:
    """doc_id, page_index, x, top, bottom of upright lines: runs at most THICK columns apart are one."""
    c = geometry.gap_clusters(upright_runs(pixel_rows, SEPARATOR), PAGE, "x", THICK, "start")
    return c.groupBy(*PAGE, "cluster").agg(F.avg("x").alias("x"), F.min("start").alias("top"), F.max("stop").alias("bottom")).drop("cluster")


def table_bottom(pixel_rows: DataFrame, frames: DataFrame) -> DataFrame:
    """doc_id, page_index, bottom of a table: the upper median of where the upright lines end that begin at its body. frames:
    doc_id, page_index, body_top, left, right, pitch, row_pitch. Pages without such lines have no row."""
    near = F.greatest(F.col("pitch") * 0.8, F.col("row_pitch") * 1.2, F.lit(6.0))
    lines = upright_runs(pixel_rows).join(frames, PAGE).withColumn("__near", near)
    good = lines.where((F.col("x") >= F.col("left") - F.col("pitch")) & (F.col("x") <= F.col("right") + F.col("pitch")) & (F.abs(F.col("start") - F.col("body_top")) <= F.col("__near")) & (F.col("stop") > F.col("body_top") + F.col("__near")))
    return good.groupBy(*PAGE).agg(geometry.upper_median(F.collect_list("stop")).cast("double").alias("bottom"))


#: Angles that are tried, in degrees, and the edge that a picture is reduced to before.
MOST_DEGREES, STEP_DEGREES, EDGE = 4.0, 0.25, 1000


def _profile(page: pd.DataFrame) -> float:
    """The angle whose rows of ink differ most."""
    page = page.sort_values("y")
    step = max(1, -(-max(len(page), max(map(len, page["pixels"]), default=0)) // EDGE))
    rows = [np.asarray(p, float)[::step] for p in page["pixels"].iloc[::step]]
    ink = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        ink[i, : len(r)] = 255 - r
    y, x = np.nonzero(ink)
    weight = ink[y, x]
    y, x = y - (len(ink) - 1) / 2, x - (ink.shape[1] - 1) / 2
    best, most = 0.0, -1.0
    for k in range(round(2 * MOST_DEGREES / STEP_DEGREES) + 1):
        a = math.radians(k * STEP_DEGREES - MOST_DEGREES)
        at = np.floor(y * math.cos(a) - x * math.sin(a) + len(ink) / 2).astype(int)
        inside = (at >= 0) & (at < len(ink))
        score = float(np.bincount(at[inside], weight[inside], len(ink)).var()) if len(ink) else 0.0
        if score > most:
            best, most = k * STEP_DEGREES - MOST_DEGREES, score
    return best


def skew(pixel_rows: DataFrame) -> DataFrame:
    """doc_id, page_index, angle: by how many degrees a page has to be turned (against the clock) so that its lines lie
    level. All angles are tried on a page's ink in one pass over arrays; a page is one picture, reduced
    to EDGE pixels, so a group is bounded. The least angle of equals wins, and a blank page has the first one."""
    kinds = dict(pixel_rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], "angle double"])

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _profile(page))], columns=[*PAGE, "angle"])

    return pixel_rows.select(*PAGE, "y", "pixels").groupBy(*PAGE).applyInPandas(run, schema)
