"""Lines, bands, intervals and neighbours of positioned words; each works within keys (a page), never across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, keys: list[str], value: str, tolerance: float, tie: str, out: str = "cluster") -> DataFrame:
    """A number for each run of values that are at most `tolerance` apart."""
    w = W.partitionBy(*keys).orderBy(value, tie)
    new = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.last(value, True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def blocks(df: DataFrame, keys: list[str], order: list[str], number: str, out: str = "block") -> DataFrame:
    """Block numbers: a block starts where the numbers start at 1 again, and at the first row."""
    w = W.partitionBy(*keys).orderBy(*order)
    start = ((F.col(number) == 1) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__start", start).withColumn(out, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def block_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    sizes = df.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n"))), lambda x: x["n"].cast("string")), "-").alias("sizes"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: float, width: float | None = None) -> DataFrame:
    """Pairs with |a - b| <= tolerance. An equi-join on cells of the axis, so no row meets all others: a row of the
    right side stands in the cells beside its own, too."""
    width = width or max(2 * tolerance, 1e-9)
    cell = F.floor(F.col(a) / width).alias("__cell")
    near = F.explode(F.sequence(F.floor((F.col(b) - tolerance) / width), F.floor((F.col(b) + tolerance) / width))).alias("__cell")
    return left.select("*", cell).join(right.select("*", near), [*keys, "__cell"]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("__cell")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, name: str) -> DataFrame:
    """For each row of left the value `name` of the nearest row of right (ties: the smaller b). Both sides stand in one
    order by position, and each row takes the last one before it and the first one after it."""
    both = left.select(*keys, F.col(a).alias("__at"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[name].dataType).alias("__name")).unionByName(right.select(*keys, F.col(b).alias("__at"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__row"), F.col(name).alias("__name")))
    mark = F.when(F.col("__row").isNull(), F.struct("__at", "__name"))
    order = W.partitionBy(*keys).orderBy("__at", F.col("__row").isNotNull())
    before, after = F.last(mark, True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first(mark, True).over(order.rowsBetween(0, W.unboundedFollowing))
    x = both.withColumn("__b", before).withColumn("__a", after).where("__row is not null")
    down, up = F.col("__at") - F.col("__b.__at"), F.col("__a.__at") - F.col("__at")
    take = F.when(up.isNull() | (down <= up), F.col("__b.__name")).otherwise(F.col("__a.__name"))
    return x.select("__row.*", take.alias(name))


def asof(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, name: str) -> DataFrame:
    """For each row of left the value of the last row of right that isn't after it."""
    both = left.select(*keys, F.col(a).alias("__at"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[name].dataType).alias("__name")).unionByName(right.select(*keys, F.col(b).alias("__at"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__row"), F.col(name).alias("__name")))
    order = W.partitionBy(*keys).orderBy("__at", F.col("__row").isNotNull())
    held = F.last(F.when(F.col("__row").isNull(), F.struct("__name")), True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("__held", held).where("__row is not null").select("__row.*", F.col("__held.__name").alias(name))


def without_overlaps(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.5, cell: float = 50.0) -> DataFrame:
    """Rectangles of left that no rectangle of right covers by `least` of the smaller one's area. Both stand in the cells of
    a grid that they touch, so that only those that share a cell meet; equal rectangles stand there once."""
    marks = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    spread = lambda df: df.withColumn("__cx", F.explode(marks("x0", "x1"))).withColumn("__cy", F.explode(marks("y0", "y1")))
    boxes = ("x0", "y0", "x1", "y1")
    own = left.select(*keys, *boxes).distinct()
    r = spread(right.select(*keys, *boxes).distinct()).select(*keys, "__cx", "__cy", *[F.col(c).alias(f"__{c}") for c in boxes])
    w = F.greatest(F.lit(0.0), F.least("x1", "__x1") - F.greatest("x0", "__x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "__y1") - F.greatest("y0", "__y0"))
    area = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("__x1") - F.col("__x0")) * (F.col("__y1") - F.col("__y0")))
    hit = spread(own).join(r, [*keys, "__cx", "__cy"]).where((w * h >= least * area) & (area > 0)).select(*keys, *boxes).distinct()
    return left.join(hit, [*keys, *boxes], "left_anti").select(*left.columns)


def mode_largest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, the largest among equals."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.max(F.struct("__n", value))[value].alias("mode"))


def upper_median(values: Column) -> Column:
    x = F.sort_array(values)
    return F.element_at(x, (F.floor(F.size(x) / 2) + 1).cast("int"))
