"""Which part of a read header band belongs to a catalogue: cells at both ends may be no columns, and numbers unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import section_of
from ..tables import buckets, written

# Cells that may be cut at each end, columns at least, numbers read at least, agreement at least.
TRIM, COLUMNS, READ, QUALITY = 8, 8, 6, 0.7
#: A fingerprint is a polynomial over where blocks start, modulo a prime; candidates are compared bit by bit after.
PRIME, BASE = 2_147_483_647, 1_000_003


def _prefixes(bits: Column) -> Column:
    """The fingerprints of the first 0, 1, 2, ... bits."""
    push = lambda acc, b: F.concat(acc, F.array((F.element_at(acc, -1) * BASE + b + 1) % PRIME))
    return F.aggregate(bits, F.array(F.lit(0).cast("long")), push)


def _powers(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1).cast("long")), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) * BASE % PRIME)))


def index(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, total): profiles by the keys by which a band finds them, with profile_id, expected (numbers) and bits: by
    length and fingerprint, and by lengths that one profile has. catalogue: profile_id, priority, place, address; of
    equal fingerprints the higher priority, then the first name."""
    section = section_of(F.col("address"))
    order = W.partitionBy("profile_id").orderBy("place")
    new = F.coalesce((section != F.lag(section).over(order)).cast("tinyint"), F.lit(1).cast("tinyint"))
    number = F.substring_index("address", ".", -1).try_cast("int")
    one = catalogue.repartition(buckets(catalogue), "profile_id").select("profile_id", "priority", "place", new.alias("bit"), number.alias("number"))
    one = one.groupBy("profile_id", "priority").agg(F.array_sort(F.collect_list(F.struct("place", "bit", "number"))).alias("c"))
    one = one.select(F.struct(-F.col("priority"), "profile_id").alias("rank"), F.struct("profile_id", F.col("c.number").alias("expected"), F.col("c.bit").alias("bits")).alias("p"), F.size("c").alias("n"))
    one = written(one.withColumn("print", F.element_at(_prefixes(F.col("p.bits")), -1)), "profiles")
    exact = one.groupBy("n", "print", F.col("p.bits").alias("__bits")).agg(F.min_by("p", "rank").alias("p")).select("n", "print", "p.*")
    total = one.groupBy("n").agg(F.count(F.lit(1)).alias("__k"), F.min_by("p", "rank").alias("p")).where("__k = 1").select("n", "p.*")
    return exact, total


def search(bands: DataFrame, catalogue: DataFrame, keys: list[str], trim: int = TRIM) -> DataFrame:
    """bands (keys, place, number: null if unread) -> keys, start, stop (cells, stop exclusive), profile_id, quality,
    readable, for bands that match a profile.

    Every cut of up to `trim` cells at each end is a candidate, as in a search over all 8 x 8 of them, but its blocks are
    never walked: a block starts at 1, at an unread cell before a 2, and at the cut's first cell, so its fingerprint is a
    difference of two prefix fingerprints, put right at both ends. One join with the index of profiles finds those of
    equal blocks, or else the only one of that length. The best one agrees with most of the numbers read, then reads
    most, then starts first, then is longest.

    Bands are kept in buckets; cuts go to the index without their cells, in as many parts as there are buckets, and only
    those that find a profile come back to their band. One profile a length is sent to all tasks, so the square of a
    band's width at most."""
    of_band = F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda x: x["number"])
    rows = bands.groupBy(*keys).agg(of_band.alias("w")).where(F.size(F.array_compact("w")) >= READ)
    starts = F.transform("w", lambda x, i: F.coalesce(((x == 1) | (x.isNull() & (F.get("w", i + 1) == 2))).cast("tinyint"), F.lit(0).cast("tinyint")))
    rows = written(rows.withColumn("bits", starts).withColumn("__row", F.monotonically_increasing_id()), "bands", ["__row"], buckets(bands))
    n, cells = F.size("w"), F.col("bits")

    def cut(start: Column, stop: Column) -> Column:
        # a cut starts with a block; its last cell starts none by what stands after the cut
        size = stop - start
        first = (1 - F.get(cells, start)) * F.get("powers", size - 1)
        last = F.when(F.get("w", stop - 1).isNull(), F.get(cells, stop - 1)).otherwise(0)
        print_ = F.pmod(F.get("prints", stop) - F.get("prints", start) * F.get("powers", size) % PRIME + first - last, F.lit(PRIME))
        return F.struct(start.alias("start"), stop.alias("stop"), size.alias("n"), print_.alias("print"))

    # a sequence never runs downwards: where the shortest cut doesn't fit, there is none
    ends = lambda start: F.when(start + COLUMNS <= n, F.sequence(F.greatest(n - trim, start + COLUMNS), n)).otherwise(F.array().cast("array<int>"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(trim), n) - 1), lambda start: F.transform(ends(start), lambda stop: cut(start, stop))))
    cuts = rows.withColumn("prints", _prefixes(cells)).withColumn("powers", _powers(n)).select("__row", F.inline(cuts))
    exact, total = index(catalogue)
    by_blocks = cuts.repartition(buckets(rows), "n", "print").join(exact, ["n", "print"]).withColumn("kind", F.lit(0)).drop("print")
    by_length = cuts.drop("print").join(F.broadcast(total), "n").withColumn("kind", F.lit(1))
    found = by_blocks.unionByName(by_length).withColumnRenamed("bits", "of_profile").join(rows, "__row")

    start, size = F.col("start"), F.col("n")
    last = F.when(F.get("w", F.col("stop") - 1).isNull(), F.get(cells, F.col("stop") - 1)).otherwise(0)
    own = F.transform(F.slice(cells, start + 1, size), lambda b, i: F.when(i == 0, 1).when(i == size - 1, b - last).otherwise(b).cast("tinyint"))
    found = found.where((F.col("kind") == 1) | (own == F.col("of_profile"))).withColumn("read", F.slice("w", start + 1, size))
    readable = F.size(F.array_compact("read"))
    right = F.size(F.filter(F.zip_with("read", "expected", lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    found = found.select("__row", *keys, "start", "stop", "kind", "profile_id", readable.alias("readable"), right.alias("right"))
    # an exact profile goes before the only one of that length
    found = found.groupBy("__row", *keys, "start", "stop").agg(F.min_by(F.struct("profile_id", "readable", "right"), "kind").alias("f")).select("__row", *keys, "start", "stop", "f.*")
    found = found.where("readable > 0").withColumn("quality", F.col("right") / F.col("readable")).where(F.col("quality") >= QUALITY)
    best = F.max_by(F.struct("start", "stop", "profile_id", "quality", "readable"), F.struct("quality", "readable", -F.col("start"), "stop"))
    return found.groupBy("__row", *keys).agg(best.alias("b")).select(*keys, "b.*")
