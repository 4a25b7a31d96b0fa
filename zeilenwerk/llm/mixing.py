"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents one after another in a fixed pseudorandom order, form a stream that is packed
into blocks of BLOCK words (the last one may be shorter). A target of t words over a stream of s words is t div s
whole passes and one partial pass; every block taken is a slot of its source.

Output shards have SHARD_SLOTS slots each. Every slot of a shard draws its source by a hash, in proportion to the
sources' slots, so a shard's counts by source are a multinomial draw. A source's slots are numbered through the shards.
The totals are those of the targets: what a source draws beyond them is given up, what it lacks fills shards at the end.
A slot's number is mapped to a block by a pseudorandom permutation of the source's block indexes, one for each pass (a
Feistel network over them, keyed by source and pass), and blocks join the documents' pieces by (source, block). The
short last block stands at the end of every permutation, and the last slot of a source is cut where its target ends, so
that what a source gives is its target, rounded down.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating. A source stops at CAP times its size and
the excess goes to the others by weight. That is min(level * weight, CAP * size) with one level for all, found from
running sums over the sources in order of size by weight.

Null and empty texts have size 0 and give nothing. Rows that repeat are documents of their own; rows with a null id
too. An empty table gives no rows. Other columns are left alone in `resampled` and dropped from `taken`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Words in a block.
BLOCK = 128
#: A source or document is taken so many times at most.
CAP = 3
#: Weights of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: Parts that a source's stream is summed in.
CHUNKS = 256
#: Slots of an output shard, and of a row before they are dealt out.
SHARD_SLOTS = 4096
#: The sources' shares are drawn from a table of so many cells.
CELLS = 1 << 16
#: Rounds of a permutation's network, and walks until an index is inside, which takes a few.
ROUNDS, WALKS = 4, 64
SEED = 20_011


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> weight, target, share. sizes has one row a source, so these windows are as small."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    full = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(full) - CAP * F.coalesce(F.sum("source_size").over(order), F.lit(0))
    share = F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    # the level if all before stop at their cap: the first that doesn't reach its own cap sets it
    leveled = weighed.withColumn("level", left / share).withColumn("free", F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("source_size") / F.col("weight"))).over(full)
    return leveled.select("source", "source_size", "weight", F.least(F.coalesce(level * F.col("weight"), F.lit(0.0)), (CAP * F.col("source_size")).cast("double")).alias("target"))


def stream(docs: DataFrame, text: str = "text", cols: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """row, cols, size, and at: where the document's words start in its source's stream."""
    rows = docs.select(*cols, words(F.col(text)).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", text).alias("place")).withColumn("chunk", F.pmod("place", F.lit(CHUNKS)))
    rows = written(rows, "sizes")
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_at"))
    within = W.partitionBy("source", "chunk").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("in_chunk", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(sums["source"]) & (placed["chunk"] == sums["chunk"])
    return placed.join(sums.hint("merge"), same).select(*[placed[c] for c in cols], "size", (F.col("chunk_at") + F.col("in_chunk")).alias("at"))


def permuted(i: Column, n: Column, key: Column) -> Column:
    """i's image under the permutation of 0 .. n-1 that belongs to the key. An index stands in a grid of about its root
    as left and right half; in turns, one half is moved by a hash of the other. The grid has less than a row more than n
    cells, and an index that falls outside is moved on until it's inside."""
    b = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("long")
    a = F.ceil(n / b).cast("long")

    def turn(acc, k):
        left, right = acc["left"], acc["right"]
        by = lambda half, m: F.pmod(F.xxhash64(F.lit(SEED), key, k, half), m)
        move = lambda x, half, m: F.pmod(x + by(half, m), m)
        even = F.struct(move(left, right, a).alias("left"), right.alias("right"))
        return F.when(k % 2 == 0, even).otherwise(F.struct(left.alias("left"), move(right, left, b).alias("right")))

    def once(x):
        start = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["left"] * b + acc["right"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(i), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no image within WALKS")))


def drawn(goals: DataFrame) -> DataFrame:
    """source, shard, first, count: runs of a source's slots in a shard. goals: source, n_slots, one row a source."""
    total = int(goals.agg(F.sum("n_slots")).first()[0] or 0)
    by_name = W.orderBy(F.col("source").isNull(), "source")
    upto = F.sum("n_slots").over(by_name.rowsBetween(W.unboundedPreceding, 0))
    share = lambda x: F.floor(x * CELLS / max(total, 1)).cast("int")
    cells = goals.select("source", "n_slots", share(upto - F.col("n_slots")).alias("lo"), share(upto).alias("hi")).where("hi > lo")
    cells = cells.select("source", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("cell"))  # CELLS rows at most
    spark, shards = goals.sparkSession, -(-total // SHARD_SLOTS)
    # a shard has its slots in one row, so that few rows are many slots; they are dealt out before they are unfolded
    each = spark.range(shards).withColumnRenamed("id", "shard").repartition(F.col("shard")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SHARD_SLOTS - 1))))
    each = each.where(F.col("shard") * SHARD_SLOTS + F.col("i") < total).withColumn("cell", F.pmod(F.xxhash64(F.lit(SEED), "shard", "i"), F.lit(CELLS)).cast("int"))
    counts = each.join(F.broadcast(cells), "cell").groupBy("shard", "source").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts, "counts")
    before = F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = counts.withColumn("first", before)
    same = runs["source"].eqNullSafe(goals["source"])
    kept = runs.join(goals, same).select(runs["source"], "shard", "first", F.least(F.col("count"), F.col("n_slots") - F.col("first")).alias("count")).where("count > 0")
    # what a source lacks, in shards of its own
    sums = counts.groupBy("source").agg(F.sum("count").alias("given"))
    lacking = goals.join(sums, goals["source"].eqNullSafe(sums["source"]), "left").select(goals["source"], "n_slots", F.coalesce("given", F.lit(0)).alias("given")).where("given < n_slots")
    lacking = lacking.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - F.col("given") - 1) / SHARD_SLOTS).cast("long"))))
    at = F.col("given") + F.col("k") * SHARD_SLOTS
    rest = lacking.select("source", (F.lit(shards) + F.col("k")).alias("shard"), at.alias("first"), F.least(F.lit(SHARD_SLOTS).cast("long"), F.col("n_slots") - at).alias("count"))
    return kept.unionByName(rest)


def slots(goals: DataFrame, block: int) -> DataFrame:
    """A row for each block that the mix takes: source, slot, shard, pass, block, take (its first words)."""
    whole, last = F.floor(F.col("source_size") / block).cast("long"), F.col("source_size") % block
    want = F.floor(F.col("target") + 1e-9).cast("long")
    goals = goals.where("source_size > 0").withColumn("want", want).withColumn("whole", whole).withColumn("n_blocks", whole + (last > 0).cast("long"))
    goals = goals.withColumn("passes", F.floor(F.col("want") / F.col("source_size")).cast("long")).withColumn("rest", F.col("want") % F.col("source_size"))
    goals = goals.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / block).cast("long")).where("n_slots > 0")
    goals = written(goals, "goals")
    runs = drawn(goals.select("source", "n_slots"))
    runs = runs.join(goals.withColumnRenamed("source", "__source"), runs["source"].eqNullSafe(F.col("__source"))).drop("__source")
    runs = runs.repartition(F.col("source"), F.col("shard"))
    each = runs.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    each = each.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")).cast("long")).withColumn("i", F.col("slot") % F.col("n_blocks"))
    each = each.withColumn("block", F.when(F.col("i") >= F.col("whole"), F.col("i")).otherwise(permuted(F.col("i"), F.col("whole"), F.struct("source", "pass"))))
    size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    take = F.when(F.col("pass") < F.col("passes"), size).otherwise(F.least(size, F.col("rest") - F.col("i") * block))
    return each.select("source", "slot", "shard", "pass", "block", take.alias("take"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """rows (source, at, size, ...) with block and the words lo to hi of it that are the document's."""
    at, size = F.col("at"), F.col("size")
    rows = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(at / block).cast("long"), F.floor((at + size - 1) / block).cast("long"))))
    return rows.withColumn("lo", F.greatest(at - F.col("block") * block, F.lit(0))).withColumn("hi", F.least(at + size - F.col("block") * block, F.lit(block)))


def shards(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix itself: shard, source, slot and the words of the block that stands there."""
    rows = docs.withColumn("__words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    placed = written(stream(rows, text, ("doc_id", "source", "__words")), "stream")
    goals = written(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    parts = pieces(placed, block)
    first = F.greatest(F.col("block") * block - F.col("at"), F.lit(0)) + 1
    parts = parts.select("source", "block", "at", F.slice("__words", first.cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("part"))
    whole = parts.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p")).select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.flatten("p.part").alias("words"))
    taken_slots = slots(goals, block)
    same = taken_slots["source"].eqNullSafe(F.col("__source")) & (taken_slots["block"] == F.col("__block"))
    return taken_slots.join(whole.hint("merge"), same).select("shard", "source", "slot", F.slice("words", F.lit(1), F.col("take").cast("int")).alias("words"))


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target and taken; slots)."""
    return mixed(written(stream(docs, text).withColumn("row", F.monotonically_increasing_id()), "stream"), block)


def mixed(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same for rows of `stream` (row, doc_id, source, size, at), a written table."""
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    taken_slots = slots(goals, block)
    # copies of a block, and of the one that is cut what is left of it
    copies = taken_slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("copies"), F.min("take").alias("least"))
    parts = pieces(rows, block).select("row", "source", "block", "lo", "hi")
    same = parts["source"].eqNullSafe(copies["source"]) & (parts["block"] == copies["block"])
    got = (F.col("copies") - 1) * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", "least") - F.col("lo"), F.lit(0))
    # an exploded side looks small to the planner but grows with the input: it is never broadcast
    taken = parts.join(copies.hint("merge"), same).groupBy("row").agg(F.sum(got).alias("taken"))
    out = rows.join(taken.hint("merge"), "row", "left")
    out = out.join(goals, out["source"].eqNullSafe(goals["source"]), "left").select("row", "doc_id", out["source"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "at")
    return out, taken_slots


def taken(docs: DataFrame, text: str = "text") -> DataFrame:
    return mix(docs, text)[0].select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def resampled(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, each row as often as the mix takes it: taken by size, rounded up with the probability of the fraction (by a
    hash of the document's place in its source's stream), so that a source's words are its target on average."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    placed = written(stream(rows, text, ("doc_id", "source", "__row")).withColumnRenamed("__row", "row"), "stream")
    times, _ = mixed(placed)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "source", "at"), F.lit(1 << 30)) / F.lit(1 << 30)
    copies = F.floor(F.col("taken") / F.col("size") + drawn).cast("int")
    times = times.where("taken > 0").select(F.col("row").alias("__row"), copies.alias("__times")).where("__times > 0")
    # what grows with the documents is never broadcast
    out = rows.join(written(times, "times").hint("merge"), "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*docs.columns)
