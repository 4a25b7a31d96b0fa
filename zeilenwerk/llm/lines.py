"""Line deduplication with keep bitmaps, with DataFrame functions only.

Lines of at least LEAST code points (white space at both ends left out, A-Z as a-z) become rows of a 128-bit hash, the
document and the line's number; no text goes with them. They are range-partitioned by hash and sorted by hash, document
and position, and a window streams over each hash with its first document: lines of later documents are dropped. What is
returned is a bitmap for each document, as words of WORD bits for those stretches that lose lines; a word that isn't there
keeps all of its lines. `kept` joins texts with their bitmaps.

A line that a third of all documents hold would be one task's. Lines that stand out in a sample of documents (every
SAMPLE-th by hash; more than 1 / HOT of its lines, so HOT of them at most) are taken out before: their first documents are
aggregated map-side and broadcast. The sample decides only which way a line goes; both ways find the same.

Null and empty texts are one empty line. A document is a doc_id: rows that share one keep the same lines, and rows of a
null id are one document after all others. Repeated rows have the same result each. Texts may be long: only a text's
bitmap, which is smaller, comes together. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Code points of a line that may be dropped.
LEAST = 10
#: Bits in a word of a bitmap.
WORD = 60
#: One document in SAMPLE shows which lines are frequent; there are HOT of these at most, seen SEEN times at least.
SAMPLE, HOT, SEEN = 16, 1024, 8
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """h1, h2, doc (doc_id), same (a hash of the text: rows that share an id may differ), pos: the lines that may go."""
    each = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"), F.posexplode(F.transform(split(F.col(text)), line_key)).alias("pos", "key"))
    long = each.where(F.char_length("key") >= LEAST)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "same", "pos")


def frequent(lines: DataFrame) -> DataFrame:
    """h1, h2: HOT rows at most."""
    some = lines.where(F.pmod(F.xxhash64("doc", "same"), F.lit(SAMPLE)) == 0)
    n = some.count()
    return some.groupBy("h1", "h2").count().where(F.col("count") > F.lit(max(n / HOT, SEEN))).select("h1", "h2")


def dropped(lines: DataFrame) -> DataFrame:
    """doc, same, pos of the lines that go. lines: a written table of `hashes`."""
    key = ["h1", "h2"]
    later = ~F.col("doc").eqNullSafe(F.col("first"))
    hot = written(frequent(lines), "frequent")  # HOT rows at most, so it can be broadcast
    first = lines.join(F.broadcast(hot), key).groupBy(*key).agg(F.min("doc").alias("first"))
    often = lines.join(F.broadcast(first), key).where(later)
    order = W.partitionBy(*key).orderBy(F.col("doc").asc_nulls_last(), "pos")
    rest = lines.join(F.broadcast(hot), key, "left_anti").repartitionByRange(*key)
    rest = rest.withColumn("first", F.first("doc").over(order)).where(later)
    return often.select("doc", "same", "pos").unionByName(rest.select("doc", "same", "pos"))


def bitmaps(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, same, gone: an array of (word, bits) in order, bit i of word w set where line WORD * w + i goes. Documents
    that keep all lines have no row."""
    gone = dropped(written(hashes(docs, text), "lines")).repartition("doc", "same")
    word, bit = F.floor(F.col("pos") / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD).cast("int"))
    words = gone.groupBy("doc", "same", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "same").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and __kept, the text of the lines that stay (in place of columns of these names)."""
    found = bitmaps(docs, text).withColumnsRenamed({"doc": "__doc", "same": "__as", "gone": "__gone"})
    rows = docs.withColumn("__same", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__same") == F.col("__as")), "left").drop("__doc", "__as", "__same")
    # the words without gaps, so that each is found by its number
    gap = lambda w, i: F.array_repeat(F.lit(0).cast("long"), w["word"] - F.when(i == 0, 0).otherwise(F.get("__gone", i - 1)["word"] + 1))
    rows = rows.withColumn("__words", F.flatten(F.transform("__gone", lambda w, i: F.concat(gap(w, i), F.array(w["bits"]))))).withColumn("__lines", split(F.col(text)))
    stays = lambda x, i: F.coalesce(F.getbit(F.get("__words", F.floor(i / WORD).cast("int")), i % WORD), F.lit(0)) == 0
    rows = rows.withColumn("n_lines", F.size("__lines").cast("long"))
    rows = rows.withColumn("n_dropped", F.coalesce(F.aggregate("__gone", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w["bits"])), F.lit(0)).cast("long"))
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.filter("__lines", stays), "\n")))
    return rows.drop("__gone", "__words", "__lines")


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = kept(docs.select("doc_id", F.col(text).alias("text")))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("__kept", "utf-8"), 256).alias("kept_sha256"))
