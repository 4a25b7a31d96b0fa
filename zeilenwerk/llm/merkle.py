"""Document fingerprints: Merkle trees over sections, paragraphs and their sentences, with DataFrame functions only.

A section ends at a blank line, a paragraph at a line end, a sentence (or clause) at one of .!?|,;: before a space. A leaf is the
hash of a sentence; a paragraph's hash covers its leaves', a section's its paragraphs', the root the sections'. White
space around a sentence doesn't count in its leaf, but the root also covers the hash of the whole text, so roots are
equal for equal texts only. The fingerprint is `root:tree`, the tree as LEAF_HEX digits a leaf, leaves parted by
',' (sentence), ';' (paragraph) and '/' (section): equal roots test equality, and where two trees differ, comparing
branches locates the edits.

Likeness of two fingerprints: 1 for equal roots, else the shared leaves by all leaves (distinct ones), below 1.

Null and empty texts have the fingerprint of the empty text, whose tree is empty. Two such are alike by 1, an empty
one and another by 0. Null ids and repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits of a leaf's hash.
LEAF_HEX = 8
#: Documents of a range in `with_next`, and ranges at most: up to 13 million documents a range stays as small, beyond
#: that ranges grow.
RANGE_ROWS, RANGES = 200, 1 << 16


def _sha(x: Column) -> Column:
    return F.sha2(F.encode(x, "utf-8"), 256)


def tree(text: Column) -> Column:
    """The leaves' hashes as text."""
    sentence = lambda s: F.substring(_sha(F.btrim(s)), 1, LEAF_HEX)
    full = lambda s: F.btrim(s, F.lit(" \t\n\r")) != ""
    paragraph = lambda p: F.array_join(F.transform(F.filter(F.split(p, r"(?<=[.!?|,;:])[ \t]+"), full), sentence), ",")
    section = lambda s: F.array_join(F.transform(F.filter(F.split(s, r"[\n\r]"), full), paragraph), ";")
    return F.array_join(F.transform(F.filter(F.split(text, r"\n[ \t\r]*\n"), full), section), "/")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column. The tree is a column of its own, so that it's made once."""
    df = df.withColumn("__tree", tree(F.coalesce(text, F.lit(""))))
    paragraphs = F.transform(F.split("__tree", "/"), lambda s: _sha(F.array_join(F.transform(F.split(s, ";"), _sha), "")))
    root = _sha(F.concat(_sha(F.coalesce(text, F.lit(""))), F.array_join(paragraphs, "")))
    return df.withColumn(out, F.concat(root, F.lit(":"), "__tree")).drop("__tree")


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring_index(fp, ":", -1), "[,;/]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    x, y = leaves(a), leaves(b)
    both = F.size(F.array_intersect(x, y))
    shared = both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(F.least(shared, F.lit(0.999)))


def edits(a: Column, b: Column) -> Column:
    """Where b's tree has branches that a's hasn't: an array of (section, paragraph, sentence), numbers from 0."""
    known = leaves(a)
    at = F.transform(
        F.split(F.substring_index(b, ":", -1), "/"),
        lambda s, i: F.flatten(
            F.transform(
                F.split(s, ";"),
                lambda p, j: F.filter(
                    F.transform(F.split(p, ","), lambda x, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("sentence"), (~F.array_contains(known, x)).alias("new"))),
                    lambda x: x["new"],
                ),
            )
        ),
    )
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.slice(F.flatten(at), 1, 0)).otherwise(F.flatten(at))


def with_next(plain: DataFrame) -> DataFrame:
    """doc_id, __text, __fp with __next: text and fp of the next row in descending order of doc_id (then by text; null
    ids last); after the last row the first.

    Ids are dealt into ranges by their quantiles. A range's last row is followed by the first one of the next range;
    there is one such row a range, RANGES at most."""
    n = plain.count()
    k = min(RANGES, n // RANGE_ROWS)
    cuts = sorted({int(x) for x in plain.stat.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k)}) if k > 1 else []
    # which range an id is in takes two short searches: among every step-th cut, then among those between
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda x: F.size(F.filter(x, lambda c: c <= F.col("doc_id")))
    if cuts:
        longs = lambda x: F.lit(x).cast("array<bigint>")
        coarse = below(longs(cuts[::step]))
        fine = F.try_element_at(F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts), step)]), F.greatest(coarse, F.lit(1)))
        part = len(cuts) - (F.greatest(coarse - 1, F.lit(0)) * step + F.coalesce(below(fine), F.lit(0)))
    else:
        part = F.lit(0)
    dealt = plain.withColumn("__part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(part))
    order = W.partitionBy("__part").orderBy(F.col("doc_id").desc_nulls_last(), "__text")
    own = F.struct(F.col("__text").alias("text"), F.col("__fp").alias("fp"))
    rows = with_fingerprint(dealt, "__text", "__fp").withColumn("__next", F.lead(own).over(order))
    heads = dealt.groupBy("__part").agg(F.min(F.struct((-F.col("doc_id")).alias("id"), "__text"))["__text"].alias("__text"))
    heads = with_fingerprint(heads, "__text", "__fp").select("__part", own.alias("head"))
    # only numbers of ranges are ordered in one task, then the texts are joined to them
    numbers, by_part = dealt.select("__part").distinct(), W.orderBy("__part")
    every = by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = numbers.select("__part", F.coalesce(F.lead("__part").over(by_part), F.first("__part").over(every)).alias("__follows"))
    heads = follows.join(heads.withColumnRenamed("__part", "__follows"), "__follows").select("__part", F.col("head").alias("__after"))
    return rows.join(heads, "__part").withColumn("__next", F.coalesce("__next", "__after")).drop("__after", "__part")


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones of the next document,
    in descending order of doc_id, or by all of them if it has fewer."""
    rows = with_next(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__text")))
    n, third = F.length("__text"), F.floor(F.length("__text") / 3).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), n - third), F.substring(F.col("__next")["text"], F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("__edited"), F.col("__fp").alias("fingerprint"), F.col("__next")["fp"].alias("__next_fp"))
    rows = with_fingerprint(rows, "__edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        _sha(F.col("__edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__next_fp")).alias("near_next"),
    )
