"""Binding found columns to a catalogue: by address, then by likeness, one to one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, normalize_address
from .matching import best_pairs

THRESHOLD = 0.78


def tiered(a: Column, b: Column) -> Column:
    """Likeness of two texts as far as expressions tell it: 1 if equal, 0.85 to 0.95 if one holds the other (of four
    letters at least), 0 if one is empty, else null."""
    x, y = normalize(a), normalize(b)
    less, more = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((x.contains(y) | y.contains(x)) & (less >= 4), 0.85 + 0.1 * (less / more))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks by length (Ratcliff and Obershelp); no built-in function has it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    return F.coalesce(tiered(a, b), ratio(normalize(a), normalize(b)))


def greedy(pairs: DataFrame, keys: list[str], left: str, right: str, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """The best pairs of at least the threshold first, each side once; ties by left, then right."""
    return best_pairs(pairs.where(F.col(score) >= threshold), keys, left, right, [F.col(score).desc()])


def scored_pairs(headers: DataFrame, catalogue: DataFrame, keys: list[str], likeness: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """keys, column_index, place, column_key, is_note, score of headers (keys, column_index, profile_id, address,
    group_name, subgroup, label, abbrev) and the columns of their profile (profile_id, place, column_key, address,
    group_name, subgroup, label, abbrev, aliases, is_note), from THRESHOLD up.

    An address that the profile has binds its header to that column alone (1.5). Others score by the likeness of label or
    abbreviation, or of all their names at 0.95, to any of the column's names; an equal group adds 0.08, an equal
    subgroup 0.05, up to 1. Profiles are as small as a table's head, so a header meets some fifty columns."""
    h = headers.withColumn("__adr", normalize_address(F.col("address")))
    adr = catalogue.select("profile_id", "place", "column_key", "is_note", normalize_address(F.col("address")).alias("__adr")).where("__adr <> ''")
    adr = adr.groupBy("profile_id", "__adr").agg(F.min_by(F.struct("place", "column_key", "is_note"), "place").alias("c"))
    h = h.join(adr, ["profile_id", "__adr"], "left")
    out = [*keys, "column_index", "place", "column_key", "is_note", "score"]
    bound = h.where("c is not null").select(*keys, "column_index", "c.*", F.lit(1.5).alias("score"))
    texts = F.filter(F.array("label", "abbrev"), lambda t: F.coalesce(t, F.lit("")) != "")
    whole = F.btrim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("group_name", "subgroup", "label")]))
    free = h.where("c is null").select(*keys, "column_index", "profile_id", F.coalesce("group_name", F.lit("")).alias("__group"), F.coalesce("subgroup", F.lit("")).alias("__sub"), texts.alias("__texts"), whole.alias("__whole"))
    names = F.filter(F.concat(F.array("label", "abbrev"), "aliases"), lambda t: F.coalesce(t, F.lit("")) != "")
    cols = catalogue.select("profile_id", "place", "column_key", "is_note", F.coalesce("group_name", F.lit("")).alias("group_name"), F.coalesce("subgroup", F.lit("")).alias("subgroup"), names.alias("__names"))
    ways = F.concat(F.transform(F.when(F.size("__texts") > 0, F.col("__texts")).otherwise(F.array("__whole")), lambda t: F.struct(t.alias("text"), F.lit(1.0).alias("worth"))), F.array(F.struct(F.col("__whole").alias("text"), F.lit(0.95).alias("worth"))))
    each = free.join(cols, "profile_id").withColumn("__way", F.explode(ways)).withColumn("__name", F.explode("__names"))
    each = each.withColumn("score", F.coalesce(likeness(F.col("__way.text"), F.col("__name")), F.lit(0.0)) * F.col("__way.worth"))
    best = each.groupBy(*keys, "column_index", "place", "column_key", "is_note", "__group", "__sub", "group_name", "subgroup").agg(F.max("score").alias("score"))
    for own, theirs, bonus in (("__group", "group_name", 0.08), ("__sub", "subgroup", 0.05)):
        alike = (F.col(theirs) != "") & (F.coalesce(likeness(F.col(own), F.col(theirs)), F.lit(0.0)) > 0.7)
        best = best.withColumn("score", F.when(alike, F.least(F.lit(1.0), F.col("score") + bonus)).otherwise(F.col("score")))
    return bound.select(*out).unionByName(best.where(F.col("score") >= THRESHOLD).select(*out))


def match_columns(headers: DataFrame, catalogue: DataFrame, keys: list[str], likeness: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """headers with column_key (null: none), match_score (up to 1, three places; 0: none) and is_note, one to one within
    keys: best scores first, then the first header, then the first column."""
    taken = best_pairs(scored_pairs(headers, catalogue, keys, likeness), keys, "column_index", "place", [F.col("score").desc()])
    found = taken.select(*keys, "column_index", "column_key", F.round(F.least(F.lit(1.0), "score"), 3).alias("match_score"), "is_note")
    out = headers.drop("column_key", "match_score", "is_note").join(found, [*keys, "column_index"], "left")
    return out.withColumn("match_score", F.coalesce("match_score", F.lit(0.0))).withColumn("is_note", F.coalesce("is_note", F.lit(False)))


#: Letters of a keyword by which texts look it up, and keywords at most.
GRAM, KEYWORDS = 3, 20_000


def detect_profile(texts: DataFrame, keywords: DataFrame, profiles: DataFrame) -> DataFrame:
    """texts (doc_id, text: one row a document), keywords (profile_id, text, weight; negative ones too), profiles
    (profile_id, priority, min_score) -> doc_id, profile_id (null below its least score), score, scores (by profile).

    A keyword counts once if the normalised text holds it anywhere. Of equal scores the higher priority wins, then the
    first name. The catalogue is small (more than KEYWORDS are an error), texts aren't: the runs of GRAM letters of a text's
    different words are intersected with those that the keywords' longest words begin with, and only what they share is
    joined with keywords and looked up in the text, so that no text meets all keywords."""
    known = keywords.select("profile_id", normalize(F.col("text")).alias("word"), F.col("weight").cast("double").alias("weight")).where("word <> ''")
    longest = F.array_sort(F.split("word", " "), lambda a, b: F.length(b) - F.length(a))
    known = known.withColumn("gram", F.substring(F.get(longest, 0), 1, GRAM))
    grams = [r[0] for r in known.select("gram").distinct().limit(KEYWORDS + 1).collect()]
    if len(grams) > KEYWORDS:
        raise ValueError(f"more than {KEYWORDS} keywords")
    n = texts.select("doc_id", normalize(F.col("text")).alias("__n"))
    n = n.withColumn("__c", F.split(F.array_join(F.array_distinct(F.split("__n", " ")), " "), ""))
    runs = lambda k: F.transform(F.sequence(F.lit(0), F.size("__c") - 1), lambda i: F.concat_ws("", *[F.get("__c", i + j) for j in range(k)]))
    shared = F.array_intersect(F.lit(grams), F.concat(*map(runs, sorted({len(g) for g in grams})))) if grams else F.array().cast("array<string>")
    hits = n.withColumn("gram", F.explode(shared)).join(F.broadcast(known), "gram").where(F.contains("__n", F.col("word")))
    scores = hits.groupBy("doc_id", "profile_id").agg(F.sum("weight").alias("score"))
    of_doc = scores.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("profile_id", "score"))).alias("__found"))
    ranked = profiles.agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "profile_id", F.col("min_score").cast("double").alias("least")))).alias("__profiles"))
    rows = texts.select("doc_id").join(of_doc, "doc_id", "left").join(F.broadcast(ranked))  # one row
    of = lambda p: F.struct(F.coalesce(F.element_at("__found", p["profile_id"]), F.lit(0.0)).alias("score"), p["p"].alias("p"), p["profile_id"].alias("profile_id"), p["least"].alias("least"))
    rows = rows.withColumn("__all", F.transform("__profiles", of))
    best = F.array_sort("__all", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when((a["p"] < b["p"]) | ((a["p"] == b["p"]) & (a["profile_id"] < b["profile_id"])), -1).otherwise(1))
    rows = rows.withColumn("__best", F.get(best, 0))
    return rows.select("doc_id", F.when(F.col("__best.score") >= F.col("__best.least"), F.col("__best.profile_id")).alias("profile_id"), F.coalesce("__best.score", F.lit(0.0)).alias("score"), F.map_from_entries(F.transform("__all", lambda x: F.struct(x["profile_id"], x["score"]))).alias("scores"))


def assign_footnotes(footnotes: DataFrame, columns: DataFrame) -> DataFrame:
    """Each footnote with the columns that carry its marker."""
    used = columns.select("doc_id", "column_key", F.explode("footnote_markers").alias("marker")).groupBy("doc_id", "marker").agg(F.sort_array(F.collect_set("column_key")).alias("referenced_columns"))
    return footnotes.join(used, ["doc_id", "marker"], "left").withColumn("referenced_columns", F.coalesce("referenced_columns", F.array().cast("array<string>")))
