"""Catalogues of columns as tables: a new layout is a new file, not code.

A profile file (JSON, or YAML where a YAML reader is installed) has id, name, fassung, priority, detection (min_score,
keywords, negative_keywords: texts, or text and weight), columns and note_columns (key, address, group, subgroup, label,
abbrev, aggregate_group, aliases, footnotes), row_fields (key, label, aliases) and footnotes (marker, text). What is
missing has its default. Files are few and small; they are read by Spark, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_COLUMN = "key string, address string, group string, subgroup string, label string, abbrev string, aggregate_group string, aliases array<string>, footnotes array<string>"
_NAMES = "array<struct<" + ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ") for x in _COLUMN.split(","))) + ">>"
_WORDS = "array<struct<text: string, weight: double>>"
SCHEMA = f"id string, name string, fassung string, priority int, detection struct<min_score: double, keywords: {_WORDS}, negative_keywords: {_WORDS}>, columns {_NAMES}, note_columns {_NAMES}, row_fields array<struct<key: string, label: string, aliases: array<string>>>, footnotes array<struct<marker: string, text: string>>"


@dataclass
class Catalogue:
    """profiles (profile_id, name, fassung, priority, min_score, source_file), keywords (profile_id, text, weight),
    columns (profile_id, place, column_key, address, group_name, subgroup, label, abbrev, aggregate_group, aliases,
    footnotes, is_note), row_fields (profile_id, place, field, label, aliases), footnotes (profile_id, marker, text)."""

    profiles: DataFrame
    keywords: DataFrame
    columns: DataFrame
    row_fields: DataFrame
    footnotes: DataFrame


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File texts as JSON, keywords as text and weight, scalars of lists as texts."""
    import json

    def parsed(path: str, text: str) -> dict:
        if path.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text)

    def word(x) -> dict:
        return {"text": str(x.get("text", "")), "weight": float(x.get("weight", 1.0))} if isinstance(x, dict) else {"text": str(x), "weight": 1.0}

    for b in batches:
        out = []
        for path, text in zip(b["path"], b["value"], strict=True):
            p = parsed(path, text)
            found = p.get("detection") or {}
            p["detection"] = {"min_score": found.get("min_score", 3.0)} | {k: [word(x) for x in found.get(k) or []] for k in ("keywords", "negative_keywords")}
            out.append(json.dumps(p, default=str))
        yield pd.DataFrame({"path": b["path"], "json": out})


def load(spark: SparkSession, path: str) -> Catalogue:
    """The profiles of a folder (or of paths with wildcards)."""
    ship(spark)
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{json,yaml,yml}").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = files.mapInPandas(_as_json, "path string, json string").select("path", F.from_json("json", SCHEMA).alias("p")).select("path", "p.*")
    return of(raw)


def of(raw: DataFrame) -> Catalogue:
    """The tables of nested profiles (SCHEMA, with path)."""
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    p = raw.withColumn("profile_id", F.col("id"))
    profiles = p.select("profile_id", text(F.col("name")).alias("name"), text(F.col("fassung"), "unbekannt").alias("fassung"), F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("detection.min_score", F.lit(3.0)).alias("min_score"), F.col("path").alias("source_file"))
    signed = lambda c, sign: p.select("profile_id", F.inline(c)).select("profile_id", text(F.col("text")).alias("text"), (sign * F.coalesce("weight", F.lit(1.0))).alias("weight"))
    keywords = signed("detection.keywords", 1).unionByName(signed("detection.negative_keywords", -1))
    none = F.array().cast("array<string>")
    tagged = lambda c, note: F.transform(F.coalesce(c, F.array().cast(_NAMES)), lambda x: x.withField("is_note", F.lit(note)))
    every = p.select("profile_id", F.posexplode(F.concat(tagged(F.col("columns"), False), tagged(F.col("note_columns"), True))).alias("place", "c")).select("profile_id", "place", "c.*")
    columns = every.select(
        "profile_id", "place", F.col("key").alias("column_key"), text(F.col("address")).alias("address"), text(F.col("group")).alias("group_name"), text(F.col("subgroup")).alias("subgroup"), F.coalesce("label", "key").alias("label"),
        text(F.col("abbrev")).alias("abbrev"), text(F.col("aggregate_group"), "SONSTIGE").alias("aggregate_group"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("footnotes", none).alias("footnotes"), "is_note",
    )
    fields = p.select("profile_id", F.posexplode("row_fields").alias("place", "f")).select("profile_id", "place", F.col("f.key").alias("field"), F.coalesce("f.label", "f.key").alias("label"), F.coalesce("f.aliases", none).alias("aliases"))
    notes = p.select("profile_id", F.inline("footnotes")).select("profile_id", text(F.col("marker")).alias("marker"), text(F.col("text")).alias("text"))
    return Catalogue(profiles, keywords, columns, fields, notes)


def display(address: Column, group: Column, subgroup: Column, label: Column) -> Column:
    """A catalogue column's text: its address before group, subgroup and label."""
    names = F.concat_ws(" / ", *[F.nullif(x, F.lit("")) for x in (group, subgroup, label)])
    return F.when(address != "", F.btrim(F.concat(address, F.lit(" "), names))).otherwise(names)
