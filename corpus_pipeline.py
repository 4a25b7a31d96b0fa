"""Five stages from raw documents to encoded ones: toxicity, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; null rows, extra columns and repeated rows are treated
as the operators say. ORACLE_SQL is None: SQL expresses none of the learned or hashed stages; tests/llm compares each
stage with a plain version of it, on its predecessor's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeilenwerk.llm import bpe, mixing, neardup, pii, queries, toxicity
from zeilenwerk.llm.shared import table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labelled ones among docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that repeat a kept document's id, one. Rows with a null
    id stay, as they are linked with nothing."""
    kept = written(neardup.dedup(docs).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind, as in [EMAIL]. Texts without spans stay as they are,
    null ones too."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken by words, rounded up or down by a hash so that each source
    gives its target on average. Those rounded to 0 go."""
    return mixing.resampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, ids (little-endian unsigned 32-bit integers) and what they decode to."""
    return bpe.encode(docs, queries.vocabulary(), decoded="decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one),
    ("personal data", redact),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
