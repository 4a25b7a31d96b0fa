"""Foci carried forward on a stream of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Row kinds after which no focus holds.
RESETS = ("summe", "uebertrag")
_OUT = "doc_id string, page_index int, row_seq int, focus string, focus_label string"
_STATE = "page_index int, code string, label string"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    page, code, label = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["page_index", "row_seq"], kind="stable")
    out = []
    for p, n, kind, own, name in zip(rows["page_index"], rows["row_seq"], rows["kind"], rows["code"], rows["code_label"], strict=True):
        if p != page or kind in RESETS:
            page, code, label = int(p), None, None
        if kind not in RESETS and isinstance(own, str) and own:
            code, label = own, name if isinstance(name, str) else ""
        out.append((key[0], int(p), int(n), code or "", label or ""))
    state.update((page, code, label))
    state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame(out, columns=["doc_id", "page_index", "row_seq", "focus", "focus_label"])


def carried(rows: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """rows (doc_id, page_index, row_seq, kind, code, code_label: null or empty where a row names none) of a stream with the
    focus that holds: the last one named on the page since a sum row. A document's state is one code; it holds over
    micro-batches and is forgotten when no row came for `timeout_ms`. A document's rows arrive in order from batch to
    batch; within a batch they may stand anyhow."""

    def run(key, batches, state):
        return _carry(key, batches, state, timeout_ms)

    own = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.col("row_seq").cast("int").alias("row_seq"), "kind", "code", "code_label")
    return own.groupBy("doc_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def carried_at_once(rows: DataFrame) -> DataFrame:
    """The same of a table."""
    order = W.partitionBy("doc_id", "page_index").orderBy("row_seq")
    named = F.when(F.col("kind").isin(*RESETS), F.struct(F.lit("").alias("code"), F.lit("").alias("label"))).when(F.coalesce("code", F.lit("")) != "", F.struct(F.col("code").alias("code"), F.coalesce("code_label", F.lit("")).alias("label")))
    held = F.last(named, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__held", held).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.col("row_seq").cast("int").alias("row_seq"), F.coalesce("__held.code", F.lit("")).alias("focus"), F.coalesce("__held.label", F.lit("")).alias("focus_label"))
