"""Importance resampling towards a target distribution, with overlap chunking of long texts.

Features are runs of 1 to N words, hashed to BUCKETS buckets. A bucket's gain compares how often the target's texts and
the documents have it; a document's weight is the sum of its features' gains, and a fixed Gumbel noise for each document
turns the highest scores into a draw without replacement.

Texts of more than CHUNK bytes are cut at word boundaries into chunks that carry the next N - 1 words and own the features
that start before these. Chunks are written once and dealt out, so that no task has a very long text's features; their
counts and weights are summed by document. Features are never rows: words are found in a batch's UTF-8 bytes, and a run's
CRC-32 comes from those of its words (a CRC of a whole is linear in that of its front, so moving it past a word is four
table look-ups). Buckets are counted in a task and summed over tasks, BUCKETS rows each.

Null and empty texts have no features; their weight is 0 and their score the noise. A null doc_id has the noise of an
empty number. Repeated rows are documents of their own. Equal scores stand by doc_id (null last). Words of any length
are whole. An empty table gives no rows, an empty target counts 0 everywhere. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, small_batches, written

#: Words of the longest feature, and buckets.
N, BUCKETS = 3, 10_000
#: Bytes of a chunk; a chunk ends with the word that it has begun.
CHUNK = 32_768
#: Documents with fewer words are never drawn; of a hundred others PERCENT are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Words of more bytes than that are hashed one by one.
SHORT = 63
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32 of a byte; for each length up to SHORT + 1, what each byte of a CRC becomes when so many zero bytes
    follow)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    moved = np.empty((SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        moved[0, k] = np.arange(256, dtype=np.uint32) << (8 * k)
    for n in range(1, SHORT + 2):
        moved[n] = one[moved[n - 1] & 255] ^ (moved[n - 1] >> 8)
    return one, moved


def _past(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs when n more zero bytes follow."""
    moved = _tables()[1]
    step = lambda c, m: moved[m, 0, c & 255] ^ moved[m, 1, (c >> 8) & 255] ^ moved[m, 2, (c >> 16) & 255] ^ moved[m, 3, c >> 24]
    out = step(crc, np.minimum(n, SHORT + 1))
    left = n - (SHORT + 1)
    while (far := np.flatnonzero(left > 0)).size:
        out[far] = step(out[far], np.minimum(left[far], SHORT + 1))
        left -= SHORT + 1
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of lower-cased bytes start and end, and whose they are."""
    inside = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return at, end, np.searchsorted(offsets, at, "right") - 1


def _crcs(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, in steps of one byte for all words that have it."""
    one, out, length = _tables()[0], np.full(len(at), 0xFFFFFFFF, np.uint32), end - at
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[at[i] : end[i]].tobytes()) ^ 0xFFFFFFFF
    left = np.flatnonzero(length <= SHORT)
    for k in range(SHORT):
        left = left[length[left] > k]
        if not left.size:
            break
        c = out[left]
        out[left] = one[(c ^ data[at[left] + k]) & 255] ^ (c >> 8)
    return out ^ np.uint32(0xFFFFFFFF)


def buckets(texts: pa.Array, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whose, bucket) of every feature of a batch's texts, and words by text. own: so many words of a text start a
    feature."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = _LOWER[raw]
    at, end, whose = _words(data, offsets)
    crc = _crcs(data, at, end)
    words = np.bincount(whose, minlength=len(texts))
    starts = np.ones(len(at), bool)
    if own is not None:
        starts = np.arange(len(at)) - np.r_[0, np.cumsum(words)][whose] < own[whose]
        words = np.minimum(words, own)
    # a space and the word, as what follows a run
    gap, space = end - at + 1, np.uint32(zlib.crc32(b" "))
    after = _past(np.full(len(at), space, np.uint32), gap - 1) ^ crc
    run, of, found = crc, [whose[starts]], [crc[starts] % BUCKETS]
    for n in range(1, N):
        if len(at) <= n:
            break
        run = _past(run[:-1], gap[n:]) ^ after[n:]
        whole = starts[:-n] & (whose[:-n] == whose[n:])
        of.append(whose[:-n][whole])
        found.append(run[whole] % BUCKETS)
    return np.concatenate(of), np.concatenate(found), words


def _cut(text: str) -> Iterator[tuple[str, int]]:
    """Chunks of a text with the words that each owns."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at, end, _ = _words(_LOWER[raw], np.array([0, len(raw)]))
    i = 0
    while i < len(at):
        j = max(int(np.searchsorted(at, at[i] + CHUNK)), i + 1)
        yield raw[at[i] : end[min(j + N - 2, len(at) - 1)]].tobytes().decode(), j - i
        i = j
    if not len(at):
        yield "", 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, doc, text in zip(*[b.column(c).to_pylist() for c in ("row", "doc_id", "text")]):
            for k, (part, own) in enumerate(_cut(text)):
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "chunk": pa.array([k], pa.int32()), "text": pa.array([part]), "own": pa.array([own], pa.int64())})


def chunks(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text of documents of one chunk; row, doc_id, chunk, text, own of the others' chunks, a written table)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = rows.where(F.octet_length("text") > CHUNK).withColumn("row", F.monotonically_increasing_id())
    cut = long.mapInArrow(_chunks, "row long, doc_id long, chunk int, text string, own long")
    return rows.where(F.octet_length("text") <= CHUNK), written(cut.repartition("row", "chunk"), "chunks")


def _own(b: pa.RecordBatch) -> np.ndarray | None:
    return b.column("own").to_numpy() if "own" in b.schema.names else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        n += np.bincount(buckets(b.column("text"), _own(b))[1], minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.flatnonzero(n), pa.int32()), "n": pa.array(n[n > 0])})


def counts(*tables: DataFrame) -> DataFrame:
    """bucket, n over all rows of all tables (text, with own or without)."""
    each = [t.select(*[c for c in ("text", "own") if c in t.columns]).mapInArrow(_counted, "bucket int, n long") for t in tables]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket; BUCKETS rows come to the driver, whatever the input."""
    both = documents.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").toPandas().fillna(0)
    s, t = (np.bincount(both["bucket"], both[c], BUCKETS) for c in "st")
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weighed(gain: np.ndarray, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            whose, bucket, words = buckets(b.column("text"), _own(b))
            features = np.bincount(whose, minlength=len(b))
            # sums of whole numbers, exact in doubles up to 2 ** 53
            weight = np.bincount(whose, gain[bucket], len(b)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)], [*keep, "n_words", "n_features", "weight"])

    return run


def weights(short: DataFrame, cut: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, by document."""
    sums = "n_words long, n_features long, weight long"
    whole = short.mapInArrow(_weighed(gain, ["doc_id"]), f"doc_id long, {sums}")
    parts = cut.select("row", "doc_id", "text", "own").mapInArrow(_weighed(gain, ["row", "doc_id"]), f"row long, doc_id long, {sums}")
    parts = parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]).drop("row")
    return whole.unionByName(parts)


def noise(doc_id: Column) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document."""
    short, cut = chunks(docs, text)
    gain = gains(counts(short, cut), counts(*chunks(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")))))
    scored = written(weights(short, cut, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
    wide = scored.where(F.col("n_words") >= LEAST_WORDS)
    n = wide.count() * PERCENT // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    order = numbered(wide, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], *cols)
    drawn = order.select(*cols, F.when(F.col("at") < n, F.col("at") + 1).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < LEAST_WORDS).select(*cols, F.lit(None).cast("long").alias("rank")))
