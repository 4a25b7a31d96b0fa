"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are words, as 64-bit hashes. A token counts once a document, but scores wherever it stands. Its count over all documents is the Dirichlet prior, its counts in toxic and clean labelled documents the evidence; its weight is
its log-odds moved towards 0 by SHRINK standard deviations, so that what rests on few documents weighs little. Tokens
whose weight is 0 are no part of the model. A word scores its weight less DRIFT, so that ordinary text scores below 0. One linear scan finds every maximal-scoring segment of a text (Ruzzo and Tompa's
algorithm).

Extreme values. Clean text of n words has a segment of a score of s or more with probability
1 - exp(-K n exp(-lambda s)): lambda is the root of E[exp(lambda * score)] = 1 over clean documents' words, K follows
from the mean of clean documents' best segments. A segment is significant if it exceeds what n clean words are expected
to hold once: lambda s > log(K n). A text's evidence is the negative logarithm of its best segment's probability, and
the sum of its significant segments' excesses and their number (both as log(1 + x)); a logistic curve makes it a
probability.

The evidence comes from LABELS labelled documents at most and the curve from FIT_ROWS of them (those with the lowest
hashes of their ids), each scored without its own counts. Counts of the prior cover all documents. Texts are read whole.

Labels: rows with a null id or label teach nothing; if an id has several, it's toxic if one says so. Null and empty
texts have no token and the least score that there is. With no toxic or no clean label every score is the share of
toxic labels (0 without labels). An empty table gives no rows. Columns other than doc_id and text never count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Labelled documents that give evidence, at most, and those that the curve is fitted on.
LABELS, FIT_ROWS = 200_000, 20_000
#: Chosen by cross-validation within the labels that may teach; no held-out label was read.
DRIFT, SHRINK = 0.6, 1.5
#: Pseudo-tokens of the prior for each token of the toxic class, LEAST at least.
PRIOR, LEAST = 1.0, 1000.0
THRESHOLD = 0.7
#: Documents whose tokens are counted at a time.
COUNTED = 2000
#: ASCII marks part tokens; letters become lower case.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct word at each place, the distinct words' tokens)."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return at, np.fromiter(map(xxh3_64_intdigest, known), np.uint64, len(known)).view(np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; not for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def weights(t: np.ndarray, c: np.ndarray, prior: np.ndarray, n_t: float, n_c: float) -> np.ndarray:
    """Log-odds with a Dirichlet prior of t among n_t against c among n_c, SHRINK standard deviations nearer to 0."""
    total = max(LEAST, PRIOR * n_t)
    a = prior * total
    x, y = t + a, c + a
    odds = np.log(x / (n_t + total - x)) - np.log(y / (n_c + total - y))
    return np.sign(odds) * np.maximum(0.0, np.abs(odds) - SHRINK * np.sqrt(1 / x + 1 / y))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment as (start, end, score); linear but for the search among open ones."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    runs = np.split(up, np.flatnonzero(np.diff(up) > 1) + 1)
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    for run in runs:
        s, e = int(run[0]), int(run[-1]) + 1
        left, right = total[s], total[e]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                break
            s, left = out[j][0], out[j][2]
            del out[j:]
        out.append((s, e, left, right))
    return [(s, e, float(b - a)) for s, e, a, b in out]


def features(s: np.ndarray, n: int, log_k: float) -> tuple[float, float, float]:
    """The evidence of a text of n words with segments that score s, in units of the scale."""
    if not len(s):
        return 0.0, 0.0, 0.0
    over = s - log_k - np.log(n)
    chance = -np.expm1(-np.exp(-np.clip(over.max(), -30, 300)))
    good = over[over > 0]
    return float(min(-np.log(chance), 40.0)), float(np.log1p(good.sum())), float(np.log1p(len(good)))


def log_k_of(best: np.ndarray, n: np.ndarray) -> float:
    """log K, from the best segments of clean texts of n words: their mean is log(K n) + Euler's constant."""
    return float((best - np.log(n)).mean() - np.euler_gamma) if len(n) else 0.0


def scale_of(clean: np.ndarray, n: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1, from scores of clean text's words and how often each occurs."""
    p, lo, hi = n / max(n.sum(), 1e-9), 1e-2, 20.0
    f = lambda x: float(np.dot(p, np.exp(np.minimum(x * clean, 50.0)))) - 1
    if not len(p) or f(lo) > 0:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(lo, 5.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve with no coefficient below 0: more evidence never lowers a score."""
    use = list(range(x.shape[1]))
    while True:
        b = logistic(x[:, use], y)
        if not use or b[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(u + 1 for u in use)]] = b
            return out
        del use[int(b[1:].argmin())]


@dataclass
class Model:
    """token: sorted; weight: of each."""

    token: np.ndarray
    weight: np.ndarray
    scale: float = 1.0
    log_k: float = 0.0
    curve: np.ndarray | None = None
    share: float = 0.0

    def of(self, ids: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """The weights of tokens, 0 for those that aren't in the model."""
        values = self.weight if values is None else values
        if not len(self.token):
            return np.zeros(ids.shape)
        i = np.minimum(np.searchsorted(self.token, ids), len(self.token) - 1)
        return np.where(self.token[i] == ids, values[i], 0.0)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        at, ids = tokens(text)
        return len(at), segments(self.of(ids)[at] - DRIFT)

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return self.share
        n, found = self.segments(text)
        x = features(np.array([x[2] for x in found]) * self.scale, n, self.log_k)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + np.dot(self.curve[1:], x), -30, 30))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """The significant segments, as token numbers."""
        n, found = self.segments(text)
        return [x for x in found if x[2] * self.scale > self.log_k + np.log(n)]


def _over(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict]]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = make()
        for b in batches:
            for out in step(b.to_pydict()):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        for out in step({}):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, __y of the labels that may teach, one an id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("__y"))
    return written(known.where(~held_out(F.col("doc_id"))), "labels")


def evidence(docs: DataFrame, sample: DataFrame, text: str) -> DataFrame:
    """token, n, t, c: documents, toxic and clean labelled ones that hold the token. sample: doc_id, __y."""
    rows = docs.select("doc_id", F.col(text).alias("__text")).join(F.broadcast(sample), "doc_id", "left")

    def count():
        held: list[tuple[np.ndarray, int, int]] = []

        def close():
            if held:
                ids = np.concatenate([x[0] for x in held])
                t, c = (np.repeat([x[i] for x in held], [len(x[0]) for x in held]) for i in (1, 2))
                token, back = np.unique(ids, return_inverse=True)
                sums = [np.bincount(back, w, len(token)).astype(np.int64) for w in (None, t, c)]
                held.clear()
                for i in range(0, len(token), 1 << 14):
                    yield dict(zip(("token", "n", "t", "c"), (x[i : i + (1 << 14)] for x in (token, *sums)), strict=True))

        def step(b):
            for x, y in zip(b.get("__text", ()), b.get("__y", ()), strict=True):
                held.append((tokens(x)[1], int(y == 1), int(y == 0)))
            if not b or len(held) >= COUNTED:
                yield from close()

        return step

    return _over(rows.select("__text", "__y"), count, "token bigint, n bigint, t bigint, c bigint").groupBy("token").agg(*[F.sum(x).alias(x) for x in ("n", "t", "c")])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    small_batches(docs.sparkSession)
    none = np.zeros(0)
    known = _known(labels)
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS), "sample")  # its bound lets it be broadcast
    table = written(evidence(docs, sample, text), "tokens")
    n_all, n_t, n_c = (float(x or 0) for x in table.agg(F.sum(F.col("n") + 0.5), F.sum("t"), F.sum("c")).first())
    if not n_t or not n_c:
        return Model(none.astype(np.int64), none, share=float(known.agg(F.avg("__y")).first()[0] or 0.0))
    # of the tokens of labelled documents those that weigh something: the sample bounds them
    total = max(LEAST, PRIOR * n_t)
    x, y = (F.col(k) + (F.col("n") + 0.5) / n_all * total for k in ("t", "c"))
    odds = F.log(x / (n_t + total - x)) - F.log(y / (n_c + total - y))
    held = table.where(F.col("t") + F.col("c") > 0).where(F.abs(odds) > SHRINK * F.sqrt(1 / x + 1 / y)).orderBy("token").toPandas()
    t, c, prior = (held[k].to_numpy(float) for k in ("t", "c", "n"))
    prior = (prior + 0.5) / n_all
    model = Model(held["token"].to_numpy(np.int64), weights(t, c, prior, n_t, n_c).astype(np.float32))
    some = docs.select("doc_id", F.col(text).alias("__text")).join(F.broadcast(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)), "doc_id")
    t, c, prior = t.astype(np.float32), c.astype(np.float32), prior.astype(np.float32)

    def alone():
        def step(b):
            if not b:
                return
            out = {"y": [], "scores": []}
            for x, y in zip(b["__text"], b["__y"], strict=True):
                at, ids = tokens(x)
                mine = [model.of(ids, v) for v in (t, c, prior)]
                w = weights(np.maximum(mine[0] - y, 0.0), np.maximum(mine[1] - 1 + y, 0.0), np.maximum(mine[2], 1e-12), n_t - len(ids) * y, n_c - len(ids) * (1 - y))
                out["y"].append(float(y))
                out["scores"].append((np.where(mine[2] > 0, w, 0.0)[at] - DRIFT).astype("<f4").tobytes())
            yield out

        return step

    each = written(_over(some.select("__text", "__y"), alone, "y double, scores binary"), "alone")  # FIT_ROWS rows at most

    def spread():
        def step(b):
            for y, s in zip(b.get("y", ()), b.get("scores", ()), strict=True):
                if not y:
                    v, n = np.unique(np.rint(np.frombuffer(s, "<f4") * 50).astype(np.int64), return_counts=True)
                    yield {"v": v, "n": n}

        return step

    seen = np.array(_over(each, spread, "v bigint, n bigint").groupBy("v").agg(F.sum("n")).collect(), float).reshape(-1, 2)
    model.scale = scale_of(seen[:, 0] / 50, seen[:, 1])
    scale = model.scale

    def found():
        def step(b):
            for y, s in zip(b.get("y", ()), b.get("scores", ()), strict=True):
                own = np.array([x[2] for x in segments(np.frombuffer(s, "<f4").astype(float))]) * scale
                yield {"y": [y], "n": [len(s) // 4], "best": [float(own.max()) if len(own) else 0.0], "s": [own]}

        return step

    held = written(_over(each, found, "y double, n bigint, best double, s array<double>"), "segments")
    best = np.array([tuple(r) for r in held.where("y = 0 and n > 0").select("best", "n").collect()], float).reshape(-1, 2)
    model.log_k = log_k = log_k_of(best[:, 0], best[:, 1])

    def summed():
        def step(b):
            if b:
                x = [(y, *features(np.array(s), n, log_k)) for y, n, s in zip(b["y"], b["n"], b["s"], strict=True)]
                yield dict(zip("yabc", zip(*x, strict=True), strict=True))

        return step

    fitted = np.array(_over(held.select("y", "n", "s"), summed, "y double, a double, b double, c double").collect(), float).reshape(-1, 4)
    if not len(fitted):
        return Model(none.astype(np.int64), none, share=float(n_t > 0))
    model.curve, model.share = rising(fitted[:, 1:], fitted[:, 0]), float(fitted[:, 0].mean())
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(x) for x in b.column(text).to_pylist()], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
