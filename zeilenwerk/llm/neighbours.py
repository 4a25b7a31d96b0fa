"""Approximate nearest neighbours by cosine: probed lists, scanned with adaptive dimension sampling.

Index. Centres of the lists (square root of the rows, LISTS at most: 16 million rows) are fitted on at most FIT_ROWS
vectors (those of the lowest hash of their id); every row is then put into the list of its nearest centre. How many
lists a query probes is chosen on that sample too: as many as hold TARGET of the true neighbours there.

Scan. Unit vectors are rotated by a random orthogonal matrix and compared in blocks of COLUMNS dimensions. After each
block a hypothesis test drops the candidates whose partial distance is too long for their whole distance to be
within the query's current limit (the bound is EPS standard deviations wide). A query comes with a limit, the distance
of its k-th nearest in the sample, which holds in every list and block it meets; within one, the limit tightens after
each block of columns by the whole distances of the candidates that lead. What is left is measured by the original
vectors in double precision.

A list is cut into blocks of about ROWS rows and the queries that probe it into groups of about ROWS, so a frequent
vector, whose copies share a list, is many units of work. A unit gives its best k for each query.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no
part, nor do rows with a null id. Rows with a query's own id are no candidates for it; repeated rows are candidates
each, and a repeated query row is one query. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

LISTS, FIT_ROWS, FIT_QUERIES = 4096, 20_000, 400
TARGET, EPS, COLUMNS, ROWS = 0.985, 2.1, 16, 256
#: Below so many rows there is one list.
SMALL = 2000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Index:
    def __init__(self, ids: np.ndarray, sample: np.ndarray, n: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.k, self.ids, self.sample = sample.shape[1], k, ids, unit(sample).astype(np.float32)
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        x = unit(sample)
        lists = 1 if n < SMALL else int(min(LISTS, n**0.5, len(x) / 4))
        self.centres = x[rng.choice(len(x), lists, replace=False)] if lists > 1 else np.zeros((1, self.dim))
        for _ in range(12 if lists > 1 else 0):
            near = self.near(x, 1)[:, 0]
            for c in range(lists):
                own = x[near == c]
                if len(own) and np.abs(m := own.sum(0)).max() > 1e-12:
                    self.centres[c] = m / np.linalg.norm(m)
        self.probes = self.enough(x, k, rng)

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]

    def limit(self, vec_id: int, x: np.ndarray) -> float:
        """The squared distance within which a query's k nearest lie, as far as the sample tells."""
        s = self.sample @ x.astype(np.float32)
        s = s[self.ids != vec_id]
        return 2 - 2 * float(np.partition(s, len(s) - self.k)[len(s) - self.k]) + 1e-5 if len(s) >= self.k else np.inf

    def enough(self, x: np.ndarray, k: int, rng: np.random.Generator) -> int:
        lists = len(self.centres)
        if lists == 1:
            return 1
        at = self.near(x, 1)[:, 0]
        q = rng.choice(len(x), min(FIT_QUERIES, len(x)), replace=False)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        best = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[q] @ self.centres.T), axis=1, kind="stable"), axis=1)
        ranks = np.sort(np.take_along_axis(place, at[best], 1).ravel())
        return int(min(lists, ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))] + 1))


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def fit(vectors: DataFrame, k: int) -> Index | None:
    """vectors: vec_id, v (array of doubles), usable ones."""
    rows = vectors.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(FIT_ROWS).select("vec_id", "v").toPandas()
    if not len(rows):
        return None
    lengths = rows["v"].map(len)
    rows = rows[lengths == int(lengths.mode()[0])]
    return Index(rows["vec_id"].to_numpy(), np.stack([np.asarray(x, float) for x in rows["v"]]), vectors.count(), k)


def best(ids: np.ndarray, x: np.ndarray, z: np.ndarray, q_id: int, q: np.ndarray, qz: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block to a query, by scanning columns and dropping candidates early. limit: what is farther
    than this is none of the k."""
    dim, alive = z.shape[1], np.flatnonzero(ids != q_id)
    if not len(alive):
        return ids[:0], np.zeros(0)
    part, seen = np.zeros(len(alive)), 0
    while seen < dim and len(alive) > k:
        to = min(dim, seen + COLUMNS)
        part += ((z[alive, seen:to] - qz[seen:to]) ** 2).sum(1)
        seen = to
        # those that lead are measured whole
        lead = np.argpartition(part, k - 1)[:k]
        limit = min(limit, float(((z[alive[lead]] - qz) ** 2).sum(1).max()))
        slack = (1 + EPS / seen**0.5) ** 2 * seen / dim if seen < dim else 1
        stay = part <= limit * slack + 1e-9
        stay[lead] = True  # k stay, should the lists that are probed hold no nearer ones
        alive, part = alive[stay], part[stay]
    y = x[alive]
    cos = (y * q).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((q * q).sum()))
    order = np.lexsort((ids[alive], -cos))[:k]
    return ids[alive][order], cos[order]


def search(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    index = fit(rows, k)
    out = "query_id bigint, vec_id bigint, score double"
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def assign(batches):
        for p in batches:
            p = p[p["v"].map(len) == index.dim]
            if len(p):
                x = unit(np.stack(p["v"].to_numpy()))
                lists = index.near(x, 1)[:, 0]
                probes = [index.near(x[i : i + 1], index.probes)[0] if q else None for i, q in enumerate(p["is_query"])]
                limits = [index.limit(i, y) if q else None for i, y, q in zip(p["vec_id"], x, p["is_query"], strict=True)]
                yield pd.DataFrame({"vec_id": p["vec_id"], "v": p["v"], "list": lists.astype(np.int32), "probes": probes, "limit": np.array(limits, float)})

    placed = written(rows.mapInPandas(assign, "vec_id bigint, v array<double>, list int, probes array<int>, limit double"), "lists")
    asking = placed.where("probes is not null").select("vec_id", "v", "limit", F.explode("probes").alias("list"))
    # one row a list, LISTS at most
    parts = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    groups = asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("groups"))
    shape = F.broadcast(parts.join(groups, "list"))
    some = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.join(shape, "list").select("list", some("blocks").alias("block"), every("groups").alias("group"), "vec_id", "v", F.lit(0.0).alias("limit"), F.lit(False).alias("asks"))
    asked = asking.dropDuplicates(["vec_id", "list"]).join(shape, "list").select("list", every("blocks").alias("block"), some("groups").alias("group"), "vec_id", "v", "limit", F.lit(True).alias("asks"))

    def scan(p: pd.DataFrame) -> pd.DataFrame:
        asks = p["asks"].to_numpy()
        ids, x = p["vec_id"].to_numpy(), np.stack(p["v"].to_numpy())
        z = unit(x) @ index.rotation
        c = np.flatnonzero(~asks)
        c = c[np.argsort(ids[c], kind="stable")]
        ci, cx, cz = ids[c], x[c], z[c]
        limit = p["limit"].to_numpy()
        found = [(ids[i], *best(ci, cx, cz, ids[i], x[i], z[i], k, limit[i])) for i in np.flatnonzero(asks)]
        q = np.concatenate([np.full(len(a), i) for i, a, _ in found]) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": q.astype(np.int64), "vec_id": np.concatenate([a for _, a, _ in found]) if found else q, "score": np.concatenate([s for *_, s in found]) if found else q.astype(float)})

    near = held.unionByName(asked).groupBy("list", "block", "group").applyInPandas(scan, out)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
