"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct shingles of SHINGLE words; documents of equal sets are one vertex.

1. Forest. Each of TREES trees sorts the vertices by DEPTH hashes of their signatures; those that agree in the first
   two are a region. In a region, neighbours in the order (they share the longest prefixes) are tried first. What they
   leave in different pieces is compared at the region's own depth, every row with those of all other pieces, so the
   depth at which a row finds its partners adapts to its region: in dense ones most have joined at their longest
   prefix. Rows are compared by sketches of SKETCH hashes (two bits each); a tree gives an edge for each row that joins
   a piece, never all pairs. Regions of more than BLOCK rows are dealt out in pairs of blocks.
2. Clusters. What these edges connect is a cluster: two documents that are linked stand in the same one.
3. Links. Clusters are confirmed on full sets, each set being sent once: exact intersections of every member with all
   others, but for those that links join already. A cluster of more than CHUNK members is dealt out in chunks that
   share PIVOTS members; members that are then outside its main component are compared with all others, in blocks.

A pair at the threshold agrees in the first two hashes of one tree with probability 0.56, of none of TREES with
0.4375 ** TREES (7e-8 for 20). Its sketches agree in fewer than CLOSE = 80 lanes with probability 2e-7; such a pair is
lost unless other edges connect its cluster. All else is exact.

Null and empty texts and texts without words have no shingles and are linked with nothing. Rows with a null id are
linked with nothing, have no component and are kept. Rows that repeat share a component; rows that share an id but
not a text each have their text's. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .shared import small_batches, starts, whole_runs, written

SHINGLE, SHARE = 5, 75
TREES, DEPTH = 20, 6
SKETCH = 128
#: Agreeing lanes of two sketches from which on a pair may be alike: 5.5 standard deviations below the threshold's mean.
CLOSE = 80
#: Rows of a region that are compared in one task, twice as many at most.
BLOCK = 4096
#: Members of a chunk of a large cluster, about, and those that all its chunks share, about.
CHUNK, PIVOTS = 512, 64
#: Members outside the main component, and members, that are compared in one unit, about.
OUT_ROWS, ALL_ROWS = 256, 1024

SKETCHED = [f"s{i}" for i in range(SKETCH * 2 // 64)]

_rng = np.random.default_rng(20_240)
_A = _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)
_C = _rng.integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x5555555555555555)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out += h[i : i + m] * _C[i]
    return np.unique(_mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    v, out = s.astype(np.uint32), np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(v), 4096):
        out = np.minimum(out, (v[at : at + 4096][None, :] * _A[:, None] + _B[:, None]).min(1))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    key = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k0, k1 (a hash of the set), hashes (binary) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            own = [shingles(t) for t in b.column(1).to_pylist()]
            k0, k1 = zip(*map(set_key, own), strict=True) if own else ((), ())
            sig = [signature(s).tobytes() if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "k0", "k1", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, k0 long, k1 long, hashes binary")


def _signatures(b: pa.RecordBatch, column: str = "hashes") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.uint32).reshape(len(b), SKETCH).astype(np.uint64)


def forest(vertices: DataFrame, trees: int = TREES) -> DataFrame:
    """vertices (v, hashes) -> region, rest (the prefix after the region's two hashes), v: a row for each tree."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            h = _signatures(b)
            for t in range(trees):
                p = h[:, t * DEPTH : (t + 1) * DEPTH]
                region = _mix(_mix(p[:, 0] + np.uint64((t + 1) << 32)) + p[:, 1])
                rest = np.zeros(len(b), np.uint64)
                for i in range(2, DEPTH):
                    rest = (rest << np.uint64(16)) | (p[:, i] & np.uint64(0xFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(rest.view(np.int64)), b.column("v")], names=["region", "rest", "v"])

    return vertices.select("v", "hashes").mapInArrow(run, "region long, rest long, v long")


def sketches(vertices: DataFrame) -> DataFrame:
    """vertices (v, n, hashes) -> v, n, s0 .. s3: two bits of each hash."""

    def run(batches):
        for b in batches:
            if len(b):
                bits = ((_signatures(b) >> np.uint64(16)) & np.uint64(3)).reshape(len(b), len(SKETCHED), 32)
                s = (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), *(pa.array(x) for x in s.T.copy())], names=["v", "n", *SKETCHED])

    return vertices.select("v", F.col("n").cast("int").alias("n"), "hashes").mapInArrow(run, "v long, n int, " + ", ".join(f"{x} long" for x in SKETCHED))


def lanes_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    x = s ^ t
    return SKETCH - np.bitwise_count((x | (x >> np.uint64(1))) & _LANES).sum(1, dtype=np.int64)


def _may_link(s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (lanes_of(s, t) >= CLOSE) & (100 * np.minimum(n, m) >= SHARE * np.maximum(n, m))


def pieces(s: np.ndarray, n: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A number for each row of a region's order: rows with the same one are connected by pairs that may be alike.
    Rows of two blocks are compared across them only."""
    m = len(n)
    joined = _may_link(s[1:], s[:-1], n[1:], n[:-1])
    piece = np.r_[0, np.cumsum(~joined)]
    across = block[0] != block.max()
    for i in range(m - 1 if piece[-1] else 0):
        k = np.flatnonzero((piece != piece[i]) & (block != block[i])) if across else i + 1 + np.flatnonzero(piece[i + 1 :] != piece[i])
        k = k[_may_link(s[k], s[i], n[k], n[i])]
        for p in np.unique(piece[k]):
            piece[piece == p] = piece[i]
    return piece


def edges(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for each row b that a piece joins to its smallest vertex a; rows of whole units, in order."""
    unit, v, n, block = (rows.column(c).to_numpy() for c in ("unit", "v", "n", "block"))
    n = n.astype(np.int64)
    s = np.column_stack([rows.column(c).to_numpy() for c in SKETCHED]).view(np.uint64)
    cut = starts(unit)
    label, at = np.zeros(len(v), np.int64), 0
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        label[lo:hi] = pieces(s[lo:hi], n[lo:hi], block[lo:hi]) + at
        at += hi - lo
    order = np.argsort(label, kind="stable")
    first = starts(label[order])
    least = np.repeat(np.minimum.reduceat(v[order], first[:-1]), np.diff(first))
    b = v[order]
    return least[least != b], b[least != b]


def candidates(vertices: DataFrame) -> DataFrame:
    """Edges (a, b) of the trees' pieces."""
    rows = forest(vertices)
    # a vertex by itself in its region is compared with nothing
    shared = written(rows.groupBy("region").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "regions")
    # what grows with the documents is never broadcast
    rows = rows.join(shared.hint("merge"), "region").join(sketches(vertices).hint("merge"), "v")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(unit.alias("unit"), "rest", "v", "n", "block", *SKETCHED)

    def scan(batches):
        for table in whole_runs(batches, "unit"):
            a, b = edges(table)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition(F.col("unit")).sortWithinPartitions("unit", "rest", "v").mapInArrow(scan, "a long, b long").distinct()


def confirmed(v: np.ndarray, own: list[np.ndarray], label: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs whose sets are alike, each with one that asks. Vertices of the same
    label are connected already."""
    size = np.array([len(x) for x in own])
    ids = np.unique(np.concatenate(own), return_inverse=True)[1]
    start = np.r_[0, np.cumsum(size)[:-1]]
    mark = np.zeros(ids.max() + 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    for i in np.flatnonzero(asks):
        open_ = label != label[i]
        if not open_.any():
            continue
        mine = ids[start[i] : start[i] + size[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[ids], start, dtype=np.int64)
        mark[mine] = False
        found = np.flatnonzero(open_ & (100 * both >= SHARE * (size + size[i] - both)))
        for p in np.unique(label[found]):
            yield v[i], v[found[label[found] == p][0]]
        label[np.isin(label, label[found])] = label[i]


def _links(rows: DataFrame) -> DataFrame:
    """rows (unit, v, set, label, asks) -> links (a, b) that the units confirm."""

    def run(batches):
        for table in whole_runs(batches, "unit"):
            unit, v, label, asks = (table.column(c).to_numpy() for c in ("unit", "v", "label", "asks"))
            own = table.column("set").to_pylist()
            cut = starts(unit)
            found = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo > 1:
                    found += confirmed(v[lo:hi], [np.frombuffer(x, np.uint64) for x in own[lo:hi]], label[lo:hi], asks[lo:hi])
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.select("unit", "v", "set", "label", "asks").repartition(F.col("unit")).sortWithinPartitions("unit", "v").mapInArrow(run, "a long, b long")


def members(docs: DataFrame, vertices: DataFrame, clusters: DataFrame, text: str) -> DataFrame:
    """v, cluster, m (its size), set of the clusters' vertices, read from the texts."""
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    wanted = clusters.join(sizes, "label").join(vertices.select("v", "doc", "k0", "k1"), "v").select(F.col("doc").alias("doc_id"), "v", F.col("label").alias("cluster"), "m", "k0", "k1")
    wanted = written(wanted, "wanted")

    def run(batches):
        for b in batches:
            out = [shingles(t) for t in b.column("__text").to_pylist()]
            keys = zip(b.column("k0").to_pylist(), b.column("k1").to_pylist(), strict=True)
            good = pa.array([set_key(s) == k for s, k in zip(out, keys, strict=True)], pa.bool_())  # an id may have several texts
            got = pa.RecordBatch.from_arrays([b.column("v"), b.column("cluster"), b.column("m"), pa.array([s.tobytes() for s in out], pa.binary())], names=["v", "cluster", "m", "set"])
            yield got.filter(good)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return texts.join(wanted.hint("merge"), "doc_id").select("v", "cluster", "m", "k0", "k1", "__text").mapInArrow(run, "v long, cluster long, m long, set binary").dropDuplicates(["v"])


def _part(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "v"), n)


def chunk_links(rows: DataFrame) -> DataFrame:
    """Links within clusters, and within the chunks of large ones."""
    rows = rows.withColumn("chunks", F.ceil(F.col("m") / CHUNK))
    pivot = (F.col("chunks") > 1) & (_part(F.col("m"), 1) < PIVOTS)
    chunk = F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(_part(F.col("chunks"), 2))))
    rows = rows.withColumn("chunk", chunk)
    return _links(rows.select(F.xxhash64("cluster", "chunk").alias("unit"), "v", "set", F.col("v").alias("label"), F.lit(True).alias("asks")))


def outside_links(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of large clusters' members outside the main component with members of other components."""
    rows = rows.where(F.col("m") > CHUNK).join(labels.select("v", F.col("label").alias("__l")), "v", "left").withColumn("label", F.coalesce("__l", "v"))
    counts = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    mains = counts.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("rows"), F.max("k").alias("most")).where("rows > most")
    mains = written(mains.select("cluster", "main", F.ceil((F.col("rows") - F.col("most")) / OUT_ROWS).alias("outs"), F.ceil(F.col("rows") / ALL_ROWS).alias("alls")), "mains")
    rows = rows.join(mains, "cluster")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asks = rows.where("label != main").withColumn("o", _part(F.col("outs"), 3)).withColumn("a", every(F.col("alls"))).withColumn("asks", F.lit(True))
    # an outsider that asks in a unit isn't there a second time
    held = rows.withColumn("a", _part(F.col("alls"), 4)).withColumn("o", every(F.col("outs"))).where((F.col("label") == F.col("main")) | (F.col("o") != _part(F.col("outs"), 3))).withColumn("asks", F.lit(False))
    return _links(asks.unionByName(held).withColumn("unit", F.xxhash64("cluster", "o", "a")))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = written(sets(docs, text), "sets")
    alike = rows.where("doc_id is not null and n_shingles > 0").groupBy("k0", "k1").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("hashes").alias("hashes"))
    vertices = written(alike.withColumn("v", F.monotonically_increasing_id()), "vertices")
    clusters = components(candidates(vertices))
    held = written(members(docs, vertices, clusters, text), "members")
    links = written(chunk_links(held), "links")
    label = components(links)
    more = written(outside_links(held, label), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))
    named = vertices.select("k0", "k1", "doc", "v").join(label, "v", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc").alias("least"))
    known = written(named.join(least, "label", "left").select("k0", "k1", F.coalesce("least", "doc").alias("component_id")), "known")
    linked = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "k0", "k1").join(known, ["k0", "k1"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
