"""Repeated passages by a common-prefix interval tree over an enhanced, sparse suffix array.

Two kinds of passages are found. BYTES: a string of 400 bytes that starts at two places, in one text or in two; every
byte that one covers goes. WORDS: a run of more than 50 words that stands in two documents; they are counted. Texts are
read whole, and nothing matches across texts. Equal texts are handled as one (a copy is a repeat of its whole).

1. Anchors. Each window of `least` symbols (bytes or words) holds the smallest hash of its `gram`-symbol strings; the
   places of these minima are the text's anchors. Equal windows have equal anchors at equal places, so every repeat
   contains an anchor that occurs twice.
2. Suffixes. For each anchor that occurs twice or more, its occurrences' suffixes (`least` symbols from the anchor)
   are sorted together with what stands before them: a suffix array of these places, with the common prefixes of its
   neighbours. It is dealt out by anchors, so an anchor's occurrences stand together.
3. Interval tree. A stack scan over the common prefixes gives the intervals: all occurrences that share r symbols to
   the right. In each, the occurrences' left sides are compared in their order, by range minima over the common
   prefixes of all left sides; those that share `least` - r symbols to the left, too, are a maximal repeat group
   (`groups` lists them). Of each occurrence the furthest extents to both sides are kept; as all of them contain the
   anchor, their union is one interval.
4. An anchor of more than GROUP occurrences is no task's. Its occurrences are divided by what the windows of a range
   of offsets have in common (their intersection). Those that agree in all that the range covers (its union), too, are
   decided: they repeat it, and one of them stays as a partner for the others. Single ones have no partner. Where
   others are left, the range is cut into SPLIT parts; so an occurrence goes on only where the range crosses its
   passage's end, and the number of rounds is the logarithm of a window's length.

Null and empty texts have no bytes and nothing removed. Null ids and repeated rows keep their own rows; rows that
repeat are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import small_batches, starts, whole_runs, written

#: Symbols that are hashed at a time.
CHUNK = 1 << 19
#: Occurrences of an anchor that stand in one task: some 70 MB.
GROUP = 100_000
#: Parts that a range of offsets is cut into in each round.
SPLIT = 8
#: Words longer than this stand as their hash in suffixes.
LONG_WORD = 32
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: list[np.ndarray] = []


@dataclass(frozen=True)
class Kind:
    """least: symbols of a repeat; gram: of an anchor; across: whether a repeat needs two texts."""

    name: str
    least: int
    gram: int
    across: bool

    @property
    def before(self) -> int:
        """Symbols that a window may hold before its anchor."""
        return self.least - self.gram

    def size(self, side: bytes, n: int) -> int:
        """Whole symbols in the first n bytes of a side."""
        return side.count(b" ", 0, n) if self.across else n

    def head(self, side: Column, n: Column) -> Column:
        """A side's first n symbols."""
        return F.call_function("substring_index", side.cast("string"), F.lit(" "), n) if self.across else F.substring(side, F.lit(1), n)


BYTES, WORDS = Kind("bytes", 400, 128, False), Kind("words", 51, 16, True)
KINDS = (BYTES, WORDS)


def _powers() -> list[np.ndarray]:
    if not _POW:
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        for base in (_M, inverse):
            p = np.full(CHUNK + 2 * BYTES.least, base, np.uint64)
            p[0] = 1
            _POW.append(np.cumprod(p, dtype=np.uint64))
    return _POW


def _slide(x: np.ndarray, w: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best over every w values that follow each other."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    y = np.full(rows * w, pad, np.uint64)
    y[: len(x)] = x
    y = y.reshape(rows, w)
    ahead = best.accumulate(y, axis=1).ravel()
    back = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's anchors; symbols are its bytes or its words' hashes."""
    found: list[np.ndarray] = []
    at: list[np.ndarray] = []
    power, inverse = _powers()
    gram, w = kind.gram, kind.before + 1
    for start in range(0, len(symbols) - kind.least + 1, CHUNK):
        x = symbols[start : start + CHUNK + kind.least - 1].astype(np.uint64) + np.uint64(1)
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
        h = (c[gram:] - c[:-gram]) * inverse[: len(x) - gram + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        least = _slide(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
        pad = np.zeros(w - 1, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), w, np.maximum, 0)
        k = np.flatnonzero(h == most)
        found.append(h[k])
        at.append(k + start)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, i = np.unique(np.concatenate(at), return_index=True)
    return np.concatenate(found)[i], at


def common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The (common prefix, first, last) intervals of a suffix array, by one scan with a stack."""
    out, stack = [], [(0, 0)]
    for i, r in enumerate([*lcp, 0], 1):
        first = i - 1
        while stack[-1][0] > r:
            top, first = stack.pop()
            out.append((top, first, i - 1))
        if stack[-1][0] < r:
            stack.append((r, first))
    return out


def _least(x: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of a < b that gives the smallest of x[a:b]."""
    rows = [x]
    while len(rows[-1]) > 1 << (len(rows) - 1):
        step = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), x.dtype)
        for k in np.unique(level):
            i = level == k
            out[i] = np.minimum(rows[k][a[i]], rows[k][b[i] - (1 << k)])
        return out

    return of


def extents(right: list[bytes], left: list[bytes], rid: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes of one anchor: symbols to its left and to its right that repeats cover (-1: none)."""
    m = len(right)
    l, r = np.full(m, -1), np.full(m, -1)  # noqa: E741
    if m == 2:
        a, b = kind.size(left[0], common(*left)), kind.size(right[0], common(*right))
        if a + b >= kind.least and not (kind.across and rid[0] == rid[1]):
            l[:], r[:] = a, b
        return l, r
    lcp = [kind.size(a, common(a, b)) for a, b in pairwise(right)]
    by_left = np.array(sorted(range(m), key=left.__getitem__))
    near = np.array([kind.size(left[i], common(left[i], left[j])) for i, j in pairwise(by_left.tolist())])
    if max(lcp) + near.max() < kind.least:
        return l, r
    rank, least = np.argsort(by_left), _least(near)
    for share, first, last in intervals(lcp):
        need = kind.least - share
        if need > near.max():
            continue
        x = np.sort(rank[first : last + 1])
        who = by_left[x]
        # the next row on either side that counts as a partner
        run = starts(rid[who]) if kind.across else np.arange(len(x) + 1)
        own = np.repeat(np.arange(len(run) - 1), np.diff(run))
        best = np.full(len(x), -1)
        k = np.flatnonzero(own > 0)
        best[k] = least(x[run[own[k]] - 1], x[k])
        k = np.flatnonzero(own < len(run) - 2)
        best[k] = np.maximum(best[k], least(x[k], x[run[own[k] + 1]]))
        k = best >= need
        l[who[k]] = np.maximum(l[who[k]], best[k])
        r[who[k]] = np.maximum(r[who[k]], share)
    return l, r


def groups(right: list[bytes], left: list[bytes], kind: Kind = BYTES) -> list[tuple[int, int, list[int]]]:
    """The maximal repeat groups of one anchor's sorted suffixes: (symbols left, symbols right, all occurrences). A group
    is maximal to the right if its occurrences don't all lie in one child of the interval, and to the left by the same
    test on the left sides."""
    out = []
    lcp = [kind.size(a, common(a, b)) for a, b in pairwise(right)]
    for r, first, last in intervals(lcp):
        order = sorted(range(first, last + 1), key=left.__getitem__)
        for n, lo, hi in intervals([kind.size(left[i], common(left[i], left[j])) for i, j in pairwise(order)]):
            own = sorted(order[lo : hi + 1])
            if n + r >= kind.least and min(lcp[own[0] : own[-1]]) == r:
                out.append((n, r, own))
    return out


ROW = "kind int, h long, rid long, pos long, right binary, left binary, n_left int, n_right int, more array<bigint>"


def suffixes(data: bytes, places: list, rid: int) -> Iterator[tuple]:
    """ROW of a text's places (kind, pos, h). Of places that are alike in all but their position the first is a row, and
    more holds the others."""
    words: list[bytes] = []
    made: dict[tuple, list[int]] = {}
    for x in places:
        kind, p = KINDS[x["kind"]], x["pos"]
        if kind is WORDS:
            words = words or [w + b" " for w in _words(data)]
            key = (1, x["h"], b"".join(words[p : p + kind.least]), b"".join(words[max(0, p - kind.before) : p][::-1]), min(p, kind.before), min(len(words) - p, kind.least))
        else:
            right, left = data[p : p + kind.least], data[max(0, p - kind.before) : p][::-1]
            key = (0, x["h"], right, left, len(left), len(right))
        made.setdefault(key, []).append(p)
    for (k, h, right, left, n, m), pos in made.items():
        yield k, h, rid, pos[0], right, left, n, m, pos[1:] or None


def _words(data: bytes) -> list[bytes]:
    import xxhash

    return [w if len(w) <= LONG_WORD else xxhash.xxh3_128_hexdigest(w).encode() for w in data.split()]


def found_in(table: pa.Table) -> Iterator[tuple[int, int, int, int]]:
    """(rid, kind, lo, hi): what repeats cover around the anchors of whole groups."""
    kinds, h, rid, pos = (table.column(c).to_numpy() for c in ("kind", "h", "rid", "pos"))
    right, left, more = (table.column(c).to_pylist() for c in ("right", "left", "more"))
    size = [table.column(c).to_numpy() for c in ("n_left", "n_right")]
    for a, b in pairwise(sorted({*starts(h).tolist(), *starts(kinds).tolist()})):
        kind = KINDS[kinds[a]]
        if b - a > 1:
            n, m = extents(right[a:b], left[a:b], rid[a:b], kind)
        else:
            n = m = np.array([-1])
        for i in range(a, b):
            x, y = n[i - a], m[i - a]
            if more[i] and not kind.across and size[0][i] + size[1][i] >= kind.least:
                x, y = size[0][i], size[1][i]  # it stands in its own text a second time
            if x >= 0:
                for p in (pos[i], *(more[i] or ())):
                    yield rid[i], kinds[i], p - x, p + y


def narrowed(rows: DataFrame, kind: Kind) -> DataFrame:
    """rid, kind, lo, hi of frequent anchors' occurrences (h, rid, places, left, right, n_left, n_right)."""
    least, key, ctx = kind.least, ["k0", "k1"], ["k0", "k1", "c0", "c1"]
    row = ["h", "rid", "places", "left", "right", "n_left", "n_right", "lo", "hi"]
    todo = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(kind.before))
    found = None
    while True:
        # what all windows of the range share, and what they cover
        inner = (kind.head(F.col("left"), F.col("lo")), kind.head(F.col("right"), least - F.col("hi")))
        outer = (kind.head(F.col("left"), F.col("hi")), kind.head(F.col("right"), least - F.col("lo")))
        keyed = todo.where((F.col("n_left") >= F.col("lo")) & (F.col("n_right") >= least - F.col("hi")))
        keyed = written(keyed.withColumns({"k0": F.xxhash64("h", "lo", "hi", *inner), "k1": F.xxhash64(F.lit(1), *inner, "h"), "c0": F.xxhash64(*outer), "c1": F.xxhash64(F.lit(1), *outer)}), "ranges")
        alike = keyed.groupBy(*ctx).agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.sum(F.size("places")).alias("n"))
        alike = written(alike.withColumn("done", F.col("a") != F.col("b") if kind.across else F.col("n") > 1), "alike")
        open_ = alike.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"), F.bool_and("done").alias("all")).where("kinds > 1 and not all").select(*key)
        both = written(keyed.join(alike.drop("n"), ctx), "both")
        n, m = F.least("n_left", "hi"), F.least(F.col("n_right"), least - F.col("lo"))
        done = both.where(F.col("done") & (n + m >= least)).select("rid", F.lit(KINDS.index(kind)).alias("kind"), F.explode("places").alias("pos"), n.alias("n"), m.alias("m"))
        done = done.select("rid", "kind", (F.col("pos") - F.col("n")).alias("lo"), (F.col("pos") + F.col("m")).alias("hi"))
        found = done if found is None else found.unionByName(done)
        # of those that are decided the first and the last text stay, once each
        stay = both.where("not done").select(*key, *row).unionByName(both.where("done and (rid = a or rid = b)").dropDuplicates([*ctx, "rid"]).select(*key, *row))
        todo = stay.where("lo < hi").join(open_, key).select(*row)
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / SPLIT).cast("int")
        parts = F.transform(F.sequence(F.col("lo"), F.col("hi"), step), lambda at: F.struct(at.alias("lo"), F.least(at + step - 1, F.col("hi")).alias("hi")))
        todo = written(todo.withColumn("x", F.explode(parts)).withColumns({"lo": F.col("x.lo"), "hi": F.col("x.hi")}).drop("x"), "parts")
        if todo.isEmpty():
            return found


def _merged(spans: np.ndarray) -> np.ndarray:
    """Intervals (n, 2) that overlap or touch, as one."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > top[:-1]]
    first = np.flatnonzero(new)
    return np.column_stack([s[first, 0], top[np.r_[first[1:] - 1, len(s) - 1]]])


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """k0, k1 (a hash of the text) and text, once a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(body).alias("k0"), F.xxhash64(F.lit(1), body).alias("k1"), body.alias("__text")).groupBy("k0", "k1").agg(F.first("__text").alias("__text"))


def passages(docs: DataFrame, seen: DataFrame, text: str) -> DataFrame:
    """k0, k1, spans: an array of (kind, lo, hi) of each distinct text that repeats cover in parts. seen: rid, k0, k1 and
    the anchors of each row."""
    one = written(seen.groupBy("k0", "k1").agg(F.min("rid").alias("rid")), "texts")
    first = seen.join(one.select("rid"), "rid", "left_semi")
    each = [first.select("rid", F.lit(i).alias("kind"), F.explode(F.arrays_zip(F.col(f"{k.name}_h").alias("h"), F.col(f"{k.name}_at").alias("pos"))).alias("x")).select("rid", "kind", "x.h", "x.pos") for i, k in enumerate(KINDS)]
    occ = written(each[0].unionByName(each[1]), "occurrences")
    twice = F.when(F.col("kind") == KINDS.index(WORDS), F.min("rid") != F.max("rid")).otherwise(F.count(F.lit(1)) > 1)
    often = occ.groupBy("kind", "h").agg(F.count(F.lit(1)).alias("n"), twice.alias("twice")).where("twice")
    often = written(often.select("kind", "h", (F.col("n") > GROUP).alias("hot")), "often")
    hot = not often.where("hot").isEmpty()

    schema = to_arrow_schema(StructType.fromDDL(ROW))

    def context(batches):
        for b in batches:
            for rid, t, at in zip(*(b.column(c).to_pylist() for c in ("rid", "__text", "at")), strict=True):
                out = list(suffixes(t.encode("utf-8", "surrogatepass"), at, rid))
                for i in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 2000], strict=True), schema, strict=True)], schema=schema)

    def array(is_hot: bool) -> DataFrame:
        own = occ.join(often.where("hot" if is_hot else "not hot"), ["kind", "h"])
        at = written(own.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "h"))).alias("at")).join(one, "rid"), "places")
        return _texts(docs, text).join(at, ["k0", "k1"]).select("rid", "__text", "at").mapInArrow(context, ROW)

    def scan(batches):
        for table in whole_runs(batches, "h"):
            rid, kind, lo, hi = np.array(list(found_in(table)), np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(kind.astype(np.int32)), pa.array(lo), pa.array(hi)], names=["rid", "kind", "lo", "hi"])

    order = ["kind", "h", "right", "left", "rid", "pos"]
    spans = array(False).repartition(F.col("kind"), F.col("h")).sortWithinPartitions(*order).mapInArrow(scan, "rid long, kind int, lo long, hi long")
    if hot:
        rows = written(array(True), "frequent")
        rows = rows.select("kind", "h", "rid", F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<bigint>"))).alias("places"), "left", "right", "n_left", "n_right")
        for i, kind in enumerate(KINDS):
            spans = spans.unionByName(narrowed(rows.where(F.col("kind") == i).drop("kind"), kind))
    return spans.groupBy("rid").agg(F.collect_set(F.struct("kind", "lo", "hi")).alias("spans")).join(one, "rid")


def removed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), n_words, n_repeated_words (those in
    passages of more than 50 words that another row holds too)."""
    import hashlib

    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    own = {f"__keep{i}": F.col(c) for i, c in enumerate(keep)}
    rows = docs.select(*[c.alias(n) for n, c in own.items()], F.xxhash64(body).alias("k0"), F.xxhash64(F.lit(1), body).alias("k1"), body.alias("__text"))
    made = [("n_bytes", "long"), ("n_words", "long"), ("whole", "string"), *[(f"{k.name}_{c}", "array<bigint>") for k in KINDS for c in ("h", "at")]]
    schema = ", ".join(f"{n} {t}" for n, t in [*((n, t) for n, t in rows.dtypes if n != "__text"), *made])

    def find(batches):
        import xxhash

        for b in batches:
            out: list[list] = [[] for _ in made]
            for t in b.column("__text").to_pylist():
                data = t.encode("utf-8", "surrogatepass")
                words = data.split()
                symbols = (np.frombuffer(data, np.uint8), np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
                places = [x for s, k in zip(symbols, KINDS, strict=True) for x in anchors(s, k)]
                for column, x in zip(out, (len(data), len(words), hashlib.sha256(data).hexdigest(), *(p.astype("<u8").view(np.int64) for p in places)), strict=True):
                    column.append(x)
            arrow = {"long": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
            plain = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in plain), *(pa.array(x, arrow[t]) for x, (_, t) in zip(out, made, strict=True))], names=[*plain, *(n for n, _ in made)])

    seen = written(rows.mapInArrow(find, schema).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    spans = written(passages(docs, seen, text), "spans")

    def cut_out(batches):
        for b in batches:
            out = []
            for t, found in zip(b.column("__text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, kept, gone, n = t.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0
                by = [_merged(np.array(x, np.int64).reshape(-1, 2)) if (x := [(s["lo"], s["hi"]) for s in found if s["kind"] == k]) else np.zeros((0, 2), np.int64) for k in range(2)]
                ends = [0, *by[0].ravel().tolist(), len(data)]
                for a, e in zip(ends[::2], ends[1::2], strict=True):
                    kept.update(data[a:e])
                gone, n = (int((x[:, 1] - x[:, 0]).sum()) for x in by)
                out.append((gone, len(by[0]), kept.hexdigest(), n))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("k0"), b.column("k1"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["k0", "k1", "gone", "runs", "kept", "repeated"])

    cut = _texts(docs, text).join(spans.select("k0", "k1", "spans"), ["k0", "k1"]).mapInArrow(cut_out, "k0 long, k1 long, gone long, runs long, kept string, repeated long")
    copies = seen.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("copies")).join(cut, ["k0", "k1"], "left")
    out = seen.drop("rid", *[f"{k.name}_{c}" for k in KINDS for c in ("h", "at")]).join(copies, ["k0", "k1"])
    copy = F.col("copies") > 1
    all_bytes, all_words = copy & (F.col("n_bytes") >= BYTES.least), copy & (F.col("n_words") >= WORDS.least)
    of = lambda whole, total, part: F.when(whole, total).otherwise(F.coalesce(part, F.lit(0))).cast("long")
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(own, keep, strict=True)],
        "n_bytes",
        of(all_bytes, F.col("n_bytes"), "gone").alias("n_removed"),
        of(all_bytes, F.lit(1), "runs").alias("n_spans"),
        F.when(all_bytes, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        "n_words",
        of(all_words, F.col("n_words"), "repeated").alias("n_repeated_words"),
    )
