"""op1, op2, op5, op6, op7 and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zeilenwerk.llm import neardup, neighbours, repeats, toxicity, warc
from zeilenwerk.llm.graphs import components


def test_warc(spark, tmp_path):
    pages = [(i, f"http://x/{i} y", t) for i, t in enumerate(["a" * 120, "b" * 99, "a" * 120, None, "", "b" * 99, "WARC/1.1\r\n\r\né" * 30, "a" * 120])]
    pages += [(None, None, "a" * 120), pages[2]]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, row string").repartition(3)
    got = Counter(tuple(r)[:5] for r in warc.report(spark, df).collect())
    want = Counter()
    for i, _, t in pages:
        t = (t or "").encode()
        again = len(t) >= 100 and i != min(j for j, _, u in pages if j is not None and (u or "").encode() == t)
        first = min((j for j, _, u in pages if j is not None and (u or "").encode() == t), default=None)
        want[i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    warc.write(df, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    assert records.where("digest_ok").count() == sum(v for k, v in want.items() if k[3] == "response")
    body = records.where("type = 'response' and page_id = 6").first()["block"]
    assert bytes(body).endswith(pages[6][2].encode())
    whole = warc.assemble(records)
    assert whole.count() == len(pages) and whole.where("main.type is null or size(requests) <> 1 or size(metadata) <> 1").count() == 0
    assert warc.report(spark, df.limit(0)).count() == 0


def test_assembly_hops(spark):
    """Names in both directions and through another record."""
    rec = [("r", "response", ["q"]), ("q", "request", []), ("m", "metadata", ["q2"]), ("q2", "request", ["r2"]), ("r2", "revisit", []), ("x", "metadata", ["gone"])]
    got = {r["transaction"]: r for r in warc.assemble(spark.createDataFrame(rec, "record_id string, type string, concurrent_to array<string>")).collect()}
    assert [x["record_id"] for x in got["r"]["requests"]] == ["q"]
    assert [x["record_id"] for x in got["r2"]["requests"]] == ["q2"] and [x["record_id"] for x in got["r2"]["metadata"]] == ["m"]
    assert got["gone"]["main"] is None and len(got["gone"]["metadata"]) == 1
    # a chain of names of any length, and a circle
    rec = [("end", "response", []), *((f"n{i}", "metadata", [f"n{i + 1}" if i < 20 else "end"]) for i in range(21)), ("a", "metadata", ["b"]), ("b", "metadata", ["a"])]
    got = {r["transaction"]: r for r in warc.assemble(spark.createDataFrame(rec, "record_id string, type string, concurrent_to array<string>")).collect()}
    assert len(got["end"]["metadata"]) == 21 and all(got[x]["main"] is None for x in got if x != "end")


def test_archives_are_parsed_once(spark):
    """Assembling reads what is known about the records, and payloads are what their bytes are, in UTF-8 or not."""
    df = spark.range(2).selectExpr("id as page_id", "concat('http://x/', id, ' y') as url", "cast(concat(X'ff', repeat('z', 120)) as string) as html")
    got = warc.captures(spark, df)
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    want = hashlib.sha256(b"\xff" + b"z" * 120).hexdigest()
    main = [(r["main"]["type"], r["main"]["payload_digest"], r["main"]["digest_ok"], r["main"]["target_uri"][-5:]) for r in got.orderBy("main.page_id").collect()]
    assert main == [("response", want, True, "0%20y"), ("revisit", want, None, "1%20y")]


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 17)
    pages = [(i, "http://x", f"{i}" + "y" * n) for i, n in enumerate([10] * 60 + [30_000] * 9 + [200_000] * 3)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    held = warc.read(spark, str(tmp_path / "w"))
    assert held.count() == 3 * len(pages) and held.where("type = 'response' and payload_bytes > 0").count() == len(pages)
    import gzip

    size = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert len(size) > 5 and max(size) < 230_000


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\\x20\\x09-\\x0D]+", low)


def linked(rows, share=75):
    """Component of each row by all pairs of word sets."""
    words = [words_of(t) for _, t, *_ in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least[find(i)], r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)]


def test_neardup(docs, rows, none):
    got = neardup.dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(linked(rows))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.dedup(none).count() == 0


def test_dense_group(spark):
    """Variants of one text at many distances: a region with more rows than the narrow search reaches."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(80)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(linked(rows))


def test_dense_borders(spark, monkeypatch):
    """Pairs in a template group most of which is below the threshold, cut into blocks and chunks much shorter than the group."""
    monkeypatch.setattr(neardup, "BLOCK", 60)
    monkeypatch.setattr(neardup, "CHUNK", 40)
    monkeypatch.setattr(neardup, "PIVOTS", 8)
    monkeypatch.setattr(neardup, "OUT_ROWS", 90)
    monkeypatch.setattr(neardup, "ALL_ROWS", 120)
    r = random.Random(4)
    base = [f"w{i}" for i in range(400)]

    def edited(w, n):
        w = list(w)
        for at in r.sample(range(0, 400, 6), n):
            w[at] = f"v{r.randint(0, 10**9)}"
        return w

    rows = []
    for i in range(250):
        one = edited(base, 8)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(edited(one, 10)))]
    want = linked(rows)
    assert len({c for *_, c in want}) > 200
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(want)


def test_shared_ids(spark):
    """Texts of one id are vertices of their own, and what repeats is linked once."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    other = [f"x{i}" for i in range(60)]
    near = [*base[:30], "new", *base[31:]]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, " ".join(near)), (7, " ".join(near)), (9, " ".join(other[:-1])), (2, " ".join(base).upper()), (None, " ".join(base))]
    r.shuffle(rows)
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == Counter(linked(rows))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["v"]: r["label"] for r in components(edges).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def covered(texts):
    """(bytes, removed bytes, runs, hash of the rest, words, words in passages that stand in two texts) by all windows."""
    seen, data = Counter(), [(t or "").encode() for t in texts]
    held, words = defaultdict(set), [b.split() for b in data]
    for i, b in enumerate(data):
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
        for k in range(len(words[i]) - 50):
            held[tuple(words[i][k : k + 51])].add(i)
    for b, w in zip(data, words, strict=True):
        off, again = np.zeros(len(b), bool), np.zeros(len(w), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                off[k : k + 400] = True
        for k in range(len(w) - 50):
            if len(held[tuple(w[k : k + 51])]) > 1:
                again[k : k + 51] = True
        rest = np.frombuffer(b, np.uint8)[~off].tobytes()
        yield len(b), int(off.sum()), int((np.diff(np.r_[0, off.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest(), len(w), int(again.sum())


@pytest.mark.parametrize("group", [1_000_000, 2])
def test_repeats(docs, rows, none, monkeypatch, group):
    """All anchors in tasks of their own, and all of them cut into ranges of offsets."""
    monkeypatch.setattr(repeats, "GROUP", group)
    few = [r for r in rows if r[1] is None or len(r[1]) < 60_000 or group > 2]
    part = docs if group > 2 else docs.where("text is null or length(text) < 60000")
    want = Counter((r[0], *x) for r, x in zip(few, covered([r[1] for r in few]), strict=True))
    assert Counter(tuple(r) for r in repeats.removed(part).collect()) == want
    assert repeats.removed(none).count() == 0


@pytest.mark.parametrize("group", [1_000_000, 3])
def test_repeats_of_passages(spark, monkeypatch, group):
    """A passage cut off at many places on both sides, in texts that go on differently; one only its own text repeats."""
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    core, other, lone = word(430), word(700), " ".join(f"l{i}" for i in range(60))
    texts = [word(r.randint(0, 300)) + core[r.randint(0, 40) :] + word(r.randint(0, 300)) for _ in range(25)] + [word(50) + other[k : k + 500] + word(60) for k in (0, 60, 120, 200)]
    texts += [f"{lone} {word(30)} {lone}", word(9), " ".join(["long" * 30, *core.split(), "w" * 90]), " ".join(["wrong" * 30, *core.split(), "w" * 90])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(x) for x in repeats.removed(df).collect()) == [(i, *x) for i, x in enumerate(covered(texts))]


def test_interval_tree():
    assert repeats.intervals([2, 3, 1]) == [(3, 1, 2), (2, 0, 2), (1, 0, 3)]
    same = b"x" * 300
    got = repeats.groups([same + b"a", same + b"a", same + b"b"], [b"y" * 200, b"y" * 200, b"y" * 200])
    assert got == [(200, 301, [0, 1]), (200, 300, [0, 1, 2])]
    # what follows to the right is the same for all that share the longer left side: only the longer group is maximal
    got = repeats.groups([same + b"a", same + b"a", same + b"b"], [b"y" * 200, b"y" * 200, b"z" * 200])
    assert got == [(200, 301, [0, 1])]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    x[500:700] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (None, x[0].tolist()), (5200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 50))
    for q, near in by.items():
        s = u @ u[q]
        s[q] = -9
        order = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hit += len({int(i) for i in order} & {i for i, _ in near})
        total += 5
        assert len(near) == 5 and all(abs(v - s[i]) < 1e-12 for i, v in near)
    assert hit / total >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    twice = neighbours.search(df.union(df.where("vec_id in (0, 50, 51)")), F.col("vec_id") % 50 == 0).groupBy("query_id").count().where("count <> 5")
    assert twice.count() == 0
    few = neighbours.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def toxic_table(spark, n=600):
    r = random.Random(1)
    words = [f"w{i}x" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        bad = i % 6 == 0
        for _ in range(4 * bad):
            w[r.randrange(len(w))] = r.choice(["idiot", "scum", "moron"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    docs += [(n, None), (n + 1, ""), (None, "idiot"), (3, docs[3][1]), (n + 2, "idiot moron " * 9)]
    labels += [(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxicity(spark, none):
    docs, labels = toxic_table(spark)
    got = toxicity.scored(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.95
    assert next(r for r in got if r["doc_id"] == 602)["score"] > 0.5
    assert all(r["score"] == min(x["score"] for x in got) for r in got if r["doc_id"] in (600, 601))
    assert toxicity.scored(none, labels).count() == 0
    alone = toxicity.scored(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in alone] == [0.0]


def plain_scores(docs, labels):
    """op5 word by word: dictionaries, every segment by its definition, the same curve."""
    import math
    import zlib

    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    known = defaultdict(int)
    for d, y, *_ in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            known[d] = max(known[d], y)
    n, t, c = Counter(), Counter(), Counter()
    for d, text in docs:
        for w in set(cut(text)):
            n[w] += 1
            if d in known:
                (t if known[d] else c)[w] += 1
    n_all, n_t, n_c = sum(x + 0.5 for x in n.values()), sum(t.values()), sum(c.values())

    def weight(w, dt=0, dc=0, st=0, sc=0):
        all_ = max(toxicity.LEAST, toxicity.PRIOR * (n_t - st))
        a = (n[w] + 0.5) / n_all * all_
        x, y = max(t[w] - dt, 0) + a, max(c[w] - dc, 0) + a
        odds = math.log(x / (n_t - st + all_ - x)) - math.log(y / (n_c - sc + all_ - y))
        return math.copysign(max(0.0, abs(odds) - toxicity.SHRINK * math.sqrt(1 / x + 1 / y)), odds)

    held = {w for w in n if t[w] + c[w] and weight(w)}

    def best_parts(s, a, b):
        best = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (x[0], -(x[2] - x[1]), -x[1]), default=(0,))
        return [] if best[0] <= 0 else [*best_parts(s, a, best[1]), best[0], *best_parts(s, best[2], b)]

    fit = []
    for d, text in docs:
        if d in known:
            y, words = known[d], cut(text)
            k = len(set(words))
            fit.append((y, [(weight(w, y, 1 - y, k * y, k * (1 - y)) if w in held else 0.0) - toxicity.DRIFT for w in words]))
    v = Counter(round(x * 50) for y, s in fit if not y for x in s)
    scale = toxicity.scale_of(np.array([*v]) / 50, np.array([*v.values()], float))
    parts = [(y, len(s), np.array(best_parts(s, 0, len(s))) * scale) for y, s in fit]
    clean = [(p.max() if len(p) else 0.0, m) for y, m, p in parts if not y and m]
    log_k = toxicity.log_k_of(np.array([x for x, _ in clean]), np.array([m for _, m in clean], float))
    curve = toxicity.rising(np.array([toxicity.features(p, m, log_k) for _, m, p in parts]), np.array([float(y) for y, *_ in parts]))
    for d, text in docs:
        words = cut(text)
        p = np.array(best_parts([(weight(w) if w in held else 0.0) - toxicity.DRIFT for w in words], 0, len(words))) * scale
        yield d, 1 / (1 + math.exp(-(curve[0] + float(np.dot(curve[1:], toxicity.features(p, len(words), log_k))))))


def test_toxicity_by_hand(spark):
    """Every score against a plain version: counts, prior, segments, extreme values and curve."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(90):
        w = [r.choice(words) for _ in range(r.randint(1, 24))]
        for _ in range(3 * (i % 4 == 0)):
            w.insert(r.randrange(len(w) + 1), r.choice(["Scum", "moron"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(90, None), (91, ""), (4, docs[4][1])]
    labels += [(4, 0), (None, 1), (7, None)]
    got = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted((x["doc_id"], x["score"]) for x in got.collect())
    want = sorted(plain_scores(docs, labels))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-3


def test_toxic_passage_of_known_words():
    """A passage whose words each stood alone before, and its repetition, are both found."""
    bad = [f"bad{i}" for i in range(12)]
    clean = lambda k: [f"c{k}x{i}" for i in range(90)]
    words = [w for k, b in enumerate(bad) for w in (b, *clean(k))]
    words += [*bad, *clean(12), *bad]
    known = np.sort(toxicity.tokens(" ".join(bad))[1])
    got = toxicity.Model(known, np.full(len(known), 1.6)).passages(" ".join(words))
    assert [x[:2] for x in got] == [(1092, 1104), (1194, 1206)]


@pytest.mark.parametrize("seed", range(5))
def test_segments(seed):
    """Maximal-scoring segments by their definition: the best one, then those left and right of it."""
    s = np.random.default_rng(seed).integers(-5, 5, 40).astype(float)

    def parts(a, b):
        best = max(((s[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (x[0], -(x[2] - x[1]), -x[1]), default=(0,))
        if best[0] <= 0:
            return []
        return [*parts(a, best[1]), (best[0]), *parts(best[2], b)]

    assert [x[2] for x in toxicity.segments(s)] == parts(0, 40)


def test_pipeline(spark, tmp_path):
    """Each stage on its predecessor's rows against a plain version of it."""
    from tokenizers import Tokenizer

    from zeilenwerk.llm import queries

    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    words, docs, labels = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)], [], []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(8, 24))]
        for _ in range(3 * (i % 5 == 0)):
            w.insert(r.randrange(len(w) + 1), r.choice(["scum", "moron"]))
        docs.append((i, " ".join(w) + (f" mail a{i}@b.example.com" if i % 7 == 3 else "")))
        labels.append((i, int(i % 5 == 0)))
    docs += [(150, docs[1][1]), (151, docs[2][1].upper()), (152, docs[3][1] + " more"), (153, None), (154, ""), (1, docs[1][1])]
    full = [(d, t, "en", "abc"[(d or 0) % 3], len(t or "")) for d, t in docs]
    at = str(tmp_path)
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    held, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, held, at)
        out.write.parquet(f"{at}/{name}")
        seen[name] = ([tuple(x) for x in held.collect()], spark.read.parquet(f"{at}/{name}"))
        held = seen[name][1]
    rows = lambda name: Counter(tuple(x) for x in seen[name][1].collect())
    own = seen["toxicity"][0]
    low = [x for x, (_, p) in zip(own, plain_scores([x[:2] for x in own], labels), strict=True) if p < 0.7]
    assert rows("toxicity") == Counter(low) and 0 < len(low) < len(own)
    own = seen["near-duplicates"][0]
    kept = {(x[0], x[1]): x for x, (d, _, c) in zip(own, linked(own), strict=True) if d == c}
    assert rows("near-duplicates") == Counter(kept.values()) and len(kept) < len(own)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert rows("personal data") == Counter((x[0], x[1] and mail.sub("[EMAIL]", x[1]), *x[2:]) for x in seen["personal data"][0])
    own, got = seen["mixing"][0], rows("mixing")
    size = lambda x: len((x[1] or "").split())
    assert set(got) <= set(own) and all(n <= 3 for n in got.values()) and set(got) != set()
    for s, (w, total) in {"a": (1, 6), "b": (2, 6), "c": (3, 6)}.items():
        target = sum(map(size, own)) * w / total
        assert abs(sum(size(x) * n for x, n in got.items() if x[3] == s) / target - 1) < 0.3
    lib = Tokenizer.from_file(queries.vocabulary())
    for x in seen["encoding"][1].collect():
        ids = lib.encode(x["text"] or "", add_special_tokens=False).ids
        assert x["n_tokens"] == len(ids) and bytes(x["ids"]) == np.array(ids, "<u4").tobytes() and x["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert Counter(tuple(x)[:5] for x in seen["encoding"][1].collect()) == rows("mixing")
    assert pipeline.run(spark, at).count() == seen["encoding"][1].count()
