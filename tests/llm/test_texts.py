"""op3, op4, op8, op9 and op10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from zeilenwerk.llm import bpe, licenses, merkle, mixing, pii, queries

VOCABULARY = queries.vocabulary()
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_sha = lambda b: hashlib.sha256(b).hexdigest()


def test_bpe(docs, rows, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(e), np.array(e, "<u4").tobytes(), lib.decode(e, skip_special_tokens=False)] += 1
    done = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in done.collect()) == want
    both = bpe.encode(docs, VOCABULARY, decoded="decoded")
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in both.collect()) == want
    assert bpe.decode(bpe.encode(none, VOCABULARY), VOCABULARY).count() == 0


@pytest.mark.parametrize("text", ["x" * 9000 + "the" * 2000, "é" * 4000, "!?" * 3000, "<|endoftext|>" * 40, "word 'S  1234 İſ日本 ﬁ\x85x\x1cy", "the" * 30_000 + " b"])
def test_bpe_tree(text):
    coder = bpe.Bpe(VOCABULARY, leaf=64)
    want = coder.lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == want


def test_licenses(docs, rows, none):
    phrases = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))
        at = [(k, name) for name, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({n for _, n in at}))] += 1
    got = licenses.report(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.report(none).count() == 0


def test_license_notice(spark):
    mit = licenses.NOTICES[0][1].replace("free of charge ", "").replace("deal in", "DEAL, in")
    df = spark.createDataFrame([(1, f"x y {mit} z"), (2, "permission is hereby granted")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.report(df).collect()} == {1: "mit", 2: ""}


def test_license_votes(spark):
    """A part of a notice repeated, or its parts scattered over a text, is no notice; added labels by brute force are those
    of texts that hold most of a notice's words in order."""
    bsd = licenses.NOTICES[5][1].split()
    scattered = " ".join(" ".join(bsd[i : i + 4]) + " x" * (4 + i) for i in range(0, len(bsd) - 3))
    texts = ["redistribution and use in " * 15, "licensed under the apache " * 6, scattered, "a b " + " ".join(bsd[:12] + ["well"] + bsd[12:]) + " c", " ".join(bsd[:11])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.report(df).collect()}
    assert {i: x[0] for i, x in got.items()} == {0: "", 1: "", 2: "", 3: "bsd", 4: ""}
    assert 0.8 < got[3][1] < 1 and got[0][1] == 0


def test_license_texts(spark):
    """Whole texts are found with their places and with the share of their grams that are left; shuffled ones are not."""
    rng, rows, want = random.Random(7), [], {}
    for label, text in licenses.TEXTS:
        w, k = text.split(), licenses.NOTICE_K
        cut = [x if (i + 1) % 12 or len(w) < 30 else "xx" for i, x in enumerate(w)]
        left = sum(cut[i : i + k] == w[i : i + k] for i in range(len(w) - k + 1)) / (len(w) - k + 1)
        mixed = rng.sample(w, len(w))
        for words, cover in ((w, 1.0), (cut, left), (mixed, None)):
            n = len(rows)
            rows.append((n, "Zz, " * 50 + ", ".join(words).upper() + " yy" * 30))
            want[n] = label, len(w), cover
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.spans(df).where("not phrase").collect():
        got[r["doc_id"]].append((r["label"], r["start"], r["stop"], round(r["cover"], 9)))
    for n, (label, words, cover) in want.items():
        if cover is None:
            assert n not in got
        else:
            own = [x for x in got[n] if x[0] == label and x[2] - x[1] > 0.8 * words]
            assert own and own[0][1] == 50 and abs(own[0][3] - cover) < 1e-6, (label, got[n])
            assert own[0][2] <= 50 + words


@pytest.mark.parametrize("range_rows", [200, 3])
def test_merkle(spark, docs, rows, none, range_rows, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = defaultdict(list)
    for r in merkle.compared(docs).collect():
        got[r["doc_id"]].append(r)
    prints = {}
    for n, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        mine = [r for r in got[i] if r["n_chars"] == len(t) and r["edited_sha256"] == _sha(edited.encode())]
        assert mine
        assert prints.setdefault(t, mine[0]["fingerprint"]) == mine[0]["fingerprint"]
        assert (mine[0]["near_edited"] == 1.0) == (t == edited) and 0 <= mine[0]["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert merkle.compared(none).count() == 0
    from pyspark.sql import functions as F

    two = spark.createDataFrame([("One a. Two b.\nThree c.\n\nFour d.", "One a. Two X.\nThree c.\n\nFour d. Five.")], "a string, b string")
    two = merkle.with_fingerprint(merkle.with_fingerprint(two, "a", "fa"), "b", "fb")
    at = two.select(merkle.edits(F.col("fa"), F.col("fb"))).first()[0]
    assert [(x["section"], x["paragraph"], x["sentence"]) for x in at] == [(0, 0, 1), (1, 0, 1)]


def shares(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return t | capped
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing(docs, rows, none):
    sizes, source = defaultdict(int), defaultdict(int)
    for _, t, _, s, *_ in rows:
        source[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, again = mixing.mix(docs)[0].collect(), mixing.mix(docs)[0].collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert len(got) == len(rows)
    for r in got:
        sizes[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == source[r["source"]]
    for s, t in shares(source).items():
        assert abs(sizes[s] - t) <= 1
    assert mixing.taken(none).count() == 0
    assert mixing.resampled(none).count() == 0


def test_resampled_words(spark):
    """A source far above its target gives no more than that; the others what theirs are."""
    from pyspark.sql import functions as F

    sizes = {"a": 600, "b": 150, "c": 200}
    df = spark.createDataFrame([(1000 * n + i, s, " ".join(f"{s}{i}x{k}" for k in range(300))) for n, (s, m) in enumerate(sizes.items()) for i in range(m)], "doc_id long, source string, text string")
    got = {r["source"]: r["n"] for r in mixing.resampled(df).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    for s, t in shares({s: 300 * m for s, m in sizes.items()}).items():
        assert abs(got[s] / t - 1) < 0.15


def test_shards(docs, rows, monkeypatch):
    """Shards are full, their counts are a draw, and every slot is a different block of its pass."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    slots = mixing.mix(docs, block=16)[1].toPandas()
    assert not slots.duplicated(["source", "slot"]).any() and not slots.duplicated(["source", "pass", "block"]).any()
    for _, own in slots.groupby("source", dropna=False):
        assert sorted(own["slot"]) == list(range(len(own)))
    size = slots.groupby("shard").size()
    full = size[: len(slots) // 64]
    assert (full <= 64).all() and full.sum() > 0.8 * len(slots)
    first = slots[slots["shard"] == 0]["source"].fillna("-").value_counts()
    share = slots["source"].fillna("-").value_counts(normalize=True)
    assert len(first) > 1 and all(abs(first.get(k, 0) - 64 * v) < 5 * (64 * v) ** 0.5 + 1 for k, v in share.items())
    given = defaultdict(list)
    for r in mixing.shards(docs, block=16).collect():
        given[r["source"]] += r["words"]
    own = defaultdict(Counter)
    for _, t, _, s, *_ in rows:
        own[s].update(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for s, t in shares({k: sum(v.values()) for k, v in own.items()}).items():
        assert abs(len(given[s]) - t) <= 1
        assert all(n <= 3 * own[s][w] for w, n in Counter(given[s]).items())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 4099])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    at = lambda key: [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.struct(F.lit(key).alias("k"))), "id").orderBy("id").collect()]
    one, two = at("a"), at("b")
    assert sorted(one) == sorted(two) == list(range(n))
    if n > 90:
        moved = sum(x == y for x, y in zip(one, two, strict=True))
        assert moved < n / 10 and len({(b - a) % n for a, b in zip(one, one[1:], strict=False)}) > n / 5


def spans(t: str) -> list[tuple[int, int, str, int]]:
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(n: int, m: str) -> bool:
        d = re.sub("[^0-9]", "", m)
        if n == 1:
            return all(int(x) <= 255 for x in m.split("."))
        if n == 2:
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return n == 0 or 9 <= len(d) <= 15

    return sorted((m.start(), n, pii.KINDS[n], m.end()) for n, p in enumerate(patterns) for m in re.finditer(p, t) if ok(n, m.group()))


def test_pii(spark, docs, rows, none):
    want = Counter((i, _sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(t or "")).encode())) for i, t, *_ in rows)
    got = pii.report(docs).collect()
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii.report(none).count() == 0
    odd = ["a@b.c_x@y.zz", "1.2.3.4.5.6.7.8", "aa@b", "é 😀 x@y.zz", "0001.2.3.4 1.2.3", "7" * 30_000, "a." * 20_000, "+" * 50, "4111-1111 11111111 5", "+12 34-5678901)2"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.report(df).collect()}
    assert got == {i: _sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(t)).encode()) for i, t in enumerate(odd)}


def test_pii_contexts(spark):
    """A context that seeds share finds what no base pattern knows; one without seeds finds nothing."""
    texts = [f"please reach person{i}@mail.example.com today again" for i in range(6)] + ["please reach ann77x@localhost today again", "room item55 is free here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[0] == "email:13:37" and got[7] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[0] == "please reach [EMAIL] today again" and clean[7] == texts[7]


def test_pii_unseen_shapes(spark):
    """Contexts find shapes that no seed has, and what they find makes contexts of its own."""
    texts = [f"please reach person{i}@mail.example.com today again" for i in range(30)]
    texts += [f"please reach usr{i}x{i}@intra today again" for i in range(8)] + [f"the login usr{i}x{i}@intra works well" for i in range(8)]
    texts += ["the login QX-1234-77 works well", "room item55 is free here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[30] == "context:13:25" and got[38] == "context:10:22"
    assert got[46] == "context:10:20" and got[47] == ""
    few = ["please reach ann77x@localhost today again", *texts[:6]]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")).collect()}
    assert got[0] == "context:13:29"


def _plain_contexts(texts):
    """The spans that contexts add, by dictionaries and loops."""
    uses = []
    for d, t in enumerate(texts):
        known = [(lo, hi) for lo, _, _, hi in spans(t)]
        found = list(re.finditer(pii.TOKEN, t))
        edge = [0, *[x for m in found for x in m.span()], len(t)]
        parts = [t[edge[2 * i] : edge[2 * i + 1]] for i in range(len(found) + 1)]
        for i, m in enumerate(found):
            v = m.group()
            tail = re.match(r"[^ \t\r\n]?[ \t]*([^ \t\r\n]+(?:[ \t]+[^ \t\r\n]+)?)", parts[i][::-1])
            head = re.match(r"[^ \t\r\n]?[ \t]+([^ \t\r\n]+)", parts[i + 1])
            tail, head = tail.group(1)[::-1].lower() if tail else "", head.group(1).lower() if head else ""
            sure = any(lo < m.end() and m.start() < hi for lo, hi in known)
            key = bool(re.fullmatch(r"[A-Za-z0-9+/_-]{24,}", v)) and len(re.sub("[^0-9]", "", v)) >= 6 and len(re.sub("[^A-Za-z]", "", v)) >= 6
            last = re.split(r"[ \t]+", tail)[-1]
            for p in ([f"{last} <> {head}"] if tail and head else []) + ([f"{tail} <>"] if " " in tail else []):
                uses.append((d, m.start(), m.end(), v, sure, sure or key, p))
    seeds = {v for _, _, _, v, _, s, _ in uses if s}
    n = Counter((p, v) for *_, v, _, _, p in uses)
    score = Counter()
    while True:
        inst = Counter()
        for p, v in n:
            inst[v] = 100 if v in seeds else max(inst[v], score[p])
        total, sums, support = Counter(), Counter(), Counter()
        for (p, v), k in n.items():
            total[p] += k
            sums[p] += k * inst[v] ** 2
            support[p] += k * (inst[v] >= 60)
        new = Counter({p: sums[p] // ((total[p] + 1) * 100) for p in total})
        if new == score:
            break
        score = new
    out = defaultdict(set)
    for d, lo, hi, _, sure, _, p in uses:
        if not sure and score[p] >= 60 and support[p] >= 3:
            out[d].add((lo, hi))
    return out


def test_pii_plain(spark):
    """Added spans of whole texts, and of chains of contexts that each need the one before, as the plain version has them."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    texts += [f"please reach person{i}@mail.example.com today again" for i in range(30)]
    place = ["please reach {} today again", "callb number {} nowb again", "callc digits {} nowc again", "calld letters {} nowd again"]
    for step in range(3):  # a step's values stand in its context once, in the next one five times
        texts += [place[step + k].format(f"u{step}v{i}-77") for i in range(6) for k in (0, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, got = _plain_contexts(texts), defaultdict(set)
    for r in pii.find(df).collect():
        got[r["doc_id"]] |= {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4}
    assert {d: x for d, x in got.items() if x} == want
    assert all(want[len(texts) - 6 - 36 * k] for k in range(3)) and not want[len(texts) - 1]


def test_pii_keys_and_lengths(spark):
    """Keys make patterns that find others, long tokens and long words of a context are whole."""
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    word = "w" * 90
    texts = [f'{w} token = "{key[i:] + key[:i]}" {w}' for i, w in enumerate(("one", "two", "three", "four", "five", "six"))]
    texts += ['a token = "short-77" b', f"lone {key} here", f'x token = "{key * 20}" y']
    texts += [f"{word} {word}x 10.0.0.{i} {word}" for i in range(6)] + [f"{word} {word}x id-77-{'9' * 70} {word}", f"{word} {word}y id-77 {word}"]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "context:13:53" and got[6]["spans"] == "context:11:19" and got[6]["n_spans"] == 1
    assert got[7]["spans"] == "" and got[8]["spans"] == "context:11:811"
    assert got[9]["spans"] == "ip:183:191" and got[15]["spans"] == "context:183:259" and got[16]["spans"] == ""


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    found, rel = queries.QUERIES[name](spark, at), con.sql(queries.SQL[name])
    at_ = [rel.columns.index(c) for c in found.columns]
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[i] for i in at_) for r in rel.fetchall())
