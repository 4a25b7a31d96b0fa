"""op11, op12 and op13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from zeilenwerk.llm import lines, resampling, trie

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, pos int, digest string, at long, n long, depth int"


def conversations() -> list[tuple]:
    r, rows = random.Random(3), []
    for c in [*range(-7, 30), 45, 46, 52, 58, 10**15 + 1]:
        if c == 10:
            continue  # 11 to 14 have no first turns to take
        for t in range(r.choice([1, 2, 3, 9, 14])):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(["é b", "c", "", None, "long " * 20])))
    rows += [(60 + i, t, "user", f"turn {t}") for i in range(40) for t in range(23)]  # one group of copies
    rows += [(200, t, "a", "b" * (t % 3)) for t in range(70)]
    rows += [(201, t, "a", "x" * 50_000) for t in range(3)]
    rows += [rows[0], rows[1], rows[1], (3, 2, "a", "bc"), (3, 2, "ab", "c"), (None, 1, "user", "lost"), (7, -5, "user", None)]
    return rows


def tries(rows) -> Counter:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    full = {}
    for c, x in own.items():
        x.sort()
        h = zlib.crc32(str(c).encode()) % 9
        base = sorted(own.get(c - int(math.fmod(c, 5)), []))
        full[c] = [y[2:] for y in base[:h] + x[h:]]
    members, children = defaultdict(list), defaultdict(set)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
            if d:
                children[tuple(x[: d - 1])].add(tuple(x[:d]))
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        out[min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, small, monkeypatch):
    if small:  # conversations of many segments, nodes of many strings
        monkeypatch.setattr(trie, "SEGMENT", 3)
        monkeypatch.setattr(trie, "RUN", 4)
    rows = conversations()
    got = trie.trie(spark.createDataFrame([(*x, 1, "d", 2, 3, 4) for x in rows], TURNS).repartition(5))
    assert Counter(map(tuple, got.collect())) == tries(rows)
    assert set(dict(got.drop("ends_sha256").dtypes).values()) == {"bigint"}


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "d", 2, 3, 4)], TURNS)).count() == 0


def deduplicated(rows) -> Counter:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(_LOW)
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d, key=order)
    out = Counter()
    for d, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key(x)) < 10 or first[key(x)] == d]
        out[d, len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_lines(docs, rows, none, spark, hot, monkeypatch):
    if hot:  # nearly every repeated line counts as frequent
        monkeypatch.setattr(lines, "SAMPLE", 1)
        monkeypatch.setattr(lines, "SEEN", 1)
        monkeypatch.setattr(lines, "HOT", 10**6)
    assert Counter(map(tuple, lines.report(docs).collect())) == deduplicated([r[:2] for r in rows])
    r = random.Random(9)
    pool = ["a common line", " A Common LINE\t", "ten letters", "\x0bten letters\x1f", "ten letterß", "short", "", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää", *[f"another line {i}" for i in range(30)]]
    made = [(i % 90, "\n".join(r.choice(pool) for _ in range(r.choice([1, 5, 200])))) for i in range(120)]
    made += [(None, "a common line\nonly here, twice\nonly here, twice"), (None, "only here, twice"), (5, None), made[3], made[3]]
    got = lines.report(spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == deduplicated(made)
    assert lines.report(none).count() == 0


def test_bitmaps(spark):
    df = spark.createDataFrame([(1, "a first line\n" * 130 + "end of the text"), (2, "x\n" * 125 + "a first line\ny")], "doc_id long, text string")
    assert [(r["doc"], [tuple(w) for w in r["gone"]]) for r in lines.bitmaps(df).collect()] == [(2, [(2, 1 << 5)])]


def features(text) -> list[bytes]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    return [" ".join(w[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def draws(rows, target) -> Counter:
    b = lambda x: zlib.crc32(x) % 10_000
    every = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b(f) for _, fs, _ in every for f in fs), Counter(b(f) for x in target for f in features(x)[0])
    gain = {k: math.floor(1000 * math.log((t[k] + 1.0) * (t0 + 0.0) / ((s[k] + 1.0) * (t1 + 0.0)))) for t0, t1 in [(s.total() + 10_000, t.total() + 10_000)] for k in s}
    noise = lambda d: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    scored = [(d, len(fs), sum(gain[b(f)] for f in fs), n) for d, fs, n in every]
    scored = [(d, k, w, w + noise(d), n) for d, k, w, n in scored]
    wide = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return Counter([(*x[:4], i + 1 if i < len(wide) * 5 // 100 else None) for i, x in enumerate(wide)] + [(*x[:4], None) for x in scored if x[4] < 20])


@pytest.mark.parametrize("chunk", [32_768, 40])
def test_resampling(spark, docs, rows, none, chunk, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    target = [rows[3][1], "the words of MIT License 7é7", None, "", "x" * 300 + " y"]
    bench = spark.createDataFrame([(x, "t") for x in target], "text string, doc_id string")
    got = resampling.resampled(docs, bench)
    assert Counter(map(tuple, got.collect())) == draws([r[:2] for r in rows], target)
    assert set(dict(got.dtypes).values()) == {"bigint"}
    assert resampling.resampled(none, bench).count() == 0
    again = resampling.resampled(docs, bench.limit(0))
    assert Counter(map(tuple, again.collect())) == draws([r[:2] for r in rows], [])


def test_buckets():
    """Runs' CRCs from those of their words, with words of all lengths."""
    r = random.Random(1)
    texts = ["", " ".join(r.choice("aéz0") * r.choice([1, 2, 7, 31, 62, 63, 64, 65, 130, 4000]) for _ in range(300)), "!", "a", None, "b c"]
    of, found, words = resampling.buckets(pa.array(["cut off", *texts])[1:])
    for i, t in enumerate(texts):
        fs, n = features(t)
        assert words[i] == n and Counter(found[of == i].tolist()) == Counter(zlib.crc32(f) % 10_000 for f in fs)
    assert len(np.unique(of)) == 3
