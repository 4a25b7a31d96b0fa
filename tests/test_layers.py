"""Text layers, heads of scanned pages, and projects as folders, against plain Python."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from zeilenwerk.functions import text
from zeilenwerk.operators import projects, scans, textlayer

CHAR = "c string, x0 double, y0 double, x1 double, y1 double"


def plain_words(chars):
    out, run = [], []
    for c in [*chars, (None, 0, 0, 0, 0)]:
        if not c[0] or c[0].isspace():
            if run:
                text = "".join(chr(ord(x[0]) + 29) if 0 < ord(x[0]) < 32 else x[0] for x in run)
                out.append((min(x[1] for x in run), min(x[2] for x in run), max(x[3] for x in run), max(x[4] for x in run), text))
            run = []
        else:
            run.append(c)
    return out


def test_words_of_characters(spark):
    rnd = random.Random(7)
    signs = ["a", "B", "\x11", "\x14", " ", "\t", "\x1d", "\x85", " ", "　", "ß", "𝄞", "", None]
    spans = [(1, p, s, [(rnd.choice(signs), *(float(rnd.randint(0, 50)) for _ in range(4))) for _ in range(rnd.randint(0, 30))]) for p in range(5) for s in range(8)]
    spans.append((None, 0, 0, [("\x11", 0.0, 0.0, 1.0, 1.0)]))
    df = spark.createDataFrame(spans, f"doc_id long, page_index int, span int, chars array<struct<{CHAR.replace(' ', ':').replace(',:', ',')}>>")
    got = sorted((r.page_index, r.span, r.n, r.x0, r.y0, r.x1, r.y1, r.text) for r in textlayer.from_characters(df.where("doc_id = 1")).collect())
    assert got == sorted((p, s, n, *w) for d, p, s, chars in spans if d for n, w in enumerate(plain_words(chars)))
    bad = {r.page_index for r in textlayer.defective_pages(df.where("doc_id = 1")).collect()}
    assert bad == {p for d, p, _, chars in spans if d for c in chars if c[0] and 0 < ord(c[0]) < 32}


def test_only_defective_pages_are_rebuilt(spark):
    c = lambda t: [(x, float(i), 0.0, i + 1.0, 1.0) for i, x in enumerate(t)]
    spans = spark.createDataFrame([(1, 0, 0, c("ab \x14")), (1, 1, 0, c("ab 1"))], f"doc_id long, page_index int, span int, chars array<struct<{CHAR.replace(' ', ':').replace(',:', ',')}>>")
    read = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 2.0, 1.0, "ab"), (1, 1, 0, 0, 0.0, 0.0, 2.0, 1.0, "read")], "doc_id long, page_index int, span int, n int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted((r.page_index, r.text) for r in textlayer.words(spans, read).collect()) == [(0, "1"), (0, "ab"), (1, "read")]
    assert textlayer.words(spans.limit(0), read.limit(0)).count() == 0


def test_text_layer(spark):
    pages = [(1, 0, " 　" + "x" * 199 + "\x1c\n"), (2, 0, "y"), (2, 1, "x" * 200), (3, 0, None)]
    got = textlayer.has_text(spark.createDataFrame(pages, "doc_id long, page_index int, text string"))
    assert {r.doc_id: r.has_text for r in got.collect()} == {1: False, 2: True, 3: False}


def test_scanned_head(spark):
    centres = spark.createDataFrame([(1, 0, "p", 30.0), (1, 0, "p", 10.0), (1, 0, "p", 50.0), (2, 0, "p", 5.0), (3, 0, "q", 5.0)], "doc_id long, page_index int, profile_id string, x double")
    columns = spark.createDataFrame([("p", 0, "1.2.3", "A"), ("p", 1, "4", "B")], "profile_id string, ordinal int, address string, label string").selectExpr("*", "'' group_name", "'' subgroup", "'' abbrev")
    got = {(r.doc_id, r.column_index): (r.x_center, r.section, r.column_no, r.label) for r in scans.header_grid(centres, columns).collect()}
    assert got == {(1, 0): (10.0, "1.2", "3", "A"), (1, 1): (30.0, "4", "4", "B"), (2, 0): (5.0, "1.2", "3", "A")}
    assert {r.doc_id: r.note_left for r in scans.edges(centres).collect()} == {1: 70.0, 2: 5.0, 3: 5.0}


def test_lines_before_words(spark):
    pages = spark.createDataFrame([(1, 0, 3, 50), (2, 0, 0, 20), (3, 0, None, 19), (4, 0, 2, 0)], "doc_id long, page_index int, n_lines int, n_words int")
    rows = lambda how: spark.createDataFrame([(i, 0, how) for i in range(1, 5)], "doc_id long, page_index int, how string")
    got = scans.by_lines_or_words(pages, rows("lines"), rows("words")).collect()
    assert sorted((r.doc_id, r.how) for r in got) == [(1, "lines"), (2, "words"), (4, "lines")]


def test_projects(spark, tmp_path):
    root = str(tmp_path / "wurzel")
    assert [(r.folder, r.project) for r in projects.listing(spark, root).collect()] == [("Standard", "Standard")]
    at = projects.create(spark, root, "Haus Süd/1 %2B")
    assert projects.create(spark, root, "Haus Süd/1 %2B") == at
    (tmp_path / "wurzel" / "alt").mkdir()
    assert [r.project for r in projects.listing(spark, root).collect()] == ["Haus Süd/1 %2B", "Standard", "alt"]
    df = spark.createDataFrame([(i if i < 40 else None, f"t{i}") for i in range(42)], "doc_id long, t string")
    for name in ("dokumente", "zeilen"):
        projects.write(df, at, name, 4)
    assert projects.tables(spark, at) == ["dokumente", "zeilen"]
    before = {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}
    projects.delete_documents(spark, at, spark.createDataFrame([(5,), (5,), (None,), (777,)], "doc_id long"), 4)
    for name in ("dokumente", "zeilen"):
        assert sorted(r.t for r in projects.read(spark, at, name).collect()) == sorted(f"t{i}" for i in range(42) if i != 5)
    # buckets of other documents keep their files
    assert any(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    # a bucket that loses all its rows goes
    projects.delete_documents(spark, at, df.select("doc_id"), 4)
    assert [r.doc_id for r in projects.read(spark, at, "zeilen").collect()] == [None, None]
    assert projects.clear(spark, root, "Haus Süd/1 %2B") and projects.tables(spark, at) == []
    assert not projects.clear(spark, root, "fehlt") and not projects.remove(spark, root, "fehlt")
    assert projects.remove(spark, root, "Haus Süd/1 %2B")
    assert [r.project for r in projects.listing(spark, root).collect()] == ["Standard", "alt"]


def test_characters_are_made_after_the_join(spark):
    """Nothing but the text of a line is moved to its page."""
    df = spark.createDataFrame([(1, 0, 0, "ab \x14"), (1, 1, 0, "ab 1"), (2, 0, 0, "\x11\x12 c")], "doc_id long, page_index int, span int, line string")
    chars = F.transform(F.split("line", ""), lambda c, i: F.struct(c.alias("c"), i.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i + 1.0).alias("x1"), F.lit(1.0).alias("y1")))
    read = spark.createDataFrame([(1, 1, 0, 0, 0.0, 0.0, 2.0, 1.0, "read")], "doc_id long, page_index int, span int, n int, x0 double, y0 double, x1 double, y1 double, text string")
    got = textlayer.words(df, read, chars).collect()
    assert sorted((r.doc_id, r.page_index, r.n, r.text, r.x1) for r in got) == [(1, 0, 0, "ab", 2.0), (1, 0, 1, "1", 4.0), (1, 1, 0, "read", 2.0), (2, 0, 0, "./", 2.0), (2, 0, 1, "c", 4.0)]


def test_letters_beyond_chr(spark):
    """The first letter's code point may be above 255."""
    got = spark.createDataFrame([(0,), (701,), (18277,), (702 + 676 * 191,), (1_199_999,)], "n long").select("n", text.column_letters(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["A", "ZZ", "ZZZ", chr(65 + 191) + "AA", chr(65 + 1774) + chr(65 + 1_199_297 % 676 // 26) + chr(65 + 1_199_297 % 26)]
