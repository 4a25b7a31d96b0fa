"""Row rules, foci, texts, files and storage on small fixtures."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from zeilenwerk.functions import text as tx
from zeilenwerk.operators import binding, focus, store
from zeilenwerk.operators import rows as rules
from zeilenwerk.sources import files

ROWS = "page int, row_seq int, label string, kind string, values map<int,double>"


def kinds(spark, rows):
    df = spark.createDataFrame([(0, i, a, "daten", v) for i, (a, v) in enumerate(rows)], ROWS)
    out = rules.mark_unlabelled_sums(df, ["page"]).orderBy("row_seq").collect()
    return [r["kind"] for r in out], [r["reason"] for r in out]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("A", {0: 1.0, 2: 3.0}), ("B", {0: 2.0, 2: 4.0}), ("", {0: 3.0, 2: 7.0})], ["daten", "daten", "summe"]),
        ([("A", {0: 1.0, 2: 3.0}), ("B", {0: 2.0, 2: 4.0}), ("Klappe", {0: 3.0, 2: 9.0})], ["daten"] * 3),
        ([("", {0: 1.0, 1: 1.0})], ["daten"]),
        ([("A", {0: 1.0, 1: 2.0}), ("", {0: 1.0, 1: 2.0}), ("B", {0: 4.0})], ["daten", "summe", "daten"]),
        ([("A", {0: 1.0}), ("B", {1: 2.0}), ("", {2: 7.0})], ["daten", "daten", "summe"]),
        ([("A", {0: 1.0}), ("B", {0: 2.0}), ("", {0: 3.0}), ("C", {0: 1.0})], ["daten"] * 4),
        ([("A", {0: 1.0, 1: 2.0}), ("B", {0: 2.0, 1: 1.0}), ("--", {0: 3.0, 1: 3.0}), ("C", {0: 1.0})], ["daten", "daten", "summe", "daten"]),
        ([("A", {0: 1.0, 1: 2.0, 2: 0.0}), ("B", {0: 2.0, 1: 1.0}), ("", {0: 3.0, 1: 3.0}), ("C", {0: 1.0})], ["daten", "daten", "summe", "daten"]),
        ([("A", {0: 1.0, 1: 1.0}), ("B", {0: 2.0, 1: 2.0}), ("", {0: 3.0, 1: 3.0}), ("C", {0: 4.0, 1: 4.0}), ("D", {0: 5.0, 1: 5.0}), ("", {0: 9.0, 1: 9.0})], ["daten", "daten", "summe"] * 2),
    ],
)
def test_unlabelled_sums(spark, rows, expected):
    assert kinds(spark, rows)[0] == expected


def test_last_row_that_is_off(spark):
    k, why = kinds(spark, [("A", {0: 2.0, 1: 2.0}), ("B", {0: 3.0, 1: 3.0}), ("", {0: 5.0, 1: 4.0})])
    assert k[-1] == "summe" and "gehen jedoch nicht auf" in why[-1]


def assigned(spark, rows, default=None):
    df = spark.createDataFrame([("d", p, i, k, a, v) for i, (p, k, a, v) in enumerate(rows)], "doc_id string, page_index int, row_seq int, kind string, label string, has_values boolean")
    df = df.withColumn("own", focus.own_focus(F.col("label")))
    d = F.struct(F.lit(default).alias("code"), F.lit("").alias("label")) if default else None
    return [(r["focus"], r["focus_label"]) for r in focus.assign(df, default=d).orderBy("row_seq").collect()]


def test_focus_rules(spark):
    got = assigned(spark, [(0, "daten", "ASP01", True), (0, "daten", "Heizungstechnik 2.UG", False), (0, "daten", "ASP02", True), (0, "daten", "Kältetechnik 2.UG", False)])
    assert got == [("ASP01", "Heizungstechnik 2.UG")] * 2 + [("ASP02", "Kältetechnik 2.UG")] * 2
    assert [x[0] for x in assigned(spark, [(0, "daten", "Pumpe", True), (0, "daten", "*ASP05*H01*PU", True), (0, "daten", "Ventil", True)])] == ["ASP05"] * 3
    assert [x[0] for x in assigned(spark, [(0, "daten", "ASP01", True), (0, "daten", "ASP02", True), (0, "summe", "Summe", True)])] == ["ASP01", "ASP02", ""]
    assert [x[0] for x in assigned(spark, [(0, "daten", "ASP01", True), (1, "daten", "Pumpe", True)], "ASP09")] == ["ASP01", "ASP09"]


def test_footer_and_positions(spark):
    df = spark.createDataFrame([("d", i, k) for i, k in enumerate(["daten", "summe", "leer", "fussbereich", "daten"])], "doc string, seq int, kind string")
    assert [r["seq"] for r in rules.cut_after_footer(df, ["doc"], "seq").orderBy("seq").collect()] == [0, 1]
    assert sorted(r["seq"] for r in rules.remove_positions(df, [0, 999, -1], ["doc"], "seq").collect()) == [1, 2, 3, 4]


def test_text(spark):
    df = spark.createDataFrame([("Überwachen", "\x14"), ("Grenzwert  gleitend", "\x13\x13\x14"), (None, "Pumpe")], "a string, g string")
    got = df.select(tx.normalize(F.col("a")).alias("n"), tx.repair_glyphs(F.col("g")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("ueberwachen", "1"), ("grenzwert gleitend", "001"), ("", "Pumpe")]
    one = spark.range(1).select(tx.german_number(F.lit(1234.5)), tx.bbox(F.lit("1,2,3,4"))["y1"], tx.bbox(F.lit("1,2,x,4")), tx.slug(F.lit("Büro / Nord")), tx.is_freetext(F.lit("Variante 1"))).first()
    assert tuple(one) == ("1.234,50", 4.0, None, "Büro_Nord", True)


def test_similarity(spark):
    df = spark.createDataFrame([("Grenzwert fest", "Grenzwert\nfest"), ("Motorsteuerung", "Sonnenschutz")], "a string, b string")
    same, other = (r[0] for r in df.select(binding.similarity(F.col("a"), F.col("b"))).collect())
    assert same == 1.0 and other < 0.5
    pairs = spark.createDataFrame([("d", i, "k", 1.0) for i in range(3)], "doc string, l int, r string, score double")
    assert binding.greedy(pairs, ["doc"], "l", "r", "score").count() == 1


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.0</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Pumpe </t></is></c></row></sheetData><mergeCells><mergeCell ref="B1:C2"/></mergeCells></worksheet>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Gewerk:</t></si></sst>')
    (tmp_path / "a.xlsx").write_bytes(b.getvalue())
    (tmp_path / "b.txt").write_text("x")
    found = files.files(spark, str(tmp_path))
    assert {r["suffix"]: r["supported"] for r in found.collect()} == {"xlsx": True, "txt": False}
    assert sorted((r["r"], r["c"], r["value"]) for r in files.grid_cells(found).collect()) == [(0, 0, "Gewerk:"), (0, 1, "2"), (0, 2, "2"), (1, 0, "Pumpe"), (1, 1, "2"), (1, 2, "2")]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "h string, v int")
    new = spark.createDataFrame([("b", 5), ("", 6), ("c", 7)], "h string, v int")
    assert sorted(map(tuple, store.upsert(old, new, "h").collect())) == [("", 3), ("", 6), ("a", 1), ("b", 5), ("c", 7)]
    assert sorted(map(tuple, store.upsert(old, new, "h", True).collect())) == [("", 3), ("", 6), ("a", 1), ("b", 2), ("c", 7)]
    for _ in range(2):
        store.write_documents(new.where("h <> ''").withColumn("project", F.lit("p")).withColumnRenamed("h", "file_hash"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_ingest(spark, tmp_path):
    from zeilenwerk.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"same" if name != "c.txt" else b"text")
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "p", lambda df: df.select("path", "file_hash"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sheet(spark):
    """A sheet of cells becomes columns, rows and cells."""
    from zeilenwerk.operators import sheets

    head = [(0, 0, "Gewerk:"), (0, 2, "Heizung"), (3, 3, "Mengen"), (3, 5, "Sätze"), (4, 3, "Menge 1)"), (4, 4, "Preis je Teil"), (4, 5, "Rabatt"), (4, 6, "Bemerkung"), (5, 2, "Abschnitt"), (5, 3, "1."), (5, 5, "4"), (6, 2, "Spalte"), (6, 3, "1"), (6, 4, "2"), (6, 5, "1"), (6, 6, "2")]
    body = [(7, 0, "1"), (7, 1, "Pumpe"), (7, 2, "BE"), (7, 3, "2"), (7, 4, "x"), (8, 0, "2"), (8, 1, "Ventil"), (8, 3, "3"), (8, 4, "4"), (8, 5, "siehe Plan"), (9, 3, "5"), (9, 4, "5"), (10, 1, "Übertrag von 2"), (10, 3, "9"), (12, 1, "Planersteller"), (13, 1, "danach"), (13, 3, "7")]
    grid = spark.createDataFrame([("d", 0, *x) for x in head + body], "doc_id string, sheet int, r int, c int, value string").persist()
    cols = sheets.head(grid).persist()
    assert [(x["address"], x["group_name"], x["is_note"]) for x in cols.orderBy("column_index").collect()] == [("1.1", "Mengen", False), ("1.2", "Mengen", False), ("4.1", "Sätze", True), ("4.2", "Sätze", True)]
    rows, cells = sheets.body(grid, cols)
    got = {x["row_seq"]: (x["row_no"], x["label"], x["qualifier"], x["remark"], x["kind"]) for x in rows.collect()}
    assert got == {7: ("1", "Pumpe", "BE", "", "daten"), 8: ("2", "Ventil", "", "siehe Plan", "daten"), 9: ("", "", "", "", "summe"), 10: ("", "Übertrag von 2", "", "", "uebertrag")}
    assert sorted((x["row_seq"], x["column_index"], x["count"], x["note"]) for x in cells.where("row_seq < 9").collect()) == [(7, 0, 2.0, ""), (7, 1, 1.0, ""), (8, 0, 3.0, ""), (8, 1, 4.0, ""), (8, 2, None, "siehe Plan")]
    assert {x["field"]: x["value"] for x in sheets.metadata(grid).collect()} == {"gewerk": "Heizung"}


def test_best_pairs(spark):
    """Rounds take what one pair after another takes, in chains of any length."""
    import random

    from zeilenwerk.operators.matching import best_pairs

    r = random.Random(4)
    pairs = [(g, i, j, float(r.randint(0, 6))) for g in range(6) for i in range(g + 3) for j in range(9) if r.random() < 0.7]
    pairs += [(9, i, j, -float(2 * i + (j - i))) for i in range(30) for j in (i, i + 1)]  # each waits for the one before
    got = {(x["g"], x["l"], x["r"]) for x in best_pairs(spark.createDataFrame(pairs, "g int, l int, r int, score double"), ["g"], "l", "r", [F.col("score").desc()]).collect()}
    want, left, right = set(), set(), set()
    for g, i, j, _ in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if (g, i) not in left and (g, j) not in right:
            want.add((g, i, j))
            left.add((g, i))
            right.add((g, j))
    assert got == want


def test_match_columns(spark):
    """Addresses go before likeness, groups tell equal names apart, each column once."""
    known = [("p", 0, "K1", "1.1", "Ein", "", "Schalten", "BA", ["Stellen"], False), ("p", 1, "K2", "1.2", "Aus", "", "Schalten", "", [], False), ("p", 2, "K3", "", "", "", "Bemerkungen", "", [], True)]
    known = spark.createDataFrame(known, "profile_id string, place int, column_key string, address string, group_name string, subgroup string, label string, abbrev string, aliases array<string>, is_note boolean")
    heads = [("d", 0, "p", "", "Aus", "", "Schalten", ""), ("d", 1, "p", "01,1", "", "", "Bemerkungen", ""), ("d", 2, "p", "", "", "", "Bemerkung", None), ("d", 3, "p", "", "", "", "etwas anderes", "")]
    heads = spark.createDataFrame(heads, "doc string, column_index int, profile_id string, address string, group_name string, subgroup string, label string, abbrev string")
    got = {x["column_index"]: (x["column_key"], x["match_score"], x["is_note"]) for x in binding.match_columns(heads, known, ["doc"]).collect()}
    assert got == {0: ("K2", 1.0, False), 1: ("K1", 1.0, False), 2: ("K3", 0.932, True), 3: (None, 0.0, False)}


def test_profiles(spark, tmp_path):
    """Profile files as tables; a document's profile by keywords, with those that count against it."""
    import json

    from zeilenwerk.sources import profiles

    a = {"id": "alt", "priority": 10, "detection": {"min_score": 2, "keywords": [{"text": "Ein-/Ausgabe", "weight": 2.5}, "Benennung"], "negative_keywords": [{"text": "Sonnenschutz", "weight": 3}]}, "columns": [{"key": "A_1_1", "address": "1.1", "group": "Ein", "label": "Schalten", "aliases": ["BA"], "footnotes": ["1"]}], "note_columns": [{"key": "N"}], "footnotes": [{"marker": "1", "text": "je Stück"}], "row_fields": [{"key": "row_no", "label": "Nr."}]}
    (tmp_path / "alt.json").write_text(json.dumps(a))
    (tmp_path / "neu.json").write_text(json.dumps({"id": "neu", "priority": 20, "detection": {"keywords": ["Sonnenschutz"]}}))
    c = profiles.load(spark, str(tmp_path))
    assert [(r["column_key"], r["label"], r["is_note"], r["aliases"]) for r in c.columns.orderBy("place").collect()] == [("A_1_1", "Schalten", False, ["BA"]), ("N", "N", True, [])]
    assert [tuple(r) for r in c.profiles.orderBy("profile_id").select("profile_id", "fassung", "min_score").collect()] == [("alt", "unbekannt", 2.0), ("neu", "unbekannt", 3.0)]
    texts = [(1, "die Ein- / Ausgabe und Benennung"), (2, "Ein/Ausgabe, Benennung; Sonnenschutz"), (3, ""), (4, None), (5, "x Benennungen y" * 3)]
    got = {r["doc_id"]: (r["profile_id"], r["score"], r["scores"]["neu"]) for r in binding.detect_profile(spark.createDataFrame(texts, "doc_id int, text string"), c.keywords, c.profiles).collect()}
    assert got == {1: ("alt", 3.5, 0.0), 2: (None, 1.0, 1.0), 3: (None, 0.0, 0.0), 4: (None, 0.0, 0.0), 5: (None, 1.0, 0.0)}
    assert c.row_fields.first()["field"] == "row_no" and c.footnotes.first()["text"] == "je Stück"


def test_band_search(spark):
    """A header with a cell too many at both ends and unread numbers is found by its blocks."""
    from zeilenwerk.operators import bands

    known = [("p", 1, i, f"{s}.{n}") for i, (s, n) in enumerate((s, n) for s, k in ((1, 3), (2, 4), (3, 2)) for n in range(1, k + 1))]
    known = spark.createDataFrame(known, "profile_id string, priority int, place int, address string")
    read = {"a": [7, 1, 2, 3, None, 2, 3, None, 1, 2, None], "b": [None, None, None, 4, 4, 4, 9, 9, 9, 9], "c": [1, 2, 3, 4, 5, 6, 7, 8, 9]}
    rows = [(k, i, x) for k, v in read.items() for i, x in enumerate(v)]
    got = bands.search(spark.createDataFrame(rows, "band string, place int, number int"), known, ["band"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 10, "p", 1.0, 7)]


def test_pages(spark):
    """A page without the labels of its head is read by its row of numbers: two ways, one answer."""
    from zeilenwerk.operators import pages

    numbers = [1, 2, 3, 4, 5, 1, 2, 3, 1]
    xs = [200.0 + 30 * i for i in range(9)]
    base = [(x, 140.0, 6.0, str(n)) for x, n in zip(xs, numbers, strict=True)] + [(xs[2], 120.0, 8.0, "1."), (xs[6], 120.0, 8.0, "2."), (xs[8], 120.0, 8.0, "3.")]
    for r in range(5):
        y = 165.0 + 18 * r
        base += [(20.0, y, 6.0, str(r + 1)), (40.0, y, 30.0, f"Pumpe{r}"), (xs[r], y, 6.0, "2"), (xs[r + 2], y, 6.0, "x")]
    base += [(40.0, 260.0, 30.0, "Summe"), (xs[0], 260.0, 6.0, "2"), (40.0, 280.0, 60.0, "Planersteller"), (40.0, 300.0, 30.0, "danach"), (xs[0], 300.0, 6.0, "9")]
    labels = [(100.0, 120.0, 40.0, "Abschnitt"), (100.0, 140.0, 30.0, "Spalte")]
    rows = [(d, 0, i, x, y, x + w, y + 8, t) for d, ws in (("both", base + labels), ("numbers", base), ("few", base[:12])) for i, (x, y, w, t) in enumerate(ws)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, word_id int, x0 double, y0 double, x1 double, y1 double, text string")
    t = pages.extract(df, df.select("doc_id", "page_index").distinct().withColumn("width", F.lit(600.0)))
    cols = [(r["doc_id"], r["address"]) for r in t.columns.orderBy("doc_id", "column_index").collect()]
    want = ["1.1", "1.2", "1.3", "1.4", "1.5", "2.1", "2.2", "2.3", "3.1"]
    assert cols == [(d, a) for d in ("both", "numbers") for a in want]
    for d in ("both", "numbers"):
        got = [(r["row_no"], r["label"], r["kind"]) for r in t.rows.where(F.col("doc_id") == d).orderBy("line").collect()]
        assert got == [(str(i + 1), f"Pumpe{i}", "daten") for i in range(5)] + [("", "Summe", "summe")]
        assert t.cells.where(F.col("doc_id") == d).agg(F.sum("count")).first()[0] == 5 * 3.0 + 2
    # a known lower edge leaves rows over it and sums under it
    edge = df.select("doc_id", "page_index").distinct().withColumn("bottom", F.lit(200.0))
    t = pages.extract(df.where("doc_id = 'both'"), edge.withColumn("width", F.lit(600.0)), edge)
    assert [r["kind"] for r in t.rows.orderBy("line").collect()] == ["daten"] * 3 + ["summe"]


def test_number_text(spark):
    from zeilenwerk.functions.text import general_number

    values = [45983.16, 1234567.0, 12345.65, 3.0, 0.5, 1e-7, -2.25, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(general_number(F.col("v"))).collect()]
    assert got == [None if v is None else f"{v:g}" for v in values]


def test_raster(spark):
    """Lines of random pictures as plain loops find them."""
    import random

    from zeilenwerk.operators import raster

    r = random.Random(6)
    pages = [[[r.choice((0, 0, 0, 200)) if r.random() < 0.8 else 250 for _ in range(40)] for _ in range(60)] for _ in range(2)]
    for y in range(3, 50):
        pages[0][y][7] = 0
    df = spark.createDataFrame([(d, 0, y, row) for d, p in enumerate(pages) for y, row in enumerate(p)], "doc_id int, page_index int, y int, pixels array<int>")

    def spans(line):
        out, start = [], None
        for i, v in enumerate([*line, False]):
            if v and start is None:
                start = i
            elif not v and start is not None:
                out.append((start, i))
                start = None
        return out

    level, upright, ys = set(), set(), set()
    for d, p in enumerate(pages):
        limit = max(60, int(sum(map(sum, p)) / 2400 * 0.6))
        dark = [[v < limit for v in row] for row in p]
        own = sorted({y for y, row in enumerate(dark) for a, b in spans(row) if b - a >= 9})
        level |= {(d, y, a, b) for y, row in enumerate(dark) for a, b in spans(row) if b - a >= 9}
        upright |= {(d, x, a, b) for x in range(40) for a, b in spans([row[x] for row in dark]) if b - a >= 20}
        last = None
        for y in own:
            if last is None or y - last > 3:
                ys.add((d, y))
                last = y
    assert {(x["doc_id"], x["y"], x["start"], x["stop"]) for x in raster.level_runs(df, 9).collect()} == level and level
    assert {(x["doc_id"], x["x"], x["start"], x["stop"]) for x in raster.upright_runs(df).collect()} == upright and upright
    assert {(x["doc_id"], x["y"]) for x in raster.level_lines(df, 9).collect()} == ys


def test_cells(spark):
    """Cells with digits, bars, remnants of frames and specks, as array arithmetic on a whole picture has them; a picture
    without edges has no cell."""
    import numpy as np

    from zeilenwerk.operators import cells

    r = np.random.default_rng(3)
    ys, xs = [2, 30, 37, 60, 95], [4, 40, 44, 70, 71, 110]
    page = np.full((90, 100), 230)  # the last row and column are cut off by the picture's edge
    for n, (y, x) in enumerate([(a, b) for a in ys for b in xs]):
        part = page[y + 3 : y + 22, x + 3 : x + 23]
        if not part.size:
            continue
        if n % 6 == 0:
            part[4:12, 9:11] = 0  # a 1
        elif n % 6 == 1:
            part[:] = np.where(r.random(part.shape) < 0.4, 20, 230)
        elif n % 6 == 2:
            part[:, :2] = 0  # a frame
        elif n % 6 == 3:
            part[5:, 3:9], part[0, :] = 0, 0
        elif n % 6 == 4:
            part[:] = 10
    rows = [(1, 0, y, line.tolist()) for y, line in enumerate(page)] + [(2, 0, 0, [0, 0]), (3, 0, 0, [])]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, y int, pixels array<int>")
    frames = spark.createDataFrame([(1, 0, ys, xs), (2, 0, [], [5]), (3, 0, [0, 30], [0, 30])], "doc_id int, page_index int, ys array<int>, xs array<int>")
    want, boxes = {}, {}
    for i in range(len(ys) - 1):
        for k in range(len(xs) - 1):
            a = page[ys[i] + 3 : ys[i + 1] - 2, xs[k] + 3 : xs[k + 1] - 2] < 128
            if ys[i + 1] - ys[i] < 9 or xs[k + 1] - xs[k] < 9 or not a.mean() > 0.012:
                continue
            side = max(1, a.shape[1] // 5)
            inner = a.mean(axis=0)[side:-side] if a.shape[1] > 2 * side else a.mean(axis=0)
            want[i, k] = bool(inner.max() < 0.15 or a.mean() > 0.75)
            pure = a & (a.mean(axis=1) <= 0.8)[:, None] & (a.mean(axis=0) <= 0.8)[None, :]
            at = np.argwhere(pure)
            if not want[i, k] and len(at) and np.ptp(at[:, 0]) >= 3:
                (y0, x0), (y1, x1) = at.min(axis=0), at.max(axis=0) + 1
                boxes[i, k] = (xs[k] + 3 + x0, ys[i] + 3 + y0, xs[k] + 3 + x1, ys[i] + 3 + y1, (x1 - x0) / (y1 - y0) < 0.45)
    got = cells.filled(df, frames).collect()
    assert {(x["row"], x["column"]): x["remnant"] for x in got} == want and set(want.values()) == {True, False} and {x["doc_id"] for x in got} == {1}
    got = {(x["row"], x["column"]): (x["x0"], x["y0"], x["x1"], x["y1"], x["one"]) for x in cells.marks(df, frames).collect()}
    assert got == boxes and {b[4] for b in boxes.values()} == {True, False}


def test_strips(spark):
    """Strips cover a page below its head, overlap, and carry the head's rows first; one strip is the whole page."""
    from zeilenwerk.operators import cells

    df = spark.createDataFrame([(1, 0, y, [y]) for y in range(100)], "doc_id int, page_index int, y int, pixels array<int>")
    for count, top, head in ((1, 0.0, 0.0), (3, 0.2, 0.1), (7, 0.0, 0.25)):
        got = {}
        for x in cells.stripped(df, count, top, head).orderBy("strip", "y").collect():
            got.setdefault(x["strip"], []).append((x["y"], x["pixels"][0]))
        rows, skipped = int(100 * head), 100 * top
        tall = (100 - skipped) / count
        assert len(got) == count
        for i, strip in got.items():
            lo, hi = int(max(skipped, skipped + i * tall - tall * 0.08)), int(min(100, skipped + (i + 1) * tall + tall * 0.08))
            assert strip == list(enumerate([*range(rows), *range(lo, hi)]))


@pytest.mark.parametrize("angle", [-3.25, -0.5, 0.0, 1.75])
def test_skew(spark, angle):
    """A picture of text lines that was turned is found to a quarter of a degree."""
    import math

    from zeilenwerk.operators import raster

    a = math.radians(angle)
    level = lambda x, y: int(math.floor((y - 149.5) * math.cos(a) - (x - 199.5) * math.sin(a))) % 12 < 4
    rows = [(1, 0, y, [0 if level(x, y) and 20 < x < 380 else 255 for x in range(400)]) for y in range(300)]
    got = raster.skew(spark.createDataFrame(rows, "doc_id int, page_index int, y int, pixels array<int>")).first()["angle"]
    assert abs(got - angle) <= 0.25
