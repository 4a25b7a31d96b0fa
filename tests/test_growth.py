"""Steps that must not grow faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from zeilenwerk import tables
from zeilenwerk.functions.text import natural_number
from zeilenwerk.operators import bands, facts, geometry, reconcile
from zeilenwerk.sources import answers, documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_tables_move_no_rows(spark):
    a = tables.written(spark.range(50).selectExpr("id % 5 as k", "id as v"), "a", ["k"])
    b = tables.written(spark.range(50).selectExpr("id % 5 as k", "id as v", "id + 1 as w"), "b", ["k"], tables.buckets(a))
    both = a.join(b, ["k", "v"]).groupBy("k", "v").agg(F.sum("w").alias("w"))
    assert "Exchange" not in plan(both) and "Broadcast" not in plan(both)
    assert sorted((r.k, r.v, r.w) for r in both.collect()) == sorted((i % 5, i, i + 1) for i in range(50))
    assert tables.written(a.limit(0), "none", ["k"]).count() == 0


def test_rows_that_hold_their_cells(spark):
    one = [(1, 1, 0, "daten", [(0, 2.0), (1, None)]), (1, 2, 0, "summe", [(0, 3.0)]), (1, 3, 1, "daten", [(0, 1.0)]), (1, 4, 1, "summe", [(0, 1.0)]), (1, 5, 1, "uebertrag", []), (1, 6, 1, "uebertrag", None), (2, 1, 0, "uebertrag", [(0, None)])]
    rows = spark.createDataFrame(one, "doc_id long, row_seq int, page_index int, kind string, cells array<struct<column_index:int,count:double>>")
    apart = rows.drop("cells"), rows.select("doc_id", "row_seq", F.inline("cells"))
    for f in (reconcile.page_checks, reconcile.page_findings, reconcile.excluded_findings):
        assert sorted(f(rows).collect()) == sorted(f(*apart).collect())
    assert [(r.row_seq, r.value) for r in reconcile.excluded_findings(rows).collect()] == [(2, 3.0)]
    assert "Join" not in plan(reconcile.page_checks(rows))


def test_counts_without_expanding(spark):
    f = spark.createDataFrame([(1, 1, "A", "k", 1.0), (1, 1, "A", "l", 2.0), (1, 2, "ohne Zuordnung", "k", 3.0), (2, 1, "B", "k", 4.0), (None, 1, "B", "k", 5.0)], "doc_id long, row_seq int, schwerpunkt string, spalte_key string, wert double")
    assert tuple(facts.kpis(f).first()) == (2, 3, 15.0, 2, 2)
    assert tuple(facts.kpis(f.limit(0)).first()) == (0, 0, None, 0, 0)
    assert "doc_id" not in [x for x in plan(facts.kpis(f)).splitlines() if "Expand" in x].__str__()


def test_equal_rectangles_meet_once(spark):
    left = spark.createDataFrame([(i, "p", 0.0, 0.0, 10.0, 10.0) for i in range(200)] + [(900, "p", None, 0.0, 1.0, 1.0), (901, "q", 0.0, 0.0, 9.0, 9.0)], "id int, page string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.without_overlaps(left, left.where("id < 200"), ["page"])
    assert sorted(r.id for r in got.collect()) == [900, 901] and got.columns == left.columns
    assert plan(got).count("collect") == 0 and "__row" not in plan(got)


def test_a_project_is_several_tasks(spark, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "'eins' as project")
    documents.write(docs, str(tmp_path / "s"))
    assert len(list((tmp_path / "s" / "project=eins").glob("*.parquet"))) > 1
    assert documents.read(spark, str(tmp_path / "s"), "eins").count() == 300


def test_cuts_of_bands_travel_without_cells(spark):
    """Cuts go to the index by length and fingerprint, lengths of one profile don't meet in one task; a null key is one."""
    addresses = [f"{s}.{n}" for s, k in ((1, 3), (2, 4), (3, 2)) for n in range(1, k + 1)]
    known = spark.createDataFrame([("p", 1, i, a) for i, a in enumerate(addresses)], "profile_id string, priority int, place int, address string")
    read = {k: [7, 1, 2, 3, None, 2, 3, None, 1, 2, None] for k in [None, *range(30)]} | {30: [1, 2, 3, 4, 5, 6, 7], 31: [1, 2, 3, 1, 1, 3, 4, 1, 2]}
    rows = spark.createDataFrame([(k, i, x) for k, v in read.items() for i, x in enumerate(v)], "band int, place int, number int")
    got = bands.search(rows, known, ["band"])
    moved = [x for x in plan(got).splitlines() if "Exchange hashpartitioning(n#" in x and "REPARTITION_BY_NUM" in x]
    assert moved and all("print#" in x for x in moved) and "hashpartitioning(kind" not in plan(got)
    want = {(k, 1, 10, "p", 1.0, 7) for k in [None, *range(30)]} | {(31, 0, 9, "p", 8 / 9, 9)}
    assert {tuple(r) for r in got.collect()} == want


def test_answers_are_parsed_once(spark):
    """Rows count their own cells, so an answer without a key keeps its cells' number; no join, no second parsing."""
    text = '{"zeilen": [{"klartext": "Teil", "werte": {"0": "2", " 1 ": "frei", "+1": " x ", "-0": "5", "-1": "5", "2": "5", "a": "1", "1.0": "1", "1e0": "1", "0 ": " "}}, {"werte": {"9": "1"}}, {"klartext": "", "bas": " B", "werte": null}, {"werte": {"0": "4"}}]}'
    asked = spark.createDataFrame([(1, 0, 2, text), (None, 0, 2, text), (2, 0, None, text)], "doc_id long, page_index int, n_columns int, answer string")
    rows, cells = answers.answered_rows(asked)
    assert "Join" not in plan(rows) and plan(rows).count("from_json") == plan(cells).count("from_json") == 1
    want = lambda k, n: [(k, 0, "daten", n, True), (k, 2, "leer", 0, False), (k, 3, "daten", 1, True)]
    assert sorted((r.doc_id or 0, r.row_seq, r.kind, r.n_cells, r.has_values) for r in rows.collect()) == want(0, 4) + want(1, 4) + want(2, 2)
    first = [(r.column_index, r.raw_value, r["count"], r.note) for r in cells.where("doc_id = 1 and row_seq = 0").collect()]
    assert sorted(first, key=str) == [(0, "2", 2.0, ""), (0, "5", 5.0, ""), (1, "frei", None, "frei"), (1, "x", 1.0, "")]


def test_numbers_are_cast_only_where_they_look_like_some(spark):
    odd = ["", " ", "0", " 1 ", "+1", "-1", "-0", "-00", "+", "1.0", "1.", "\t2\n", "\x002", "2\x7f", "2\u2028", "2\u0085", "\u00a01", "٣", "1e0", "99999999999", "2147483647", "2147483648", "007", "1 2", "a1", "1_0", None]
    got = spark.createDataFrame([(x,) for x in odd], "k string").select("k", natural_number(F.col("k")).alias("n"), F.col("k").try_cast("int").alias("t"))
    assert got.where("NOT n <=> CASE WHEN t >= 0 THEN t END").count() == 0
    # a cast that fails is slow, so it stands behind the look at the text
    assert "CASE WHEN RLIKE(k" in plan(got.select("n"))


def test_pages_hold_their_words(spark):
    """A page's words are moved once, when they are put together; nothing after that joins, moves or writes them."""
    from zeilenwerk.operators import pages

    xs = [200.0 + 40 * i for i in range(4)]
    words = [(100.0, 120.0, "Abschnitt"), (100.0, 140.0, "Spalte"), (xs[0], 120.0, "1."), (xs[2], 120.0, "02")] + [(x, 140.0, n) for x, n in zip(xs, "1212", strict=True)]
    # two data rows, a sum of them without a label, a number out of order, a footer and what stands under it
    lines = [("1", "Pumpe", "2", "x"), ("2", "Ventil", "3", "4"), ("", "", "5", "5"), ("1", "Klappe", "1", "frei"), ("", "Legende", "", ""), ("9", "danach", "7", "")]
    words += [(x, 160.0 + 20 * r, t) for r, line in enumerate(lines) for x, t in zip((20.0, 50.0, xs[0], xs[1]), line, strict=True) if t]
    rows = [(d, 0, i, x, y, x + 8, y + 8, t) for d in range(3) for i, (x, y, t) in enumerate(words if d < 2 else words[:19])]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, word_id int, x0 double, y0 double, x1 double, y1 double, text string")
    t = pages.extract(df, df.select("doc_id", "page_index").distinct().withColumn("width", F.lit(600.0)))
    for table in (t.columns, t.rows, t.cells, t.warnings, t.heads):
        assert plan(table).count("Join") == 1 and plan(table).count("Window") == 0  # the page's width
    kinds = [("1", "Pumpe", "daten"), ("2", "Ventil", "daten"), ("", "", "summe"), ("1", "Klappe", "daten")]
    assert [(r.doc_id, r.row_no, r.label, r.kind) for r in t.rows.orderBy("doc_id", "line").collect()] == [(d, *k) for d in (0, 1) for k in kinds]
    assert [(r.line, r.column_label, r.address, r["count"], r.note) for r in t.cells.where("doc_id = 1 and line in (0, 3)").orderBy("line", "column_index").collect()] == [(0, "", "1.1", 2.0, ""), (0, "", "1.2", 1.0, ""), (3, "", "1.1", 1.0, ""), (3, "", "1.2", None, "frei")]
    assert [tuple(r) for r in t.warnings.where("doc_id = 0").collect()] == [(0, 0, 3, 2, 1)]


def test_an_audit_in_one_pass(spark):
    """Sums and uncounted rows come out of one reading of the rows; both forms of cells give the same."""
    from zeilenwerk.operators import reports

    one = [(1, 1, 0, "daten", [(0, 2.0), (1, None)]), (1, 2, 0, "summe", [(0, 3.0), (0, 0.5), (7, 1.0)]), (1, 3, 1, "uebertrag", [(1, 9.0)]), (1, 4, 1, "leer", []), (1, 5, 1, "leer", None), (2, 1, 0, "summe", [(0, None)]), (3, 1, 0, "daten", [(0, 1.0)])]
    rows = spark.createDataFrame(one, "doc_id long, row_seq int, page_index int, kind string, cells array<struct<column_index:int,count:double>>")
    rows = rows.select("*", F.concat(F.lit("Teil "), "row_seq").alias("datenpunkt"), F.col("row_seq").cast("string").alias("row_no"), F.concat(F.lit("Art "), "kind").alias("reason"))
    documents = spark.createDataFrame([(1, "eins"), (2, "zwei")], "doc_id long, datei string")
    columns = spark.createDataFrame([(0, "1.1", "Menge"), (1, "1.2", None)], "column_index int, adresse string, label string")
    held = reports.audit_report(documents, rows, None, columns)
    apart = reports.audit_report(documents, rows.drop("cells"), rows.select("doc_id", "row_seq", F.inline("cells")), columns)
    assert plan(held).count("Scan") == 3 and "Union" not in plan(held)
    sums, left = ("Summenabgleich", None, ""), "nicht gezählte Zeile"
    want = {(sums[0], "1.1", "Menge", None, "", 3.5, 2.0, "ABWEICHUNG", "", "eins"), (sums[0], "7", "", None, "", 1.0, 0.0, "ABWEICHUNG", "", "eins")}
    want |= {(left, "", f"Teil {n}", p, str(n), v, 0.0, k, f"Art {k}", d) for d, n, p, v, k in (("eins", 2, 1, 4.5, "summe"), ("eins", 3, 2, 9.0, "uebertrag"), ("eins", 4, 2, 0.0, "leer"), ("eins", 5, 2, 0.0, "leer"), ("zwei", 1, 1, 0.0, "summe"))}
    for df in (held, apart):
        got = [tuple(r) for r in df.collect()]
        assert set(got) == want and len(got) == len(want)


def test_sheets_rows_hold_their_cells(spark):
    """Heads are put together a row a sheet, a body's rows meet them once and nothing else; both kinds of heads do."""
    from zeilenwerk.operators import sheets

    head = [(5, 2, "Abschnitt"), (5, 3, "1."), (5, 5, "4"), (6, 2, "Spalte"), (6, 3, "1"), (6, 4, "2"), (6, 5, "1"), (6, 6, "2")]
    body = [(7, 0, "1"), (7, 1, "Pumpe"), (7, 3, "2"), (7, 4, "x"), (8, 1, "Ventil"), (8, 3, "3"), (8, 4, "4"), (8, 6, "siehe"), (9, 3, "5"), (9, 4, "5"), (10, 9, "nichts"), (12, 1, "Legende"), (13, 3, "7")]
    cells = [(d, s, *x) for d, s in (("a", 0), ("a", 1), ("b", 0)) for x in head + body if (d, x[:2]) != ("b", (9, 3))] + [("c", 0, *x) for x in head[:6] + body]
    lines = sheets.lines(spark.createDataFrame(cells, "doc_id string, sheet int, r int, c int, value string"))
    for texts in (True, False):
        heads = sheets.heads(lines, texts)
        assert "Join" not in plan(heads) and [(r.doc_id, len(r.columns or [])) for r in heads.orderBy("doc_id", "sheet").collect()] == [("a", 4), ("a", 4), ("b", 4), ("c", 0)]
        rows, cells = sheets.tables(lines, heads)
        assert "Join" not in plan(cells)
        want = lambda d, s, last: [(d, s, 7, "1", "Pumpe", "", "daten"), (d, s, 8, "", "Ventil", "siehe", "daten"), (d, s, 9, "", "", "", last)]
        got = rows.orderBy("doc_id", "sheet", "row_seq").select("doc_id", "sheet", "row_seq", "row_no", "label", "remark", "kind").collect()
        assert [tuple(r) for r in got] == want("a", 0, "summe") + want("a", 1, "summe") + want("b", 0, "daten")[:2] + [("b", 0, 9, "", "", "", "summe")]
        assert [(r.row_seq, r.column_index, r.raw_value, r["count"], r.note) for r in cells.where("doc_id = 'b'").orderBy("row_seq", "column_index").collect()] == [(7, 0, "2", 2.0, ""), (7, 1, "x", 1.0, ""), (8, 0, "3", 3.0, ""), (8, 1, "4", 4.0, ""), (8, 3, "siehe", None, "siehe"), (9, 1, "5", 5.0, "")]
