"""Kept sums, streams, document stores and workbooks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from zeilenwerk.operators import maintenance
from zeilenwerk.operators.reconcile import page_checks

FACTS = "doc_id long, page_index int, row_seq int, kind string, cells array<struct<column_index: int, count: double>>"


def _facts(spark):
    rows = []
    for d in range(60):
        for n in range(9):
            kind = ("daten", "daten", "daten", "summe")[n % 4] if n < 8 else "uebertrag"
            rows.append((d, n // 4, n, kind, [(c, float(d % 5 + n + c)) for c in range(3)]))
    return spark.createDataFrame(rows, FACTS)


def _files(path: Path) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_edits(spark, tmp_path):
    """After edits the checks are those of the whole table, and other buckets' files stay as they were."""
    at, facts = str(tmp_path / "s"), _facts(spark)
    maintenance.create(facts, at, 16)
    before = _files(tmp_path / "s")
    cells = spark.createDataFrame([(3, 1, 0, 99.0), (3, 2, 1, None), (3, 2, 7, 5.0), (999, 1, 0, 1.0)], "doc_id long, row_seq int, column_index int, count double")
    kinds = spark.createDataFrame([(7, 3, "leer"), (7, 7, "leer")], "doc_id long, row_seq int, kind string")
    pages = {tuple(r) for r in maintenance.edit(spark, at, cells, kinds, 16).collect()}
    assert pages == {(3, 0), (7, 0), (7, 1)}
    key = F.struct("doc_id", "row_seq")
    whole = facts.withColumn("cells", F.when(key == F.struct(F.lit(3).cast("long").alias("doc_id"), F.lit(1).alias("row_seq")), F.expr("transform(cells, c -> if(c.column_index = 0, struct(c.column_index, double(99) as count), c))")).otherwise(F.col("cells")))
    whole = whole.withColumn("cells", F.when((F.col("doc_id") == 3) & (F.col("row_seq") == 2), F.expr("concat(filter(cells, c -> c.column_index <> 1), array(struct(7 as column_index, double(5) as count)))")).otherwise(F.col("cells")))
    whole = whole.withColumn("kind", F.when((F.col("doc_id") == 7) & F.col("row_seq").isin(3, 7), "leer").otherwise(F.col("kind")))
    want = page_checks(whole.drop("cells"), whole.select("doc_id", "row_seq", F.inline("cells")))
    assert sorted(map(tuple, maintenance.checks(spark, at).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    after = _files(tmp_path / "s")
    hit = {f"bucket={r[0]}" for r in spark.createDataFrame([(3,), (7,), (999,)], "doc_id long").select(maintenance.bucket(16)).collect()}
    same = lambda files: {p: t for p, t in files.items() if p.split(os.sep)[-2] not in hit}
    assert same(before) == same(after) and same(before) and before != after
    plan = spark.read.parquet(f"{at}/facts").where(F.col("bucket").isin(3))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]


def test_last_check_goes(spark, tmp_path):
    at = str(tmp_path / "s")
    maintenance.create(_facts(spark).where("doc_id = 5"), at, 4)
    assert maintenance.checks(spark, at).count() > 0
    maintenance.edit(spark, at, kinds=spark.createDataFrame([(5, n, "leer") for n in range(9)], "doc_id long, row_seq int, kind string"), buckets=4)
    assert not _files(tmp_path / "s" / "checks")


def _streamed(spark, tmp_path, schema, parts, transform, mode="append"):
    """What a stream gives of rows that arrive in these parts, a micro-batch each."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for p in source.glob("part-*.parquet"):
            if not p.name.startswith("part-9"):
                p = p.rename(source / f"part-9{i:03}.parquet")
                os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    return spark.read.parquet(str(out))


def test_focus_stream(spark, tmp_path):
    """Rows cut into batches anywhere get the foci that they get at once: over pages, sum rows and batches."""
    import random

    from zeilenwerk.streaming import focus

    r = random.Random(2)
    schema = "doc_id string, page_index int, row_seq int, kind string, code string, code_label string"
    rows = [(f"d{d}", n // 7, n, r.choice(["daten"] * 5 + ["summe"]), r.choice([None, None, "", "ASP01", "ISP02"]), r.choice([None, "Anlage"])) for d in range(4) for n in range(30)]
    rows.sort(key=lambda x: (x[2] + int(x[0][1]) * 3, x[0]))
    parts = [rows[:1], rows[1:20], rows[20:90], rows[90:]]
    for p in parts:
        r.shuffle(p)
    # batches without rows would go on for ever, as time-outs are looked for in each
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = _streamed(spark, tmp_path, schema, parts, focus.carried)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    want = focus.carried_at_once(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_stream(spark, tmp_path):
    """Gap clusters of a stream are those of the table; the watermark closes them."""
    from datetime import datetime, timedelta

    from zeilenwerk.streaming.ingest import sessions

    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(minutes=m)) for u, ms in ((1, (0, 5, 9, 60, 62, 200)), (2, (3, 50, 55, 59, 63))) for m in ms]
    rows.sort(key=lambda x: x[1])
    last = [(9, start + timedelta(days=9))]
    schema = "user_id long, ts timestamp"
    got = _streamed(spark, tmp_path, schema, [rows[:4], rows[4:8], rows[8:], last, [(9, start + timedelta(days=19))]], lambda df: sessions(df, "10 minutes"))
    want = sessions(spark.createDataFrame(rows, schema), "10 minutes")
    assert sorted(tuple(r) for r in got.where("user_id < 9").collect()) == sorted(map(tuple, want.collect()))


def _read_back(spark, path):
    from zeilenwerk.sources import files

    found = files.files(spark, str(path))
    return {(r["sheet"], r["r"], r["c"]): r["value"] for r in files.grid_cells(found).collect()}


def _as_text(r) -> str:
    if r["number"] is None:
        return (r["text"] or "").strip()
    return str(int(r["number"])) if r["number"] == int(r["number"]) else repr(r["number"])


def test_workbook_round_trip(spark, tmp_path):
    """A workbook read again has the cells that were written, and its formulas follow from other sheets by their keys."""
    import re
    import zipfile

    from zeilenwerk.operators import facts
    from zeilenwerk.sinks import workbook as wb
    from zeilenwerk.sources import testdata as td

    at = "/root/testdata/sf0.001"
    docs = td.documents(spark, at).where("doc_id < 60")
    raw = facts.raw_of_rows(docs, td.rows_with_cells(spark, at).where("doc_id < 60"), td.columns(spark))
    cols = [wb.HeadColumn(k, g, u, x, a, p) for (_, k, a, g, u, x, _), p in zip(td.COLUMNS, (1.5, 0.0, 2.0, 10.0), strict=True)]
    path = tmp_path / "out" / "a.xlsx"
    path.parent.mkdir()
    odd = spark.createDataFrame([(1, "a <b> & \"c\"\x07 é"), (2, None), (3, " x ")], "n int, t string")
    wb.export(str(path), raw, docs, cols, {"Prüfung": (odd, [F.col("n")])})
    assert [p.name for p in path.parent.iterdir()] == ["a.xlsx"]
    got = _read_back(spark, path.parent)
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]+)"', z.read("xl/workbook.xml").decode())
        over = z.read("xl/worksheets/sheet1.xml").decode()
        cost = z.read("xl/worksheets/sheet6.xml").decode()
    assert names == ["Übersicht", "Schwerpunkte", "Mengen je Schwerpunkt", "GA-Funktionsliste", "Spaltensummen", "Kostenschätzung", "Prüfung", "Rohdaten", "Dokumente", "Info"]
    assert {v for (s, _, _), v in got.items() if s == 6} == {"n", "t", "1", "2", "3", 'a <b> & "c" é', "x"}
    # sums by the hidden key, evaluated by hand, are the stored values
    listing = {(r, c): v for (s, r, c), v in got.items() if s == 3}
    key_at = 3 + len(cols)
    sums: dict = {}
    for (r, c), v in listing.items():
        if r >= wb.HEAD_ROWS and 3 <= c < key_at:
            k = listing[r, key_at], c - 3
            sums[k] = sums.get(k, 0.0) + float(v)
    first = {(r, c): v for (s, r, c), v in got.items() if s == 0}
    n = docs.count()
    for r in range(wb.HEAD_ROWS, wb.HEAD_ROWS + n):
        for i in range(len(cols)):
            assert abs(float(first[r, 2 + i]) - sums.get((first[r, 3 + len(cols)], i), 0.0)) < 1e-6
    assert "SUMIFS('GA-Funktionsliste'!$D$6:$D$" in over and "COUNTIFS(" in over and f"<f>C{wb.HEAD_ROWS + n + 1}*C{wb.HEAD_ROWS + n + 2}</f>" in over
    assert f"<f>'Übersicht'!C{wb.HEAD_ROWS + n + 1}</f>" in cost and "<f>F2*G2</f>" in cost and 'hidden="1"' in over
    total = raw.agg(F.sum("wert")).first()[0]
    assert abs(sum(float(first[wb.HEAD_ROWS + n, 2 + i]) for i in range(len(cols))) - total) < 1e-3


def test_workbook_fails_whole(spark, tmp_path):
    """A task that fails leaves no workbook and no parts."""
    import pytest

    from zeilenwerk.sinks import workbook as wb

    rows = spark.range(8).select(F.col("id").cast("int").alias("r"), F.array(wb.cell(0, F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")))).alias("cells"))
    with pytest.raises(Exception, match="lost"):
        wb.save([wb.Sheet("a", rows)], str(tmp_path / "b.xlsx"))
    assert not list(tmp_path.iterdir())
    big = spark.range(1).select(F.lit(wb.ROWS).alias("r"), F.array(wb.cell(0, F.lit(1))).alias("cells"))
    with pytest.raises(Exception, match="Parquet"):
        wb.save([wb.Sheet("a", big)], str(tmp_path / "c.xlsx"))
    assert not list(tmp_path.iterdir())


def test_store_is_pruned(spark, tmp_path):
    """Reading a store by project and number touches one partition, pushes the filter and reads the fields asked for."""
    from zeilenwerk.sources import documents as store

    docs = spark.createDataFrame([(i, f"p{i % 3}", f"Liste {i}", None if i == 4 else f"2024-01-0{i % 7 + 1}") for i in range(12)], "doc_id long, project string, datei string, importiert_am string")
    rows = spark.createDataFrame([(i, n, "daten", f"Teil {n}", [(0, 1.0)]) for i in range(11) for n in (2, 0, 1)], "doc_id long, row_seq int, kind string, datenpunkt string, cells array<struct<c: int, v: double>>")
    at = str(tmp_path / "s")
    store.write(store.nested(docs, {"rows": ["row_seq"]}, rows=rows), at)
    found = store.read(spark, at, "p1").where("doc_id > 5").select("doc_id", "rows.kind")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "(project" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "rows:array<struct<kind:string>>" in plan and "cells" not in plan.split("ReadSchema")[1]
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == [7, 10]
    every = store.read(spark, at)
    assert [r["row_seq"] for r in store.children(every.where("doc_id = 3"), "rows").orderBy("n").collect()] == [0, 1, 2]
    assert every.where("doc_id = 11").first()["rows"] == [] and store.newest_first(every).collect()[-1]["doc_id"] == 4
    before = _files(tmp_path / "s" / "project=p0")
    store.write(store.nested(docs.where("project = 'p1'").limit(1), {}, rows=rows), at)
    assert _files(tmp_path / "s" / "project=p0") == before and store.read(spark, at, "p1").count() == 1
