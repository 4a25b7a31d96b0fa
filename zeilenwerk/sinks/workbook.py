"""Workbooks (.xlsx) as a sink: `df.write.format("zeilenwerk_workbook")`.

Rows are cells: sheet (its number), r, c (from 0), text, number, formula. A formula is stored with the value that text or
number gives it, so that readers which don't calculate see it, too. Tasks write their rows of a sheet as parts beside the
file; commit puts the parts in order into the archive, a stream at a time, and abort removes them, so a failed job leaves
no workbook, and parts of lost attempts are in no archive. A sheet ends at ROWS, as the format has it: more are an error,
and such tables go to Parquet.

Values in a sheet are formulas where they follow from other sheets: sums of a list by its hidden key, columns' totals,
costs. Whoever deletes rows of the list sees all of them change.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators import facts
from ..shipping import ship

FORMAT = "zeilenwerk_workbook"
#: Rows of a sheet, as the format has it.
ROWS = 1_048_576
CELL = "struct<c: int, text: string, number: double, formula: string>"
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def letters(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, k = divmod(c - 1, 26)
        out = chr(65 + k) + out
    return out


def _xml(cell) -> str:
    ref = f"{letters(cell['c'])}{cell['r'] + 1}"
    formula = f"<f>{escape(_NO_XML.sub('', cell['formula']))}</f>" if cell["formula"] else ""
    if cell["number"] is not None:
        return f'<c r="{ref}">{formula}<v>{cell["number"]!r}</v></c>'
    text = escape(_NO_XML.sub("", cell["text"] or ""))
    if formula:
        return f'<c r="{ref}" t="str">{formula}<v>{text}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


@dataclass
class Parts(WriterCommitMessage):
    """(sheet, first row, last row, file) of a task's parts."""

    parts: list[tuple[int, int, int, str]]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.sheets = json.loads(options["sheets"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _fs(self):
        from pyarrow import fs

        at = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        found, _ = fs.FileSystem.from_uri(at)
        return found, lambda p: re.sub(r"^file:(//)?", "", p) if p.startswith("file:") or "://" not in p else fs.FileSystem.from_uri(p)[1]

    def write(self, iterator: Iterator) -> Parts:
        fs, plain = self._fs()
        fs.create_dir(plain(self.parts), recursive=True)
        done, out, sheet, row = [], None, None, None

        def close() -> None:
            if out:
                out.write(b"</row>")
                out.close()

        for cell in iterator:
            if cell["sheet"] != sheet:
                close()
                sheet, row = cell["sheet"], None
                name = f"{self.parts}/{sheet}-{uuid.uuid4().hex}.xml"
                out = fs.open_output_stream(plain(name))
                done.append((sheet, cell["r"], cell["r"], name))
            if cell["r"] != row:
                if cell["r"] >= ROWS:
                    raise ValueError(f"a sheet ends at {ROWS} rows; write this table as Parquet")
                out.write((f'<row r="{cell["r"] + 1}">' if row is None else f'</row><row r="{cell["r"] + 1}">').encode())
                row = cell["r"]
                done[-1] = (*done[-1][:2], row, done[-1][3])
            out.write(_xml(cell).encode())
        close()
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, plain = self._fs()
        parts = sorted(p for m in messages if m for p in m.parts)
        for a, b in zip(parts, parts[1:], strict=False):
            if a[0] == b[0] and a[2] >= b[1]:
                raise ValueError("a row of a sheet came from two tasks: order the cells by sheet and row")
        if not self.overwrite and fs.get_file_info(plain(self.path)).type.name != "NotFound":
            raise ValueError(f"{self.path} exists")
        n = range(len(self.sheets))
        with fs.open_output_stream(plain(self.path)) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            named = "".join(f'<sheet name={quoteattr(s["name"])} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(self.sheets))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{named}</sheets><calcPr fullCalcOnLoad="1"/></workbook>')
            links = "".join(f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in n)
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
            for i, s in enumerate(self.sheets):
                with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as out:
                    out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{_view(s)}<sheetData>'.encode())
                    for sheet, _, _, name in parts:
                        if sheet == i:
                            with fs.open_input_stream(plain(name)) as part:
                                while chunk := part.read(1 << 20):
                                    out.write(chunk)
                    merged = "".join(f'<mergeCell ref="{m}"/>' for m in s.get("merged", []))
                    tail = f'<mergeCells count="{len(s["merged"])}">{merged}</mergeCells>' if merged else ""
                    out.write(f"</sheetData>{tail}</worksheet>".encode())
        self._clean(fs, plain)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clean(*self._fs())

    def _clean(self, fs, plain) -> None:
        if fs.get_file_info(plain(self.parts)).type.name == "Directory":
            fs.delete_dir(plain(self.parts))


def _view(s: dict) -> str:
    """Frozen rows, widths and hidden columns."""
    top = int(s.get("frozen", 0))
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{top}" topLeftCell="A{top + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if top else ""
    hidden, widths = set(s.get("hidden", [])), s.get("widths", [])
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{widths[i] if i < len(widths) else 12}" customWidth="1"{" hidden=" + chr(34) + "1" + chr(34) if i in hidden else ""}/>' for i in range(max(len(widths), max(hidden, default=-1) + 1)))
    return pane + (f"<cols>{cols}</cols>" if cols else "")


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "sheet int, r int, c int, text string, number double, formula string"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), overwrite)


@dataclass
class Sheet:
    """A sheet's cells (r, cells: array of CELL) and its looks (hidden columns, frozen rows, merged areas)."""

    name: str
    rows: DataFrame
    hidden: tuple[int, ...] = ()
    frozen: int = 1
    merged: tuple[str, ...] = ()


def cell(c: int | Column, value: Column, formula: Column | None = None) -> Column:
    """A cell of a number or a text, by the type of value; formula without the sign before it."""
    text = F.lit(None).cast("string")
    return F.struct((F.lit(c) if isinstance(c, int) else c).cast("int").alias("c"), F.when(value.try_cast("double").isNull(), value.cast("string")).otherwise(text).alias("text"), value.try_cast("double").alias("number"), (text if formula is None else formula).alias("formula")).cast(CELL)


def text_cell(c: int, value: Column) -> Column:
    return F.struct(F.lit(c).alias("c"), F.coalesce(value.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("formula")).cast(CELL)


def _fixed(spark: SparkSession, r: int, *cells: Column) -> DataFrame:
    return spark.range(1).select(F.lit(r).alias("r"), F.array(*cells).alias("cells"))


def frame(df: DataFrame, name: str, order: list[Column], titles: dict[str, str] | None = None) -> Sheet:
    """Any table: its columns' names (or titles) above its rows; numbers stay numbers, lists are joined, dates are without
    fractions. A sheet has ROWS rows at most, so its rows may be numbered in one order."""
    shown = []
    for i, f in enumerate(df.schema.fields):
        kind = f.dataType.typeName()
        x = F.col(f"`{f.name}`")
        if kind == "array":
            x = F.array_join(x.cast("array<string>"), ", ")
        elif kind.startswith("timestamp"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        number = kind in ("byte", "short", "integer", "long", "float", "double", "decimal")
        shown.append(F.when(x.isNotNull(), cell(i, x)) if number else text_cell(i, x))
    rows = df.withColumn("__r", F.row_number().over(W.orderBy(*order)))
    head = _fixed(df.sparkSession, 0, *[text_cell(i, F.lit((titles or {}).get(c, c))) for i, c in enumerate(df.columns)])
    return Sheet(name, head.unionByName(rows.select(F.col("__r").cast("int").alias("r"), F.array_compact(F.array(*shown)).alias("cells"))))


@dataclass
class HeadColumn:
    """A function column of the head: key, group, subgroup, label, address, unit price."""

    key: str
    group: str
    subgroup: str
    label: str
    address: str
    price: float = 0.0


#: Rows of a list's head: group, subgroup, label, section and column number.
HEAD_ROWS = 5
LIST_FIELDS = ("Zeile Nr.", "Datenpunkt", "Schwerpunkt")


def _head(spark: SparkSession, fields: tuple[str, ...], cols: list[HeadColumn], key_at: int) -> tuple[DataFrame, tuple[str, ...]]:
    """The head's rows: groups and subgroups merged over their columns, labels, sections and numbers; the hidden key's
    title."""
    first, merged, rows = len(fields), [], []
    for r, of in enumerate(("group", "subgroup")):
        start, cells = 0, []
        for i in range(1, len(cols) + 1):
            if i == len(cols) or getattr(cols[i], of) != getattr(cols[start], of):
                cells.append(text_cell(first + start, F.lit(getattr(cols[start], of))))
                if i - start > 1:
                    merged.append(f"{letters(first + start)}{r + 1}:{letters(first + i - 1)}{r + 1}")
                start = i
        rows.append(cells)
    rows.append([text_cell(i, F.lit(f)) for i, f in enumerate(fields)] + [text_cell(first + i, F.lit(c.label)) for i, c in enumerate(cols)] + [text_cell(key_at, F.lit("Schlüssel"))])
    rows.append([text_cell(first + i, F.lit(c.address.rpartition(".")[0] or c.address)) for i, c in enumerate(cols)])
    rows.append([text_cell(first + i, F.lit(c.address.rpartition(".")[2])) for i, c in enumerate(cols)])
    out = _fixed(spark, 0, *rows[0])
    for r, cells in enumerate(rows[1:], 1):
        out = out.unionByName(_fixed(spark, r, *cells))
    return out, tuple(merged)


def function_list(layout: DataFrame, cols: list[HeadColumn], name: str) -> tuple[Sheet, int]:
    """The list itself (layout: doc_id, row_seq, row_no, datenpunkt, schwerpunkt, a number for each key), with the
    document's key in a hidden column. Gives its number of rows, too."""
    first, key_at = len(LIST_FIELDS), len(LIST_FIELDS) + len(cols)
    rows = layout.withColumn("__r", F.row_number().over(W.orderBy("doc_id", "row_seq")) + HEAD_ROWS - 1)
    values = [F.when(F.col(c.key).isNotNull(), cell(first + i, F.col(c.key))) for i, c in enumerate(cols)]
    fields = [text_cell(i, F.col(f)) for i, f in enumerate(("row_no", "datenpunkt", "schwerpunkt"))]
    body = rows.select(F.col("__r").cast("int").alias("r"), F.array_compact(F.array(*fields, *values, text_cell(key_at, F.col("doc_id")))).alias("cells"))
    head, merged = _head(layout.sparkSession, LIST_FIELDS, cols, key_at)
    return Sheet(name, head.unionByName(body), (key_at,), HEAD_ROWS, merged), layout.count()


def overview(matrix: DataFrame, cols: list[HeadColumn], name: str, listing: str, n: int, currency: str = "EUR") -> tuple[Sheet, dict[str, str]]:
    """A row a document (matrix: doc_id, datei, a number for each key, n_rows), each number a sum over the list `listing` of n
    rows by its key; then totals, unit prices and costs. Gives where each key's total stands, too."""
    spark = matrix.sparkSession
    first, last = 2, 1 + len(cols)
    key_list = letters(len(LIST_FIELDS) + len(cols))
    area = lambda letter: f"'{listing}'!${letter}${HEAD_ROWS + 1}:${letter}${HEAD_ROWS + max(n, 1)}"
    mine = F.concat(F.lit(f"${letters(last + 2)}"), (F.col("__r") + 1).cast("string"))
    sums = [cell(first + i, F.col(c.key), F.concat(F.lit(f"SUMIFS({area(letters(len(LIST_FIELDS) + i))},{area(key_list)},"), mine, F.lit(")"))) for i, c in enumerate(cols)]
    rows = matrix.withColumn("__r", F.row_number().over(W.orderBy("datei", "doc_id")) + HEAD_ROWS - 1)
    total = sum((F.col(c.key) for c in cols), F.lit(0.0))
    at = (F.col("__r") + 1).cast("string")
    row_sum = cell(last + 1, total, F.concat(F.lit(f"SUM({letters(first)}"), at, F.lit(f":{letters(last)}"), at, F.lit(")")))
    count = cell(1, F.col("n_rows"), F.concat(F.lit(f"COUNTIFS({area(key_list)},"), mine, F.lit(")")))
    body = rows.select(F.col("__r").cast("int").alias("r"), F.array(text_cell(0, F.col("datei")), count, *sums, row_sum, text_cell(last + 2, F.col("doc_id"))).alias("cells"))
    k = matrix.count()
    end, base = HEAD_ROWS + k, HEAD_ROWS + 1
    of = matrix.agg(*[F.coalesce(F.sum(c.key), F.lit(0.0)).alias(c.key) for c in cols])
    line = lambda r, title, cells: of.select(F.lit(r).alias("r"), F.array(text_cell(0, F.lit(title)), *cells).alias("cells"))
    col = lambda i: letters(first + i)
    totals = [cell(first + i, F.col(c.key), F.lit(f"SUM({col(i)}{base}:{col(i)}{end})")) for i, c in enumerate(cols)]
    costs = [cell(first + i, F.col(c.key) * c.price, F.lit(f"{col(i)}{end + 1}*{col(i)}{end + 2}")) for i, c in enumerate(cols)]
    whole = lambda r, value: cell(last + 1, value, F.lit(f"SUM({letters(first)}{r}:{letters(last)}{r})"))
    tail = line(end, "Summe Funktionen", [*totals, whole(end + 1, total)])
    tail = tail.unionByName(line(end + 1, f"Einheitspreis [{currency}]", [cell(first + i, F.lit(c.price)) for i, c in enumerate(cols)]))
    tail = tail.unionByName(line(end + 2, f"Kosten [{currency}]", [*costs, whole(end + 3, sum((F.col(c.key) * c.price for c in cols), F.lit(0.0)))]))
    head, merged = _head(spark, ("Datei", "Zeilen"), cols, last + 2)
    return Sheet(name, head.unionByName(body).unionByName(tail), (last + 2,), HEAD_ROWS, merged), {c.key: f"'{name}'!{col(i)}{end + 1}" for i, c in enumerate(cols)}


def column_sums(summary: DataFrame, totals: dict[str, str], name: str = "Spaltensummen", extra: tuple[str, ...] = ()) -> Sheet:
    """summary (adresse, spalte_key, gruppe, untergruppe, label, menge, ...) with each quantity a reference to its total, and
    the sum below. A catalogue's columns, so it is small."""
    cols = ["adresse", "spalte_key", "gruppe", "untergruppe", "label", "menge", *extra]
    rows = summary.select(*cols).withColumn("__r", F.row_number().over(W.orderBy("adresse", "spalte_key")))
    known = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]) if totals else F.create_map().cast("map<string,string>")
    shown = [cell(i, F.col(c), F.element_at(known, F.col("spalte_key"))) if c == "menge" else (cell(i, F.col(c)) if c in extra else text_cell(i, F.col(c))) for i, c in enumerate(cols)]
    body = rows.select(F.col("__r").cast("int").alias("r"), F.array(*shown).alias("cells"))
    end = summary.count()
    last = summary.agg(F.coalesce(F.sum("menge"), F.lit(0.0)).alias("m")).select(F.lit(end + 1).alias("r"), F.array(text_cell(0, F.lit("Summe Funktionen")), cell(5, F.col("m"), F.lit(f"SUM(F2:F{end + 1})"))).alias("cells"))
    return Sheet(name, _fixed(summary.sparkSession, 0, *[text_cell(i, F.lit(c)) for i, c in enumerate(cols)]).unionByName(body).unionByName(last))


def costs(summary: DataFrame, totals: dict[str, str], name: str = "Kostenschätzung", sums: str = "Spaltensummen") -> Sheet:
    """summary (adresse, spalte_key, gruppe, untergruppe, label, menge, preis): quantity by reference, price, and their
    product; totals below."""
    names = ["adresse", "gruppe", "untergruppe", "label", "spalte_key"]
    rows = summary.withColumn("__r", F.row_number().over(W.orderBy("adresse", "spalte_key")))
    at = (F.col("__r") + 1).cast("string")
    known = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]) if totals else F.create_map().cast("map<string,string>")
    quantity = F.coalesce(F.element_at(known, F.col("spalte_key")), F.concat(F.lit(f"'{sums}'!F"), at))
    shown = [*[text_cell(i, F.col(c)) for i, c in enumerate(names)], cell(5, F.col("menge"), quantity), cell(6, F.col("preis")), cell(7, F.col("menge") * F.col("preis"), F.concat(F.lit("F"), at, F.lit("*G"), at))]
    body = rows.select(F.col("__r").cast("int").alias("r"), F.array(*shown).alias("cells"))
    end = summary.count()
    last = summary.agg(F.coalesce(F.sum("menge"), F.lit(0.0)).alias("m"), F.coalesce(F.sum(F.col("menge") * F.col("preis")), F.lit(0.0)).alias("k")).select(F.lit(end + 1).alias("r"), F.array(text_cell(0, F.lit("Gesamtkosten")), cell(5, F.col("m"), F.lit(f"SUM(F2:F{end + 1})")), cell(7, F.col("k"), F.lit(f"SUM(H2:H{end + 1})"))).alias("cells"))
    return Sheet(name, _fixed(summary.sparkSession, 0, *[text_cell(i, F.lit(c)) for i, c in enumerate([*names, "menge", "preis", "kosten"])]).unionByName(body).unionByName(last))


def matrix_sheet(matrix: DataFrame, fields: tuple[str, ...], cols: list[HeadColumn], name: str) -> Sheet:
    """fields and a number for each key, with the sum of every row and column as formulas."""
    first, last = len(fields), len(fields) + len(cols) - 1
    rows = matrix.withColumn("__r", F.row_number().over(W.orderBy(*fields)))
    at = (F.col("__r") + 1).cast("string")
    total = sum((F.col(c.key) for c in cols), F.lit(0.0))
    shown = [*[text_cell(i, F.col(f)) for i, f in enumerate(fields)], *[cell(first + i, F.col(c.key)) for i, c in enumerate(cols)], cell(last + 1, total, F.concat(F.lit(f"SUM({letters(first)}"), at, F.lit(f":{letters(last)}"), at, F.lit(")")))]
    body = rows.select(F.col("__r").cast("int").alias("r"), F.array(*shown).alias("cells"))
    end = matrix.count()
    sums = [cell(first + i, F.col(c.key), F.lit(f"SUM({letters(first + i)}2:{letters(first + i)}{end + 1})")) for i, c in enumerate(cols)]
    tail = matrix.agg(*[F.coalesce(F.sum(c.key), F.lit(0.0)).alias(c.key) for c in cols]).select(F.lit(end + 1).alias("r"), F.array(text_cell(0, F.lit("Summe")), *sums).alias("cells"))
    return Sheet(name, _fixed(matrix.sparkSession, 0, *[text_cell(i, F.lit(f)) for i, f in enumerate((*fields, *[c.label for c in cols], "Summe"))]).unionByName(body).unionByName(tail))


def export(path: str, raw: DataFrame, documents: DataFrame, cols: list[HeadColumn], frames: dict[str, tuple[DataFrame, list[Column]]] | None = None, with_raw: bool = True) -> None:
    """The whole evaluation of raw facts (operators.facts) as a workbook: Übersicht, Schwerpunkte, Mengen je Schwerpunkt,
    GA-Funktionsliste, Spaltensummen, Kostenschätzung, the given frames (name: table and its order), Rohdaten, Dokumente and
    Info. documents: doc_id, datei, ...; raw data beyond a sheet's rows go to Parquet instead (with_raw False)."""
    keys, spark = [c.key for c in cols], raw.sparkSession
    raw, documents = raw.persist(), documents.persist()
    try:
        by = ["doc_id", "row_seq", "row_no", "datenpunkt", "schwerpunkt"]
        listing, n = function_list(raw.groupBy(*by).pivot("spalte_key", keys).agg(F.sum("wert")), cols, "GA-Funktionsliste")
        matrix = facts.matrix(raw, ["doc_id"], keys, documents.select("doc_id")).join(documents.select("doc_id", "datei"), "doc_id")
        first, totals = overview(matrix, cols, "Übersicht", listing.name, n)
        price = F.create_map(*[F.lit(x) for c in cols for x in (c.key, c.price)])
        summary = facts.column_summary(raw).withColumn("preis", F.coalesce(F.element_at(price, F.col("spalte_key")), F.lit(0.0)))
        foci = facts.focus_summary(raw)
        sheets = [first, frame(foci, "Schwerpunkte", [F.col("schwerpunkt"), F.col("bezeichnung")]), matrix_sheet(facts.matrix(raw, ["schwerpunkt"], keys), ("schwerpunkt",), cols, "Mengen je Schwerpunkt"), listing]
        sheets += [column_sums(summary, totals, extra=("dokumente", "n_cells")), costs(summary, totals)]
        sheets += [frame(df, name, order) for name, (df, order) in (frames or {}).items()]
        if with_raw:
            sheets.append(frame(raw, "Rohdaten", [F.col("doc_id"), F.col("row_seq"), F.col("spalte_key")]))
        sheets.append(frame(documents, "Dokumente", [F.col("datei"), F.col("doc_id")]))
        info = raw.agg(F.count_distinct("datenpunkt").alias("d"), F.coalesce(F.sum("wert"), F.lit(0.0)).alias("w"))
        lines = [_fixed(spark, 0, text_cell(0, F.lit("Auswertung"))), _fixed(spark, 1, text_cell(0, F.lit("Dateien")), cell(1, F.lit(documents.count())))]
        lines += [info.select(F.lit(r).alias("r"), F.array(text_cell(0, F.lit(t)), cell(1, F.col(c))).alias("cells")) for r, t, c in ((2, "Datenpunkte (Stand Export)", "d"), (3, "Funktionen gesamt (Stand Export)", "w"))]
        lines += [_fixed(spark, 4, text_cell(0, F.lit("Schwerpunkte")), cell(1, F.lit(foci.count())))]
        rows = lines[0]
        for x in lines[1:]:
            rows = rows.unionByName(x)
        save([*sheets, Sheet("Info", rows, frozen=0)], path)
    finally:
        raw.unpersist()
        documents.unpersist()


def cells_of(sheets: list[Sheet]) -> DataFrame:
    """sheet, r, c, text, number, formula of all sheets."""
    out = None
    for i, s in enumerate(sheets):
        one = s.rows.select(F.lit(i).alias("sheet"), "r", F.inline("cells"))
        out = one if out is None else out.unionByName(one)
    return out


def widths(cells: DataFrame, most: int = 60) -> DataFrame:
    """sheet, c, width: the longest text of a column, from 8 to `most`."""
    n = F.length(F.coalesce("text", F.col("number").cast("string")))
    return cells.groupBy("sheet", "c").agg(F.least(F.greatest(F.max(n) + 2, F.lit(8)), F.lit(most)).alias("width"))


def save(sheets: list[Sheet], path: str) -> None:
    """Writes a workbook, in place of one that is there. path: a folder that driver and executors share."""
    spark = sheets[0].rows.sparkSession
    ship(spark)
    spark.dataSource.register(WorkbookSource)
    cells = cells_of(sheets)
    wide = [[] for _ in sheets]
    for r in sorted(widths(cells).collect()):  # a sheet has 16,384 columns at most, by the format
        wide[r["sheet"]] += [12] * (r["c"] - len(wide[r["sheet"]])) + [r["width"]]
    looks = [{"name": s.name[:31], "hidden": s.hidden, "frozen": s.frozen, "merged": s.merged, "widths": w} for s, w in zip(sheets, wide, strict=True)]
    ordered = cells.repartitionByRange("sheet", "r").sortWithinPartitions("sheet", "r", "c")
    ordered.write.format(FORMAT).mode("overwrite").option("path", path).option("sheets", json.dumps(looks)).save()

