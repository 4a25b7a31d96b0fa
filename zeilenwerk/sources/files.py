"""Files as tables: hashes, workbooks, price lists, answers of models."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEETS = ("xlsx", "xlsm", "xltx")
SUPPORTED = (*SHEETS, "xls", "pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, file_hash, content, supported of every file below path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return df.select("path", suffix.alias("suffix"), F.sha2("content", 256).alias("file_hash"), "content", suffix.isin(*SUPPORTED).alias("supported"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile, names: set[str]) -> list[str]:
    """The sheets' files in the order of the workbook; by their numbers where it names none."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ids = [e.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
        found = [links.get(i, "") for i in ids]
        found = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in found]
        if found := [t for t in found if t in names and "worksheets/" in t]:
            return found
    return sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """The cell styles that show dates or times: built-in formats 14 to 22 and 45 to 47, and own ones with their letters."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    own = {int(e.get("numFmtId")) for e in root.iter(f"{{{_NS['m']}}}numFmt") if re.search("[dmyhs]", plain(e.get("formatCode", "")), re.I)}
    known = own | {*range(14, 23), 45, 46, 47}
    xfs = root.find(f"{{{_NS['m']}}}cellXfs")
    return {i for i, e in enumerate(xfs if xfs is not None else []) if int(e.get("numFmtId", 0)) in known}


def _date(serial: float) -> str:
    """A date's serial number (days from 1899-12-30) as text; below one day a time."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86400))
    return str(at.time()) if serial < 1 else str(at)


def workbook_cells(data: bytes) -> list[tuple[int, int, int, str]]:
    """(sheet, row, column, text) of a workbook: stored values only, merged areas filled."""
    out: list[tuple[int, int, int, str]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets, dates = _sheets(z, names), _date_styles(z, names)
        for s, name in enumerate(sheets):
            root = ElementTree.fromstring(z.read(name))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(f"{{{_NS['m']}}}c"):
                v, kind, ref = c.find("m:v", _NS), c.get("t"), c.get("r")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b" and text:
                    text = "True" if text == "1" else "False"
                elif kind in (None, "n") and text and int(c.get("s", 0)) in dates:
                    text = _date(float(text))
                elif kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", text):
                    text = text.split(".")[0]
                cells[int(re.search(r"\d+", ref)[0]) - 1, _column(ref)] = text.strip()
            for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                top, left, bottom, right = int(re.search(r"\d+", a)[0]) - 1, _column(a), int(re.search(r"\d+", b or a)[0]) - 1, _column(b or a)
                for r in range(top, bottom + 1):
                    for k in range(left, right + 1):
                        if not cells.get((r, k)):
                            cells[r, k] = cells.get((top, left), "")
            out += [(s, r, k, v) for (r, k), v in sorted(cells.items()) if v]
    return out


def grid_cells(found: DataFrame) -> DataFrame:
    """The cells of workbooks among files(): doc_id (their hash), sheet, r, c, value. The format has no Spark reader."""

    def run(batches):
        for p in batches:
            rows = [(h, *x) for h, data in zip(p["file_hash"], p["content"], strict=True) for x in workbook_cells(data)]
            yield pd.DataFrame(rows, columns=["doc_id", "sheet", "r", "c", "value"])

    return found.where(F.col("suffix").isin(*SHEETS)).select("file_hash", "content").mapInPandas(run, "doc_id string, sheet int, r int, c int, value string")


def prices(spark: SparkSession, path: str) -> DataFrame:
    """spalte_key, preis of a price list (separator ;, decimal comma)."""
    df = spark.read.csv(path, sep=";", header=True)
    return df.select("spalte_key", F.replace("preis", F.lit(","), F.lit(".")).try_cast("double").alias("preis"))


def tolerant_json(answer: Column, schema: str) -> Column:
    """The first object in a model's answer, fenced or surrounded by text; no fields if there is none."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), "```(json)?", "")
    return F.from_json(F.coalesce(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")), F.lit("{}")), schema)
