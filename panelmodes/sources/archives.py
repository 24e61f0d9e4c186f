"""Sources Spark has no reader for: delimited text in ZIP archives and sheets of spreadsheet workbooks.

Both read whole files as binary rows, so every archive is one task; that is what such formats allow. Nothing is inferred: all columns are text.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def decoded(data: bytes) -> tuple[str, str | None]:
    """(text, delimiter) of a delimited file: UTF-8, with or without mark, and the delimiter left to be sniffed; else windows-1251 with semicolons."""
    try:
        return data.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        return data.decode("cp1251", errors="replace"), ";"


def sniffed(text: str) -> str:
    """The delimiter that parts the first line into most fields; a comma if none does."""
    head = text.split("\n", 1)[0]
    return max(DELIMITERS, key=lambda c: (head.count(c), -DELIMITERS.index(c)))


def rows_of_csv(data: bytes) -> list[dict[str, str | None]]:
    """Rows by header name; missing fields are None, surplus ones dropped, empty fields None."""
    text, delimiter = decoded(data)
    lines = csv.reader(io.StringIO(text), delimiter=delimiter or sniffed(text))
    header = [h.strip() for h in next(lines, [])]
    return [{h: (r[i] or None) if i < len(r) else None for i, h in enumerate(header)} for r in lines if r]


def first_member(data: bytes) -> bytes:
    """The first file of a ZIP archive, or the data itself if it is none."""
    if not data.startswith(b"PK\x03\x04"):
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(z.namelist()[0])


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns, as text, of all delimited files at ``path``, zipped (first member) or plain; a column a file lacks is NULL."""
    wanted = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = rows_of_csv(first_member(bytes(data)))
                yield pd.DataFrame([[r.get(c) for c in wanted] for r in rows], columns=wanted, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in wanted))


def sheet_rows(data: bytes, sheet: str) -> list[tuple[int, list[str | None]]]:
    """(line, cells) of a workbook's sheet; empty cells None. An unknown sheet has no rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        at = next((s.get(_REL) for s in book.iterfind("m:sheets/m:sheet", _NS) if s.get("name") == sheet), None)
        if at is None:
            return []
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        target = rels[at].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    out = []
    for n, row in enumerate(root.iterfind("m:sheetData/m:row", _NS), 1):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.iterfind("m:c", _NS)):
            ref = re.match("[A-Z]+", c.get("r", ""))
            col = k
            if ref:
                col = 0
                for letter in ref.group():
                    col = col * 26 + ord(letter) - 64
                col -= 1
            v = c.find("m:v", _NS)
            kind = c.get("t")
            if kind == "inlineStr":
                cells[col] = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) or None
            elif v is not None and v.text is not None:
                cells[col] = shared[int(v.text)] if kind == "s" else v.text
        out.append((int(row.get("r", n)), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
    return out


def read_sheets(spark: SparkSession, path: str, sheets: Sequence[str], width: int = 4) -> DataFrame:
    """(file STRING, year STRING, line INT, col0..): the named sheets of all workbooks at ``path``, without header, short rows padded with NULL. Lines count within file and sheet."""
    names = list(sheets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                for s in names:
                    rows = [(file, s, n, *(cells + [None] * width)[:width]) for n, cells in sheet_rows(bytes(data), s)]
                    yield pd.DataFrame(rows, columns=["file", "year", "line", *(f"col{i}" for i in range(width))], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, year string, line int, " + ", ".join(f"col{i} string" for i in range(width)))


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Delimited text with header, UTF-8 with or without mark, by an explicit schema; pruned by Spark's own reader. Quoted fields may hold line ends, so a file is read by one task."""
    return spark.read.csv(path, header=True, schema=columns, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """Delimited text with header. With ``mark`` every file begins with the UTF-8 mark, as spreadsheets expect it: it stands before the first column's name. NULL is \\N, so that empty text stays text."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, nullValue="\\N", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """Nested summaries: structs, arrays and maps."""
    df.write.mode("overwrite").json(path)


def read_windows(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """One row per window of summaries with an array ``windows``: ``whole`` files of one document each, or one document a line, which many tasks read."""
    return spark.read.json(path, schema=schema, multiLine=whole).select(F.explode("windows").alias("w")).select("w.*")
