"""Excel workbooks (.xlsx, .xlsm): one sheet of each file, rows read inside Spark tasks.

A workbook is a ZIP of XML parts. Formulas are never evaluated: a cell gives its stored
value or nothing. Old binary ``.xls`` files are refused.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from itertools import count
from datetime import datetime, timedelta
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import col
from tablewise.sources.dataset import Dataset, LoadError
from tablewise.sources.delimited import NULL_TOKENS, typed

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in number formats that show dates or times.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}
ROWS_PER_BATCH = 5_000

CELLS = "_file string, _sheet string, _error string, _sheets array<string>, _row bigint, cells map<string,string>"


def _xml(book: zipfile.ZipFile, part: str) -> ElementTree.Element:
    data = book.read(part)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document type declarations are not allowed")
    return ElementTree.fromstring(data)


def _sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in workbook order with the parts that hold them."""
    links = _xml(book, "xl/_rels/workbook.xml.rels").iter(f"{_PACKAGE}Relationship")
    targets = {r.get("Id"): r.get("Target") for r in links}
    parts = {}
    for s in _xml(book, "xl/workbook.xml").iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")]
        parts[s.get("name")] = posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")
    return parts


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(si) for si in _xml(book, "xl/sharedStrings.xml").iter(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = _xml(book, "xl/styles.xml")
    custom = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        # Quoted text, escapes and bracketed colours carry letters that mean nothing.
        code = pd.Series([f.get("formatCode") or ""]).str.replace(
            r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", regex=True
        )[0]
        custom[int(f.get("numFmtId"))] = any(ch in code.lower() for ch in "ymdhs")
    cells = root.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if f in DATE_FORMAT_IDS or custom.get(f)}


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _serial(value: str, from_1904: bool) -> str:
    """A serial day number as ISO text, to the second as spreadsheets show it."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(days=float(value))
    return (moment + timedelta(microseconds=500_000)).replace(microsecond=0).isoformat(sep=" ")


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind = cell.get("t") or "n"
    if kind == "inlineStr":
        return _text(cell)
    stored = cell.find(f"{_MAIN}v")
    if stored is None or stored.text is None:
        return None
    text = stored.text
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind == "e":
        return None
    if kind == "n" and int(cell.get("s") or 0) in dates:
        return _serial(text, from_1904)
    if kind == "n":
        number = float(text)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return text


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, dict[int, str]]]:
    shared, dates = _shared(book), _date_styles(book)
    from_1904 = any(
        p.get("date1904") in ("1", "true") for p in _xml(book, "xl/workbook.xml").iter(f"{_MAIN}workbookPr")
    )
    with book.open(part) as stream:
        number = 0
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r") or number + 1)
            cells = {}
            for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                value = _value(cell, shared, dates, from_1904)
                if value is not None:
                    cells[_column(cell.get("r")) if cell.get("r") else i] = value
            if cells:
                yield number, cells
            row.clear()


def _named_rows(content: bytes, sheet: str | None) -> Iterator[tuple[str, list[str], int, dict]]:
    """Data rows of one workbook as ``{header: text}``; row 0 carries all headers."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = _sheet_parts(book)
        names = list(parts)
        chosen = sheet if sheet is not None else names[0]
        if chosen not in parts:
            raise ValueError(f"sheet '{chosen}' not found; available: {', '.join(names)}")
        header: dict[int, str] | None = None
        bare: dict[str, str] = {}
        for number, cells in _rows(book, parts[chosen]):
            if header is None:
                header = _unique(cells)
                yield chosen, names, 0, {v: str(i) for i, v in sorted(header.items())}
                continue
            for i in cells:
                if i not in header:  # cells under no header text keep their column
                    header[i] = next(n for n in _numbered(f"column_{i + 1}") if n not in header.values())
                    bare[header[i]] = str(i)
            yield chosen, names, number, {header[i]: v for i, v in cells.items()}
        if bare:
            yield chosen, names, 0, bare


def _numbered(name: str) -> Iterator[str]:
    """The name, then the name with 2, 3, ..."""
    yield name
    for n in count(2):
        yield f"{name}_{n}"


def _unique(cells: dict[int, str]) -> dict[int, str]:
    """Header texts by column, repeated ones numbered so that each keeps its column."""
    out: dict[int, str] = {}
    taken: set[str] = set()
    for i, text in sorted(cells.items()):
        out[i] = next(n for n in _numbered(text) if n.lower() not in taken)
        taken.add(out[i].lower())
    return out


def workbook_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """``(path, content)`` rows to one row per sheet row; an unreadable file is an error row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["_file", "_sheet", "_error", "_sheets", "_row", "cells"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out: list[tuple] = []
                try:
                    for name, names, number, cells in _named_rows(bytes(content), sheet):
                        out.append((path, name, None, names, number, cells))
                        if len(out) >= ROWS_PER_BATCH:
                            yield pd.DataFrame(out, columns=fields)
                            out = []
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as exc:
                    out.append((path, None, f"{type(exc).__name__}: {exc}", [], -1, {}))
                if out:
                    yield pd.DataFrame(out, columns=fields)

    return files.select("path", "content").mapInPandas(parse, CELLS)


def parse_workbooks(files: DataFrame, sheet: str | None = None) -> Dataset:
    """One table from many workbooks, with ``_file`` and ``_sheet`` when there are several.

    Workbooks are parsed in parallel, one at a time per task. Headers may differ between
    files; a missing column is NULL there.
    """
    from tablewise.sources.dataset import materialise

    cells = materialise(workbook_cells(files, sheet))
    failed = cells.filter("_error IS NOT NULL").select("_file", "_error").orderBy("_file").limit(1).first()
    if failed is not None:
        raise LoadError(f"cannot read workbook {PurePosixPath(failed[0]).name}: {failed[1]}")
    heads = cells.filter("_row = 0")
    # Headers are bounded by the widest sheet and its variants, not by the data.
    named = heads.select(F.explode("cells").alias("name", "at"))
    order = named.groupBy("name").agg(F.min(F.col("at").cast("int")).alias("at"))
    names = [r["name"] for r in order.orderBy("at", "name").collect()]
    if not names:
        raise LoadError("workbooks have no header row")
    facts = heads.groupBy("_sheet", "_sheets").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    many = heads.select("_file").distinct().limit(2).count() > 1
    rows = cells.filter("_row > 0")
    texts = rows.select(
        *([col("_file"), col("_sheet")] if many else []),
        *[F.col("cells")[n].alias(n) for n in names],
    )
    texts = texts.select(*[F.when(~col(n).isin(NULL_TOKENS), col(n)).alias(n) for n in texts.columns])
    notes = []
    others = [s for s in facts["_sheets"] if s != facts["_sheet"]]
    if sheet is None and others:
        notes.append(f"Loaded sheet '{facts['_sheet']}'. Other sheets not analysed: {', '.join(others)}.")
    return Dataset(typed(texts), "workbooks", notes, list(facts["_sheets"]))


def load_workbooks(spark: SparkSession, path: str, *, sheet: str | None = None) -> Dataset:
    name = PurePosixPath(path).name
    if path.lower().endswith(".xls"):
        raise LoadError(f"{name}: old binary workbooks are not supported; save as .xlsx")
    try:
        files = spark.read.format("binaryFile").load(path)
        found = parse_workbooks(files, sheet)
    except PySparkException as exc:
        raise LoadError(f"cannot open workbook {name}: {exc.getCondition() or type(exc).__name__}") from None
    found.name = PurePosixPath(path).stem
    return found
