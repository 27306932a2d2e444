"""Sheets (.csv, .xlsx, .xlsm) as DataFrames of texts."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.sources.headers import HISTORY, header_map, normal
from casebook.storage import intermediate

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class UnsupportedFile(ValueError):
    """A file that isn't a sheet, by its name."""


def read_sheet(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]] = HISTORY) -> DataFrame:
    """All columns as texts, null as empty; rows without any text are left out.

    ``path`` is a file or a pattern, and each file's columns go by its own
    header: those of several files that hold the same field, or have the same
    header, are one.  Rows also have file_name and row_no, the header's being 1.
    A file is read by one task, and many are read at once.  Files without a
    header have no rows; if none has one, that is an error.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = _read_csv(spark, path, aliases)
    elif kind in ("xlsx", "xlsm"):
        raw = _read_workbooks(spark, path, aliases)
    else:
        raise UnsupportedFile(f"{path}: not .csv, .xlsx or .xlsm")
    data = [c for c in raw.columns if c not in ("file_name", "row_no")]
    filled = raw.select("file_name", "row_no", *(F.coalesce(raw[f"`{c}`"].cast("string"), F.lit("")).alias(c) for c in data))
    return filled.where(reduce(lambda a, b: a | b, (F.col(f"`{c}`") != "" for c in data))) if data else filled


def write_csv(parts: dict[str, DataFrame], label: str) -> str:
    """Write each of ``parts`` as .csv files with headers to a folder of its own in the shared one; gives the pattern of all files.

    A file holds a partition.  Nulls become empty cells; blanks stay.
    """
    root = intermediate(next(iter(parts.values())).sparkSession, label)
    for name, rows in parts.items():
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        rows.write.options(header=True, quoteAll=True, escape='"', **kept).csv(f"{root}/{name}")
    return f"{root}/*/*.csv"


def _keys(header: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[int, tuple[str, str]]:
    """place -> (key, name) of a workbook's named columns; columns of several workbooks with the same key belong together."""
    fields = {column: field for field, column in reversed(header_map([h for h in header if h], aliases, ()).items())}
    seen: Counter[str] = Counter()
    out = {}
    for i, name in enumerate(header):
        if name:
            seen[normal(name)] += 1
            n = seen[normal(name)]
            key = f"field:{fields[name]}" if n == 1 and name in fields else f"header:{n}:{normal(name)}"
            out[i] = (key, name if n == 1 else f"{name} ({n})")
    return out


def _first_record(text: str) -> list[str]:
    return next(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")), [])


def _read_csv(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = [_first_record(content.decode("utf-8", "replace")) for content in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(headers, pa.list_(pa.string()))], ["path", "header"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(header, "path string, header array<string>")
    # one row a different header, in the order of the files
    kinds = files.where(F.size("header") > 0).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.col("paths")[0]).collect()
    if not kinds:
        raise FileNotFoundError(f"{path}: no header")
    names = _common_names([k["header"] for k in kinds], aliases)
    parts = []
    for kind in kinds:
        keys = _keys(kind["header"], aliases)
        places = [f"c{i}" for i in range(len(kind["header"]))]
        rows = spark.read.schema(", ".join(f"{c} string" for c in places)).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(kind["paths"])
        rows = rows.withColumn("file_name", F.input_file_name()).withColumn("__order", F.monotonically_increasing_id())
        row_no = F.row_number().over(Window.partitionBy("file_name").orderBy("__order")) + 1
        parts.append(rows.select("file_name", row_no.cast("bigint").alias("row_no"), *(F.col(f"c{i}").alias(names[key]) for i, (key, _) in keys.items())))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.select("file_name", "row_no", *(f"`{name}`" for name in names.values()))


def _common_names(headers: list[list[str]], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """key -> the column's name: that of the first header with it, told apart from names that are taken."""
    names: dict[str, str] = {}
    taken = {"file_name", "row_no"}
    for header in headers:
        for key, name in _keys(header, aliases).values():
            if key not in names:
                n, free = 1, name
                while free.casefold() in taken:
                    n += 1
                    free = f"{name} ({n})"
                names[key] = free
                taken.add(free.casefold())
    return names


def _read_workbooks(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = list(workbook_rows(content))
                keys = _keys(cells[0], aliases) if cells else {}
                # a row's cells lie under the keys of its own workbook's columns
                keyed = [[(key, row[i]) for i, (key, _) in keys.items() if i < len(row)] for row in cells]
                headers = [cells[0], *[None] * (len(cells) - 1)] if cells else []
                arrays = [pa.array([name] * len(cells), pa.string()), pa.array(range(1, len(cells) + 1), pa.int64()), pa.array(headers, pa.list_(pa.string())), pa.array(keyed, pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["file_name", "row_no", "header", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInArrow(rows, "file_name string, row_no bigint, header array<string>, cells map<string,string>")
    # one row a different header, in the order of the files
    headers = cells.where("row_no = 1").groupBy("header").agg(F.min("file_name").alias("first")).orderBy("first").collect()
    names = _common_names([row["header"] for row in headers], aliases)
    data = cells.where("row_no > 1")
    return data.select("file_name", "row_no", *(F.col("cells").getItem(key).alias(name) for key, name in names.items()))


def workbook_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's active sheet, each cell as text; whole numbers have no decimals."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.parse(book.open("xl/sharedStrings.xml")).getroot()]
    root = ET.parse(book.open("xl/workbook.xml")).getroot()
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheet = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")[int(view.get("activeTab", 0)) if view is not None else 0]
    targets = {r.get("Id"): r.get("Target") for r in ET.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for row in ET.parse(book.open(posixpath.normpath(posixpath.join("/xl", targets[sheet.get(_REL)])).lstrip("/"))).getroot().iter(f"{_MAIN}row"):
        cells: list[str] = []
        for c in row.iter(f"{_MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            cells[at] = _cell(c, shared)
        yield cells


def _column(ref: str) -> int:
    return reduce(lambda n, ch: n * 26 + ord(ch) - 64, re.match("[A-Z]+", ref)[0], 0) - 1


def _cell(c: ET.Element, shared: list[str]) -> str:
    kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v") or ""
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and value:
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value
