"""Uploaded workbooks: containers of XML whose first sheet is a table with a header row.

Files come through Spark's reader of whole files, so from any store that Spark reads, one task a file; an
upload is 20 MB at most. Of a container only the directory, the shared strings and the first sheet are
read, and the sheet's XML goes by row by row. Cells are text: numbers as they would be written (days too:
`text.referral_date` understands day numbers), booleans TRUE and FALSE, missing cells and errors null.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P

ROWS = "path string, row long, cells map<string,string>, error string"


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all workbooks under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")


def workbook_rows(files: DataFrame) -> DataFrame:
    """The rows below the header of each workbook (path, content): `row` as the sheet numbers it, and `cells` by header,
    trimmed and lower-cased; of equal headers the first counts, columns without header don't. A file that is
    no workbook has a row with `error` instead; one that is damaged further on has it after the rows before."""
    return files.select("path", "content").mapInArrow(_read_files, ROWS)


def sheet_columns(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = P.UPLOAD_HEADERS) -> DataFrame:
    """`rows` with a column for each field, called by its first alias: the cell under the first of the aliases that the
    file has as a header, and `ord`, the place of the row in all files."""
    cell = lambda names: F.coalesce(*(F.when(F.map_contains_key("cells", n), F.struct(F.col("cells")[n].alias("v"))) for n in names))["v"]
    return rows.filter("error is null").select(F.struct("path", "row").alias("ord"), *(cell(names).alias(names[0]) for names in aliases.values()))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
    pack = lambda some: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some, strict=True), kinds, strict=True)], ["path", "row", "cells", "error"])
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            some = []
            try:
                for row, cells in _table(content.as_buffer()):
                    some.append((path, row, list(cells.items()), None))
                    if len(some) == 5_000:
                        yield pack(some)
                        some = []
            except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, LookupError, ValueError) as error:
                some.append((path, None, None, f"{type(error).__name__}: {error}"))
            if some:
                yield pack(some)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first_sheet(box: zipfile.ZipFile) -> str:
    """The member that holds the first sheet: the workbook names a relation, the relation a member."""
    sheets = [e for e in ElementTree.fromstring(box.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    relation = next(v for k, v in sheets[0].attrib.items() if _local(k) == "id") if sheets else None
    for e in ElementTree.fromstring(box.read("xl/_rels/workbook.xml.rels")):
        if e.get("Id") == relation:
            return posixpath.normpath(posixpath.join("/xl", e.attrib["Target"])).lstrip("/")
    raise ValueError("no sheet")


def _texts(box: zipfile.ZipFile) -> list[str]:
    """The shared strings; runs of one string are joined, readings above it are left out."""
    if "xl/sharedStrings.xml" not in box.namelist():
        return []
    out = []
    with box.open("xl/sharedStrings.xml") as member:
        for _, e in ElementTree.iterparse(member):
            if _local(e.tag) == "si":
                out.append(_joined(e))
                e.clear()
    return out


def _joined(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for part in e if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


def _value(cell: ElementTree.Element, texts: list[str]) -> str | None:
    kind, inner = cell.get("t", "n"), {_local(e.tag): e for e in cell}
    if kind == "inlineStr":
        return _joined(inner["is"]) if "is" in inner else None
    text = inner["v"].text if "v" in inner else None
    if text is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(text)]
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    if kind == "n":
        number = float(text)
        return str(int(number)) if number.is_integer() and abs(number) < 1e21 else repr(number)
    return text


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _table(content: pa.Buffer) -> Iterator[tuple[int, dict[str, str | None]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        texts, header, number = _texts(box), None, 0
        with box.open(_first_sheet(box)) as member:
            for _, e in ElementTree.iterparse(member):
                if _local(e.tag) != "row":
                    continue
                number = int(e.get("r", number + 1))
                at, found = -1, {}
                for cell in e:
                    at = _column(cell.get("r", "")) if cell.get("r") else at + 1
                    found[at] = _value(cell, texts)
                e.clear()
                if header is None:
                    header = {}
                    for i in sorted(found):
                        name = (found[i] or "").strip().lower()
                        if name and name not in header:
                            header[name] = i
                elif any(v is not None for v in found.values()):
                    yield number, {name: found.get(i) for name, i in header.items()}
