"""Landed pages of a paged portal as a streaming source.

    spark.dataSource.register(PortalPages)
    pages = spark.readStream.format("portal_pages").option("path", folder).option("size", 200).load()

A page lies in `source=<portal>/page=<number>/`, as `partitionBy("source", "page").text(folder)` writes it: one file, a
JSON object or array. The stream has a row (source, page, content) for each page that a client would have taken
if it had asked for one after the other: at most 50, no more than the first page announces (`totalPages`; unless
it does, a short first page is the only one), and none after a short page that isn't the first.

The offset is how many pages of each portal have landed without a gap, so a page that lands early waits for
those before it. What a page's place in its portal says about it depends on the pages before alone; they
are read again (50 at most), so a batch that is run again gives the same rows. Only names of files come to the
driver, no pages. A page must not change after it has landed; what isn't JSON ends its portal.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ENVELOPES = ("content", "results", "items", "referrals")
#: What a first page without `totalPages` announces, unless it is short.
UNTOLD = 99


@dataclass
class PagesOf(InputPartition):
    source: str
    #: The first page that this batch is to give; `paths` begin with the portal's first page.
    first: int
    paths: list[str]


def _items(page: object) -> int:
    """How many records a page has, whichever envelope they come in."""
    if isinstance(page, list):
        return len(page)
    some = next((page[k] for k in ENVELOPES if page.get(k) is not None), []) if isinstance(page, dict) else []
    return len(some) if isinstance(some, list) else 0


def taken_pages(contents: Iterator[str], size: int, most: int) -> Iterator[tuple[int, str]]:
    """(number, content) of the pages that a client takes out of all, which come in order."""
    limit = most
    for number, content in enumerate(contents):
        if number >= limit:
            return
        try:
            page = json.loads(content)
        except ValueError:
            return
        yield number, content
        items = _items(page)
        if number == 0:
            told = page.get("totalPages") if isinstance(page, dict) else None
            limit = min(most, told if isinstance(told, int) else 1 if items < size else UNTOLD)
        elif items < size:
            return


def land_pages(pages: DataFrame, folder: str) -> None:
    """Pages (source, page, value) into a folder, each as a file under its final name at once; landing one again changes nothing.
    Tasks write through `pyarrow.fs`, as the stream reads: a file costs Spark's writer a folder and a rename more."""

    def land(rows: Iterator[Row]) -> None:
        filesystem, root = fs.FileSystem.from_uri(folder)
        for row in rows:
            at = f"{root}/source={quote(row['source'], safe='')}/page={row['page']}"
            filesystem.create_dir(at)
            with filesystem.open_output_stream(f"{at}/.page.txt") as out:
                out.write(row["value"].encode())
            filesystem.move(f"{at}/.page.txt", f"{at}/page.txt")

    pages.foreachPartition(land)


class PortalPages(DataSource):
    """Options: path, size (records of a full page, 200), most (pages of a portal, 50)."""

    @classmethod
    def name(cls) -> str:
        return "portal_pages"

    def schema(self) -> str:
        return "source string, page int, content string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PortalReader(self.options["path"], int(self.options.get("size", 200)), int(self.options.get("most", 50)))


class PortalReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int, most: int):
        self.path, self.size, self.most = path, size, most

    def initialOffset(self) -> dict:
        return {}

    def _landed(self) -> dict[str, list[str]]:
        """Per portal the paths of its pages, up to the first gap. Files still being written are hidden ones. Only folders of pages that
        may be taken are looked into, however many have landed."""
        filesystem, folder = fs.FileSystem.from_uri(self.path)
        within = lambda path: filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
        found: dict[str, list[str]] = {}
        for portal in within(folder):
            if portal.type != fs.FileType.Directory or not portal.base_name.startswith("source="):
                continue
            paths = found[unquote(portal.base_name[7:])] = []
            while len(paths) < self.most:
                files = [f.path for f in within(f"{portal.path}/page={len(paths)}") if f.type == fs.FileType.File and f.base_name[0] not in "._"]
                if not files:
                    break
                paths.append(min(files))
        return found

    def latestOffset(self) -> dict:
        return {source: len(paths) for source, paths in self._landed().items() if paths}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        landed = self._landed() if start != end else {}
        return [PagesOf(source, start.get(source, 0), landed[source][:last]) for source, last in sorted(end.items()) if last > start.get(source, 0)]

    def read(self, partition: PagesOf) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        contents = (filesystem.open_input_stream(path).read().decode() for path in partition.paths)
        for number, content in taken_pages(contents, self.size, self.most):
            if number >= partition.first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.source]), pa.array([number], pa.int32()), pa.array([content])], ["source", "page", "content"]
                )

    def commit(self, end: dict) -> None:
        pass
