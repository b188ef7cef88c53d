"""Spreadsheet workbooks as a data source: one partition per workbook, rows streamed from its largest sheet."""

from __future__ import annotations

import glob
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_index(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ET.iterparse(f):
            if e.tag == NS + "si":
                out.append("".join(t.text or "" for t in e.iter(NS + "t")))
                e.clear()
    return out


def sheet_rows(path: str) -> Iterator[list[str]]:
    """Cells of each row as text, gaps empty. Finished rows are dropped from memory as they are passed."""
    with zipfile.ZipFile(path) as z:
        strings = shared_strings(z)
        sheets = [i for i in z.infolist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", i.filename)]
        if not sheets:
            return
        with z.open(max(sheets, key=lambda i: i.file_size)) as f:
            for _, e in ET.iterparse(f):
                if e.tag != NS + "row":
                    continue
                row: list[str] = []
                for at, c in enumerate(e.iter(NS + "c")):
                    i = column_index(c.get("r")) if c.get("r") else at
                    row += [""] * (i + 1 - len(row))
                    kind, v = c.get("t"), c.findtext(NS + "v")
                    if kind == "s" and v is not None:
                        row[i] = strings[int(v)]
                    elif kind == "inlineStr":
                        row[i] = "".join(t.text or "" for t in c.iter(NS + "t"))
                    else:
                        row[i] = v or ""
                e.clear()
                yield row


class WorkbookPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]

    def partitions(self):
        return [WorkbookPartition(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition):
        head: list[str] | None = None
        for n, row in enumerate(sheet_rows(partition.path)):
            if head is None:
                head = [h.strip() for h in row]
                continue
            yield partition.path, n, {h: (row[i] if i < len(row) else "") for i, h in enumerate(head) if h}


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("path", "dir/*.xlsx").load()``: path, row_no, cells (map from heading to text)."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return "path string, row_no int, cells map<string,string>"

    def reader(self, schema):
        return WorkbookReader(self.options)


def register(spark) -> None:
    """Make the sources of this package known to a session."""
    from ferrule.sources.boards import BoardSource

    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(BoardSource)
