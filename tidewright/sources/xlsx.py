"""Workbook sheets as tables of strings, from the parts of the zip archive."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sheet that a task parses; a sheet has 2**20 rows at most.
RANGE = 1 << 16

#: Name spaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_index(ref: str) -> int:
    """The column of a cell reference, from 0."""
    out = 0
    for c in re.match("[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def sheets(content: bytes) -> dict[str, str]:
    """Sheet names and the archive members that hold them, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.attrib["Id"]: r.attrib["Target"].lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in book.iter(f"{MAIN}sheet"):
        target = links[s.attrib[f"{LINK}id"]]
        out[s.attrib["name"]] = target if target.startswith("xl/") else f"xl/{target}"
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def sheet_rows(content: bytes, member: str) -> Iterator[dict[int, str | None]]:
    """Rows of a sheet one by one, as cells by column; the sheet's tree is never whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared(z)
        with z.open(member) as f:
            events = ElementTree.iterparse(f, events=("start", "end"))
            data = None
            for event, node in events:
                if event == "start":
                    data = node if node.tag == f"{MAIN}sheetData" else data
                    continue
                if node.tag != f"{MAIN}row":
                    continue
                got: dict[int, str | None] = {}
                for cell in node.iter(f"{MAIN}c"):
                    v, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
                    raw = v.text if v is not None else _text(inline) if inline is not None else None
                    if v is not None and raw is not None and cell.attrib.get("t") == "s":
                        raw = shared[int(raw)]
                    got[column_index(cell.attrib.get("r", "A1"))] = raw
                yield got
                if data is not None:
                    data.clear()


def described(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int = 0) -> dict:
    """sheets, sheet (its name), columns, n_rows and the first ``max_rows`` rows, as a task that reads the file finds them."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                members = sheets(raw)
                name = next(iter(members), None) if sheet is None else sheet
                head, width, n, top = {}, 0, 0, []
                for k, row in enumerate(sheet_rows(raw, members[name]) if name in members else ()):
                    width, n = max(width, max(row, default=-1) + 1), k + 1
                    if k == 0:
                        head = row
                    elif k <= max_rows:
                        top.append(row)
                columns = [head[c] if head.get(c) is not None else f"unnamed_{c}" for c in range(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([list(members)], pa.list_(pa.string())), pa.array([name], pa.string()), pa.array([columns], pa.list_(pa.string())), pa.array([max(n - 1, 0)], pa.int64()),
                     pa.array([[[r.get(c) for c in range(width)] for r in top]], pa.list_(pa.list_(pa.string())))],
                    names=["sheets", "sheet", "columns", "n_rows", "top"])

    got = _content(spark, path).mapInArrow(run, "sheets array<string>, sheet string, columns array<string>, n_rows long, top array<array<string>>").first()
    if not got["sheets"]:
        raise ValueError("Workbook does not contain sheets")
    if got["sheet"] not in got["sheets"]:
        raise ValueError(f"Sheet not found: {sheet}")
    return got.asDict()


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The sheet's rows under its first one, with row_idx; all values are strings.

    Executors read the file and parse it as a stream, RANGE rows of the sheet in a task; of its content only
    the header comes to the driver.
    """
    got = described(spark, path, sheet)
    columns, n = got["columns"], got["n_rows"]
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField("row_idx", T.LongType()), *[T.StructField(h, T.StringType()) for h in columns]])
    name = got["sheet"]

    def run(batches):
        for batch in batches:
            for content, at in zip(batch.column("content"), batch.column("range").to_pylist(), strict=True):
                raw = content.as_py()
                rows = islice(sheet_rows(raw, sheets(raw)[name]), 1 + at * RANGE, 1 + (at + 1) * RANGE)
                first = at * RANGE
                while part := list(islice(rows, 4096)):
                    index = pa.array(range(first, first + len(part)), pa.int64())
                    yield pa.RecordBatch.from_arrays([index, *[pa.array([r.get(c) for r in part], pa.string()) for c in range(len(columns))]], names=["row_idx", *columns])
                    first += len(part)

    ranges = max(-(-n // RANGE), 1)
    x = _content(spark, path).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    if ranges > 1:
        x = x.repartitionByRange(ranges, "range")
    return x.mapInArrow(run, schema)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    return described(spark, path)["sheets"]


def preview(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int = 5) -> dict:
    """Name, columns, shape and first rows of a sheet."""
    got = described(spark, path, sheet, max_rows)
    return {"sheet_name": got["sheet"], "columns": got["columns"], "sample_rows": [dict(zip(got["columns"], r, strict=True)) for r in got["top"]], "shape": [got["n_rows"], len(got["columns"])]}
