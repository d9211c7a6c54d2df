"""One file from a table of any size: tasks write its parts, and they are joined without being read into memory.

A format's text is made row by row with column functions, tasks write it in sorted ranges, and the parts
are then copied one after another into the file, as streams, by whatever file system Spark writes to. Only
the frame around the rows (a header, brackets, a workbook's small members) is made on the driver.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright import files
from tidewright.operators import ranges
from tidewright.operators.schema import with_rows
from tidewright.operators.signals import quoted

FORMATS = (".csv", ".json", ".ndjson", ".xlsx")
#: Rows and columns that a sheet holds at most, its header included, and name spaces of the format.
SHEET_ROWS, SHEET_COLUMNS = 1 << 20, 1 << 14
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Members of a workbook with one sheet, beside the sheet itself.
MEMBERS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook {MAIN} xmlns:r="{LINKS}"><sheets><sheet name="{{sheet}}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def column_letters(k: int) -> str:
    """The letters of a sheet's column, from 0."""
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(name: str, kind: T.DataType, k: int, row: Column) -> Column:
    """A sheet's cell, numbers as they are and other values as inline text; none for null."""
    value, ref = F.col(quoted(name)).cast("string"), F.concat(F.lit(f'<c r="{column_letters(k)}'), row.cast("string"))
    if isinstance(kind, T.NumericType):
        out = F.concat(ref, F.lit('"><v>'), value, F.lit("</v></c>"))
    else:
        text = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")  # what XML can't hold
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        out = F.concat(ref, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(out, F.lit(""))


def _parts(lines: DataFrame, spark: SparkSession) -> list[str]:
    """Files with the lines in order, written by tasks."""
    folder = f"{files.scratch_folder(spark)}/parts"
    lines.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select("line").write.text(folder)
    return sorted(files.names(spark, f"{folder}/part-*"))


def _ranked(x: DataFrame) -> DataFrame:
    """Adds nth, 0, 1, ... by row_idx, whose numbers may have gaps."""
    return ranges.counted(ranges.laid_out(x.withColumn("_all", F.lit(0)), ["row_idx"]), "_all")


def _pour(spark: SparkSession, out, pieces: Iterable[bytes | str]) -> None:
    """Bytes, and files by their paths, into a stream of Java's."""
    jvm = spark.sparkContext._jvm
    for piece in pieces:
        if isinstance(piece, bytes):
            out.write(bytearray(piece))
            continue
        p = jvm.org.apache.hadoop.fs.Path(piece)
        source = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        finally:
            source.close()


def _objects(df: DataFrame) -> list[str]:
    """Files with the rows of ``df`` as JSON objects, a comma before each but the first."""
    row = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns if c != "row_idx"]), {"ignoreNullFields": "false"})
    x = _ranked(with_rows(df))
    return _parts(x.select("row_idx", F.concat(F.when(F.col("nth") == 0, F.lit(" ")).otherwise(F.lit(",")), row).alias("line")), df.sparkSession)


def _written(spark: SparkSession, path: str, pieces: Iterable[bytes | str]) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        _pour(spark, out, pieces)
    finally:
        out.close()
    return path


def write_lists(spark: SparkSession, path: str, lists: dict[str, DataFrame | None]) -> str:
    """One JSON object with a list of objects for each table, rows by row_idx; none is an empty list."""
    pieces: list[bytes | str] = []
    for k, (name, df) in enumerate(lists.items()):
        pieces += [("{" if k == 0 else ",").encode(), f"{json.dumps(name)}: [\n".encode(), *(_objects(df) if df is not None else []), b"]"]
    return _written(spark, path, [*pieces, b"}\n"])


def write_each(df: DataFrame, folder: str, suffix: str) -> list[str]:
    """A file for each row of ``df`` (name, content), written by tasks; names are different and few enough to list."""
    spark = df.sparkSession
    parts = f"{files.scratch_folder(spark)}/each"
    df.select("name", "content").write.partitionBy("name").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for part in files.names(spark, f"{parts}/name=*/part-*"):
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.rsplit("/", 2)[1].removeprefix("name="))
        out.append(f"{folder}/{name}{suffix}")
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (part, out[-1]))
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, True, True, conf)
    return sorted(out)


def write_file(df: DataFrame, path: str, sheet: str = "Sheet1", around: tuple[str, str] = ("", "")) -> str:
    """Writes one file in the format of its suffix, rows by row_idx (or else as they are read), and returns its path.

    csv: a header and a line for each row, null cells empty. json: a list of objects, ``around`` put about it.
    ndjson: an object a line. xlsx: one sheet; ValueError if it has more rows or columns than a sheet holds.
    row_idx itself isn't written; an empty table gives the frame alone.
    """
    spark, suffix = df.sparkSession, os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported output format: {suffix}")
    names = [c for c in df.columns if c != "row_idx"]
    x = with_rows(df)
    row, columns = F.struct(*[F.col(quoted(c)) for c in names]), {c: df.schema[c].dataType for c in names}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if suffix == ".xlsx":
        x = _ranked(x)
        if x.count() >= SHEET_ROWS or len(names) > SHEET_COLUMNS:
            raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows and {SHEET_COLUMNS} columns")
        place = F.col("nth") + 2
        line = F.concat(F.lit('<row r="'), place.cast("string"), F.lit('">'), *[_cell(c, t, k, place) for k, (c, t) in enumerate(columns.items())], F.lit("</row>"))
        head = "".join(f'<c r="{column_letters(k)}1" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for k, c in enumerate(names))
        parts = _parts(x.select("row_idx", line.alias("line")), spark)
        out = jvm.java.util.zip.ZipOutputStream(fs.create(target, True))
        try:
            for name, content in MEMBERS.items():
                out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
                _pour(spark, out, [content.replace("{sheet}", escape(sheet, {'"': "&quot;"})).encode()])
                out.closeEntry()
            out.putNextEntry(jvm.java.util.zip.ZipEntry("xl/worksheets/sheet1.xml"))
            frame = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {MAIN}><sheetData><row r="1">{head}</row>'
            _pour(spark, out, [frame.encode(), *parts, b"</sheetData></worksheet>"])
            out.closeEntry()
        finally:
            out.close()
        return path
    if suffix == ".json":
        return _written(spark, path, [(around[0] + "[\n").encode(), *_objects(x), f"]{around[1]}\n".encode()])
    if suffix == ".csv":
        line, first = F.to_csv(row, {"nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}), io.StringIO()
        csv.writer(first, lineterminator="\n").writerow(names)
        head, tail = first.getvalue(), ""
    else:
        line, head, tail = F.to_json(row, {"ignoreNullFields": "false"}), "", ""
    return _written(spark, path, [head.encode(), *_parts(x.select("row_idx", line.alias("line")), spark), tail.encode()])
