"""Files to raw tables: strings with a row_idx, or typed columns where the format has types.

Files are found and read through Spark's file systems only.
"""

from __future__ import annotations

import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.schema import with_rows
from tidewright.operators.signals import quoted
from tidewright.sources import lvm, xlsx

#: Encodings in the order in which they are tried; the second never fails.
ENCODINGS = ("utf-8", "latin1")
SUFFIXES = (".csv", ".xlsx", ".lvm", ".json", ".ndjson", ".h5", ".hdf5")


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file, or of a folder's first one, by whatever file system Spark reads it from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        inside = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName()[0] not in "._")
        if not inside:
            return b""
        p = jvm.org.apache.hadoop.fs.Path(inside[0])
    f = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(f, n)))
    finally:
        f.close()


def whole(spark: SparkSession, path: str) -> bytes:
    """One file's bytes, for formats that can't be split (workbooks, instrument files)."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def csv_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that the file's first 8 KB decode in."""
    start = head(spark, path, 8192)
    for name in ENCODINGS:
        try:
            # A character may be cut off at the end.
            start[: start.rfind(b"\n") + 1 or len(start)].decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under their headers; a quote inside quotes is doubled, and a record is a line."""
    enc = csv_encoding(spark, path)
    return spark.read.option("header", True).option("escape", '"').option("encoding", enc).option("inferSchema", False).option("ignoreLeadingWhiteSpace", False).csv(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""
    def walk(schema, prefix):
        for f in schema.fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(quoted(p) for p in path)).alias(".".join(path))
    return df.select(*walk(df.schema, []))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, nested ones as they are."""
    return spark.read.json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, one object with a list ``records``, or one object; nested keys are dotted."""
    df = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"Unsupported JSON structure in {path}")
    kind = df.schema["records"].dataType if "records" in df.columns else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        df = df.select(F.explode("records").alias("r")).select("r.*")
    return flattened(df)


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """A 2-D dataset ``table`` with attribute ``columns``, or else all 1-D datasets at the root as columns."""
    import h5py  # not everywhere installed
    import pandas as pd

    with h5py.File(io.BytesIO(whole(spark, path)), "r") as f:
        if "table" in f and "columns" in f["table"].attrs:
            names = [c.decode() if isinstance(c, bytes) else str(c) for c in f["table"].attrs["columns"]]
            pdf = pd.DataFrame(f["table"][...], columns=names)
        else:
            flat = {k: v[...] for k, v in f.items() if getattr(v, "ndim", None) == 1}
            if not flat:
                raise ValueError(f"No 1-D datasets in {path}")
            pdf = pd.DataFrame(flat)
    return spark.createDataFrame(pdf)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A raw table with row_idx, by the file's suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        df = read_csv(spark, path)
    elif suffix == ".xlsx":
        df = xlsx.read(spark, path, sheet)
    elif suffix == ".lvm":
        df = lvm.table(spark, path)
    elif suffix == ".json":
        df = read_json(spark, path)
    elif suffix == ".ndjson":
        df = read_ndjson(spark, path)
    elif suffix in (".h5", ".hdf5"):
        df = read_hdf5(spark, path)
    else:
        raise ValueError(f"Unsupported file type: {path}")
    return with_rows(df)


def csv_rows(spark: SparkSession, path: str) -> int:
    """Lines less the header."""
    return max(spark.read.text(path).count() - 1, 0)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(whole(spark, path))
