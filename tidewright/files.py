"""Small files next to the tables, by whatever file system Spark writes to: JSON, CSV, text, signatures."""

from __future__ import annotations

import contextlib
import csv
import datetime
import hashlib
import io
import json
import logging
import platform
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Paths that match a pattern."""
    fs, p = _fs(spark, path)
    return [str(s.getPath().toString()) for s in (fs.globStatus(p) or [])]


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def write_text(spark: SparkSession, path: str, text: str) -> str:
    return write_bytes(spark, path, text.encode("utf-8"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session that names none has one below the temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read back, for what several jobs read."""
    path = f"{scratch_folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode("utf-8")
    finally:
        f.close()


def write_json(spark: SparkSession, path: str, value: Any) -> str:
    return write_text(spark, path, json.dumps(value, indent=2, default=str))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def write_csv(spark: SparkSession, path: str, rows: list[dict]) -> str:
    """Columns in the order in which they first appear; missing and null cells are empty."""
    header = list(dict.fromkeys(k for r in rows for k in r))
    out = io.StringIO()
    if header:
        w = csv.DictWriter(out, header, restval="", lineterminator="\n")
        w.writeheader()
        w.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)
    return write_text(spark, path, out.getvalue())


def signature(spark: SparkSession, path: str | None) -> dict[str, Any] | None:
    """Place, size, time and SHA-256 of a file's content, read in pieces."""
    if path is None:
        return None
    fs, p = _fs(spark, path)
    status = fs.getFileStatus(p)
    digest = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    f = fs.open(p)
    try:
        sha = str(digest.sha256Hex(f))
    finally:
        f.close()
    return {"resolved_path": str(status.getPath().toString()), "size_bytes": int(status.getLen()), "mtime_ms": int(status.getModificationTime()), "sha256": sha}


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def describe_session(spark: SparkSession, session: str, command: str, argv: list[str]) -> dict[str, Any]:
    """Writes ``session_metadata.json`` into a run's folder: what ran, when, where, and the run's folders."""
    meta = {
        "session_id": session.rstrip("/").rsplit("/", 1)[-1], "command_name": command, "argv": list(argv),
        "timestamp_utc": datetime.datetime.now(datetime.UTC).isoformat(), "hostname": platform.node(), "platform": platform.platform(),
        "python_version": platform.python_version(), "spark_version": spark.version, "application_id": spark.sparkContext.applicationId,
        "paths": {"session_dir": session, **{f"{k}_dir": f"{session}/{k}" for k in ("logs", "outputs", "plots", "cache")}}}
    write_json(spark, f"{session}/session_metadata.json", meta)
    return meta


@contextlib.contextmanager
def session_log(spark: SparkSession, session: str):
    """What this package logs meanwhile, from INFO up, goes to ``logs/session.log``; a failure's trace too."""
    log, text = logging.getLogger("tidewright"), io.StringIO()
    handler, before = logging.StreamHandler(text), log.level
    handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        log.info("session %s", session.rstrip("/").rsplit("/", 1)[-1])
        yield
        log.info("done")
    except Exception:
        log.exception("failed")
        raise
    finally:
        log.removeHandler(handler)
        log.setLevel(before)
        write_text(spark, f"{session}/logs/session.log", text.getvalue())
