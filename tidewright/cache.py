"""Signal caches: long Parquet with a manifest that tells which input and settings it came from."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import files
from tidewright.config import Config
from tidewright.operators import schema
from tidewright.sources import read_table

MANIFEST, VERSION = "cache_metadata.json", 1


def new_session(root: str) -> str:
    """A run's folder: its date and a random name."""
    return f"{root.rstrip('/')}/{datetime.date.today():%Y-%m-%d}_session_{uuid.uuid4().hex[:8]}"


def write_cache(signals: DataFrame, path: str, dtype: str = "double") -> str:
    """Signals by sensor, so that reading a few sensors reads no others. Names stay as they are."""
    kind = {"float64": "double", "float32": "float"}.get(dtype, dtype)
    x = signals.withColumns({c: F.col(c).cast(kind) for c in ("time", "value")})
    x.repartitionByRange("sensor", "row_idx").sortWithinPartitions("sensor", "row_idx").write.mode("overwrite").parquet(f"{path}/signals")
    return path


def load_cache(spark: SparkSession, path: str, sensors: list[str] | None = None) -> DataFrame:
    x = spark.read.parquet(f"{path}/signals")
    if sensors is not None:
        x = x.where(F.col("sensor").isin(sensors))
    return x.withColumns({c: F.col(c).cast("double") for c in ("time", "value")})


def _identity(spark: SparkSession, path: str, config: Config, sheet: str | None) -> dict:
    return {"input": files.signature(spark, path), "sheet_name": sheet, "config_sha256": files.text_sha256(repr(asdict(config)))}


def build_cache(spark: SparkSession, path: str, session: str, config: Config | None = None, sheet: str | None = None, dtype: str = "float64") -> dict:
    """Read a file, find its schema, write its signals and the manifest, which is returned."""
    config = config or Config()
    signals, summary = schema.normalize(read_table(spark, path, sheet), path.rsplit("/", 1)[-1].rsplit(".", 1)[0], config)
    cache = write_cache(signals, f"{session}/cache", dtype)
    meta = {"version": VERSION, "created_utc": datetime.datetime.now(datetime.UTC).isoformat(), "session_dir": session, "cache_dir": cache,
            "identity": _identity(spark, path, config, sheet), "dataset_summary": summary, "status": "built"}
    files.write_json(spark, f"{session}/{MANIFEST}", meta)
    return meta


def find_cache(spark: SparkSession, analysis_dir: str, path: str, config: Config | None = None, sheet: str | None = None) -> dict | None:
    """The newest cache (by folder name) of the same file, sheet and settings; unreadable manifests are passed over."""
    want = _identity(spark, path, config or Config(), sheet)
    for name in sorted(files.names(spark, f"{analysis_dir}/*_session_*/{MANIFEST}"), reverse=True):
        try:
            meta = files.read_json(spark, name)
        except ValueError:
            continue
        if meta.get("identity") == want and files.exists(spark, f"{meta.get('cache_dir')}/signals/_SUCCESS"):
            return meta | {"status": "reused"}
    return None


def ensure_cache(spark: SparkSession, analysis_dir: str, path: str, config: Config | None = None, sheet: str | None = None, session: str | None = None) -> dict:
    """A matching cache, or a new one."""
    return find_cache(spark, analysis_dir, path, config, sheet) or build_cache(spark, path, session or new_session(analysis_dir), config, sheet)
