"""From a file to results: inspection, cache, cleaning, curves, steady states, reports; studies on request."""

from __future__ import annotations

import os
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import cache, files, reports, studies
from tidewright.config import Config
from tidewright.operators import resample, schema, scaling, signals, spikes, steady
from tidewright.sources import csv_encoding, csv_rows, lvm, read_table, xlsx

#: Rows of a bucket.
BUCKET_ROWS = 100_000


def inspect(spark: SparkSession, path: str, config: Config | None = None, sheet: str | None = None, max_rows: int = 5) -> dict:
    """What a file holds: columns, first rows, schema mapping, and what its format tells beyond that."""
    suffix = os.path.splitext(path)[1].lower()
    raw = read_table(spark, path, sheet)
    shown = [r.asDict(recursive=True) for r in raw.orderBy("row_idx").drop("row_idx").limit(max_rows).collect()]
    columns = [c for c in raw.columns if c != "row_idx"]
    out = {"path": path, "name": path.rsplit("/", 1)[-1], "suffix": suffix, "size_bytes": files.signature(spark, path)["size_bytes"], "columns": columns, "sample_rows": shown,
           "schema_mapping": schema.infer_schema(raw, config).as_dict()}
    if suffix == ".csv":
        out |= {"encoding": csv_encoding(spark, path), "estimated_rows": csv_rows(spark, path)}
    else:
        out["shape"] = [raw.count(), len(columns)]
    if suffix == ".xlsx":
        out["sheets"] = xlsx.sheet_names(spark, path)
    if suffix == ".lvm":
        out["lvm_metadata"] = lvm.read(spark, path)[1]
    return out


def clean(data: DataFrame, config: Config | None = None, mode: str = "serial") -> DataFrame:
    """Cleaned signals. replicated: whole sensors; serial and partitioned: buckets of rows. All give the same rows."""
    if mode not in scaling.MODES:
        raise ValueError(f"unknown mode: {mode}")
    config = config or Config()
    if mode == "replicated":
        data = data.repartition("sensor")
    return spikes.clean(data, config.cleaning, None if mode == "replicated" else BUCKET_ROWS)


def steady_tables(data: DataFrame, config: Config, value: str = "value") -> dict:
    """mask, segments, rollup, limits, and the same of the groups. Mask, segments and counts are written once."""
    c = config.steady_state
    mask = files.kept(steady.steady_mask(data, c, value))
    segments = files.kept(steady.steady_segments(mask, c.duration))
    counts = files.kept(steady.sample_counts(data, value))
    out = {"mask": mask, "segments": segments, "rollup": steady.rollup(segments, counts).join(counts.select("sensor", "n_valid"), "sensor"), "limits": files.kept(steady.thresholds(signals.valid_samples(data, value), c))}
    names = [r[0] for r in counts.select("sensor").collect()]
    groups = steady.resolve_groups(c.groups, names)
    if groups:
        gmask = files.kept(steady.group_mask(mask, groups))
        parts = files.kept(steady.group_segments(gmask, c.duration))
        gcounts = gmask.groupBy("group").agg(F.count("*").alias("n_samples"))
        out |= {"groups": groups, "group_segments": parts, "group_rollup": steady.rollup(parts, gcounts, "group")}
    return out


def run_clean(spark: SparkSession, cache_dir: str, folder: str, config: Config | None = None, mode: str = "serial", characterize: bool = False) -> dict:
    """Clean a cache and write all results; returns paths and timings."""
    config, began = config or Config(), time.time()
    data = cache.load_cache(spark, cache_dir)
    reports.write_cleaned(clean(data, config, mode), folder)
    done = spark.read.parquet(f"{folder}/cleaned")
    cleaned_at = time.time()
    stats = [r.asDict() for r in spikes.cleaning_stats(done).orderBy("sensor").collect()]
    out = {"mode": mode, "cleaned": f"{folder}/cleaned", "cleaning_summary_csv": files.write_csv(spark, f"{folder}/cleaning_summary.csv", stats)}
    if characterize:
        as_value = done.select("sensor", "row_idx", "time", F.col("cleaned").alias("value"))
        c = config.characterization
        curves = spark.read.parquet(reports.write_curves(resample.characterize(as_value, c.method, c.dense_factor), folder))
        t = steady_tables(as_value, config)
        out |= reports.write_steady(spark, folder, t["rollup"], t["segments"], t["limits"], config.steady_state.duration, t.get("group_rollup"), t.get("group_segments"), t.get("groups")) or {}
        texts = {r["sensor"]: reports.sensor_text(r.asDict(), config.steady_state.duration) for r in t["rollup"].collect()}
        rows = [r.asDict() | {"signal_overlay_plot": None, "steady_state_summary": texts.get(r["sensor"])} for r in resample.curve_summary(curves).orderBy("sensor").collect()]
        out["characterization_summary_csv"] = files.write_csv(spark, f"{folder}/characterization_summary.csv", rows)
    out["timing_breakdown"] = {"compute_elapsed_sec": cleaned_at - began, "characterize_elapsed_sec": time.time() - cleaned_at}
    files.write_json(spark, f"{folder}/run_summary.json", out | {"stats": stats})
    return out


def run_workflow(spark: SparkSession, path: str | None = None, config: Config | None = None, cache_dir: str | None = None, sheet: str | None = None, modes: tuple[str, ...] | None = None, characterize: bool = False, inspect_first: bool = True,
                 runs: bool = True, benchmark: bool | None = None, counts: tuple[int, ...] | None = None, repeat: int | None = None, session: str | None = None) -> dict:
    """Inspect a file, find or build its cache, clean it in each mode, and time that; writes workflow_report.json.

    ``benchmark``, ``counts`` and ``repeat`` are the settings' where they are not given.
    """
    config = config or Config()
    if path is None and cache_dir is None:
        raise ValueError("workflow needs an input file or a cache")
    if session is None:
        session = cache.new_session(config.analysis_dir)
        files.describe_session(spark, session, "workflow", [])
    report: dict = {"session_dir": session, "config": asdict(config)}
    if path is not None and inspect_first:
        report["inspect"] = inspect(spark, path, config, sheet)
    if cache_dir is None:
        report["cache"] = cache.ensure_cache(spark, config.analysis_dir, path, config, sheet, session)
        cache_dir = report["cache"]["cache_dir"]
    report["runs"] = [run_clean(spark, cache_dir, f"{session}/outputs/{m}", config, m, characterize) for m in modes or config.modes] if runs else []
    if config.benchmark if benchmark is None else benchmark:
        study = studies.clean_study(spark, cache_dir, config, modes or config.modes, counts or config.process_counts, config.repeat if repeat is None else repeat)
        report["benchmark"] = studies.write_study(spark, *study, f"{session}/outputs/benchmark")
    report["workflow_report_json"] = files.write_json(spark, f"{session}/workflow_report.json", report)
    return report
