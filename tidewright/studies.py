"""Scaling studies: how long cleaning takes by mode and number of tasks, on one cache or on one that grows with them.

A point (mode, n) runs in a session of its own in which scans and shuffles have n tasks; serial ones have one.
Beside seconds, each point tells what its ranks hold of the signals.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import cache, files, sinks, synth
from tidewright.config import Config
from tidewright.operators import scaling


def points_of(modes: Iterable[str], counts: Iterable[int]) -> list[tuple[str, int]]:
    """serial once on one task, the others on each of ``counts``; in the order of modes, each point once."""
    modes, counts = set(modes), sorted(set(counts))
    if unknown := modes - set(scaling.MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    if any(n < 1 for n in counts):
        raise ValueError("process counts start at 1")
    return [(m, n) for m in scaling.MODES if m in modes for n in ([1] if m == "serial" else counts)]


def scaling_study(spark: SparkSession, run: Callable[[str, int], dict], points: list[tuple[str, int]], repeat: int = 3) -> DataFrame:
    """Times ``run(mode, n)`` at each point; a row for each: mode, nproc, all_times, elapsed_sec, metrics of each run."""
    if repeat < 1:
        raise ValueError("repeat starts at 1")
    rows = []
    for mode, n in points:
        times, metrics = [], []
        for _ in range(repeat):
            began = time.time()
            got = run(mode, n)
            times.append(time.time() - began)
            metrics.append({k: float(v) for k, v in (got.get("timing_breakdown") or {}).items()})
        rows.append((mode, n, times, metrics))
    x = spark.createDataFrame(rows, "mode string, nproc int, all_times array<double>, breakdowns array<map<string,double>>")
    return scaling.elapsed(x)


def timed_clean(spark: SparkSession, cache_dir: str, config: Config, mode: str, n: int) -> dict:
    """Reads a cache and cleans it on n tasks; nothing is kept. Returns the seconds of both."""
    from tidewright.workflow import clean  # here: workflow offers the studies

    own = spark.newSession()
    for key, value in (("spark.sql.shuffle.partitions", n), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        own.conf.set(key, str(value))
    began = time.time()
    data = cache.load_cache(own, cache_dir).coalesce(n)
    data.write.format("noop").mode("overwrite").save()
    loaded = time.time()
    clean(data, config, mode).write.format("noop").mode("overwrite").save()
    return {"timing_breakdown": {"load_elapsed_sec": loaded - began, "compute_elapsed_sec": time.time() - loaded}}


def clean_study(spark: SparkSession, cache_dir: str, config: Config | None = None, modes: Iterable[str] = scaling.MODES, counts: Iterable[int] = (1, 2, 4, 8), repeat: int = 3) -> tuple[DataFrame, DataFrame]:
    """The study of cleaning a cache, and what the ranks of each point hold."""
    config = config or Config()
    points = points_of(modes, counts)
    study = scaling_study(spark, lambda mode, n: timed_clean(spark, cache_dir, config, mode, n), points, repeat)
    held = scaling.loads(cache.load_cache(spark, cache_dir), points, config.cleaning.window_radius)
    return study, scaling.work_shares(held)


def weak_study(spark: SparkSession, folder: str, rows_per_rank: int, counts: Iterable[int], config: Config | None = None, modes: Iterable[str] = scaling.MODES, repeat: int = 3, n_sensors: int = 8, seed: int = 1234) -> DataFrame:
    """Cleaning of synthetic tables that grow with the tasks: mode, nproc, rows_per_rank, total_rows, all_times, elapsed_sec.

    A serial point cleans the same rows on one task, so there is one for each of ``counts`` whose rows differ.
    """
    config, out = config or Config(), None
    for k, n in enumerate(sorted(set(counts))):
        total = rows_per_rank * n
        path = sinks.write_file(synth.table(spark, total, n_sensors, seed=seed + k), f"{folder}/data/rows_{total}.csv")
        built = cache.build_cache(spark, path, f"{folder}/cache_sessions/rows_{total}", config)["cache_dir"]
        found = scaling_study(spark, lambda mode, m, built=built: timed_clean(spark, built, config, mode, m), points_of(modes, [n]), repeat)
        found = found.withColumns({"rows_per_rank": F.lit(rows_per_rank).cast("long"), "total_rows": F.lit(total).cast("long")})
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no process counts")
    return out


def _written(spark: SparkSession, folder: str, name: str, key: str, rows: list[dict]) -> dict[str, str]:
    return {f"{name}_json": files.write_json(spark, f"{folder}/{name}.json", {key: rows}), f"{name}_csv": files.write_csv(spark, f"{folder}/{name}.csv", rows)}


def write_study(spark: SparkSession, study: DataFrame, held: DataFrame | None, folder: str) -> dict[str, str]:
    """Results, summary, breakdown of seconds, what ranks held, and a manifest, as JSON and CSV: a row for each point."""
    by_mode = [scaling.mode_order(), F.col("nproc")]
    results = [r.asDict(recursive=True) for r in study.orderBy(*by_mode).collect()]
    parts = scaling.metric_summary(study.select("mode", "nproc", F.explode("breakdowns").alias("metrics")))
    seconds: dict[tuple, dict] = {}
    for r in parts.orderBy(*by_mode, "key").collect():
        seconds.setdefault((r["mode"], r["nproc"]), {"mode": r["mode"], "nproc": r["nproc"], "repeat": r["repeat"]}).update({f"mean_{r['key']}": r["mean"], f"max_{r['key']}": r["max"]})
    work = [] if held is None else [r.asDict() for r in held.orderBy(*by_mode).collect()]
    out = {"results_json": files.write_json(spark, f"{folder}/benchmark_results.json", {"results": results})}
    out |= _written(spark, folder, "benchmark_summary", "summary", [r.asDict() for r in scaling.benchmark_summary(study).collect()])
    out |= _written(spark, folder, "timing_breakdown_summary", "timing_breakdown_summary", list(seconds.values()))
    out |= _written(spark, folder, "parallel_metrics_summary", "parallel_metrics_summary", work)
    manifest = {"modes": [r["mode"] for r in results], "process_counts": sorted({r["nproc"] for r in results}), "repeat": max((len(r["all_times"]) for r in results), default=0),
                "row_count": len(results), "has_timing_breakdown": bool(seconds), "has_parallel_metrics": bool(work)}
    return out | {"manifest_json": files.write_json(spark, f"{folder}/benchmark_manifest.json", manifest)}


def write_weak_study(spark: SparkSession, study: DataFrame, folder: str) -> dict[str, str]:
    """Results and summary of a study whose rows grow with the tasks; a serial point counts under its rows."""
    results = [r.asDict(recursive=True) for r in study.orderBy(scaling.mode_order(), "nproc", "total_rows").collect()]
    rows = [r.asDict() for r in scaling.weak_scaling_summary(study).orderBy(scaling.mode_order(), "nproc", "total_rows").collect()]
    out = {"results_json": files.write_json(spark, f"{folder}/weak_scaling_results.json", {"results": results})} | _written(spark, folder, "weak_scaling_summary", "summary", rows)
    manifest = {"process_counts": sorted({r["nproc"] for r in results}), "rows_per_rank": max((r["rows_per_rank"] for r in results), default=None), "modes": sorted({r["mode"] for r in results})}
    return out | {"manifest_json": files.write_json(spark, f"{folder}/weak_scaling_manifest.json", manifest)}
