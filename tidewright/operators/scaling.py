"""Summaries of scaling studies: rows of (mode, nproc, elapsed_sec, all_times, child_payloads).

Beside seconds they take work: the rows that each rank of a mode would hold, counted from signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of modes.
MODES = ("serial", "replicated", "partitioned")


def mode_order(mode: str = "mode") -> Column:
    out = F.lit(len(MODES))
    for k, m in reversed(list(enumerate(MODES))):
        out = F.when(F.col(mode) == m, k).otherwise(out)
    return out


def elapsed(runs: DataFrame) -> DataFrame:
    """Adds elapsed_sec: the least of all_times."""
    return runs.withColumn("elapsed_sec", F.array_min("all_times"))


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Speedup over serial on one process (null without it) and efficiency for each mode and process count."""
    serial = runs.where("mode = 'serial' and nproc = 1").agg(F.first("elapsed_sec").alias("serial"))
    mean = F.expr("aggregate(all_times, 0D, (s, x) -> s + x) / nullif(size(all_times), 0)")
    speedup = F.col("serial") / F.col("elapsed_sec")
    return runs.crossJoin(serial).orderBy(mode_order(), "nproc").select(
        "mode", "nproc", "elapsed_sec", F.size("all_times").alias("repeat"), F.coalesce(mean, "elapsed_sec").alias("mean_elapsed_sec"),
        F.coalesce(F.array_max("all_times"), "elapsed_sec").alias("max_elapsed_sec"), speedup.alias("speedup_vs_serial"), (speedup / F.greatest("nproc", F.lit(1))).alias("parallel_efficiency"))


def weak_scaling_summary(runs: DataFrame) -> DataFrame:
    """Efficiency against the least process count of each mode."""
    base = F.first("elapsed_sec").over(Window.partitionBy("mode").orderBy("nproc", "total_rows"))
    return runs.select("mode", "nproc", "rows_per_rank", "total_rows", "elapsed_sec", (base / F.nullif("elapsed_sec", F.lit(0.0))).alias("weak_scaling_efficiency"), (F.col("elapsed_sec") / F.nullif(base, F.lit(0.0))).alias("normalized_elapsed"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(mode, nproc, key, repeat, mean, max) of (mode, nproc, metrics map<string, double>); nulls don't count."""
    repeat = F.count("*").over(Window.partitionBy("mode", "nproc"))
    x = metrics.withColumn("repeat", repeat).select("mode", "nproc", "repeat", F.explode("metrics").alias("key", "v"))
    return x.groupBy("mode", "nproc", "repeat", "key").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def text_summary(metrics: DataFrame) -> DataFrame:
    """(mode, nproc, key, value) of (mode, nproc, run, texts map<string, string>): the first run's that isn't null."""
    x = metrics.select("mode", "nproc", "run", F.explode("texts").alias("key", "v")).where("v is not null")
    return x.groupBy("mode", "nproc", "key").agg(F.min_by("v", "run").alias("value"))


def wide_metrics(summary: DataFrame, keys: list[str]) -> DataFrame:
    """``metric_summary`` with a column mean_k and max_k for each key."""
    x = summary.groupBy("mode", "nproc", "repeat").pivot("key", keys).agg(F.first("mean").alias("mean"), F.first("max").alias("max"))
    return x.select("mode", "nproc", "repeat", *[F.col(f"{k}_{f}").alias(f"{f}_{k}") for k in keys for f in ("mean", "max")])


def work_metrics(loads: DataFrame) -> DataFrame:
    """One row about tasks (load_sec, compute_sec, n_sensors, n_rows, n_halo): the most, the least, the mean, the ratio."""
    busy = F.when(F.col("compute_sec") > 0, F.col("compute_sec"))
    return loads.agg(
        F.max("load_sec").alias("max_load_elapsed_sec"), F.max("compute_sec").alias("max_compute_elapsed_sec"),
        *[f(c).alias(f"{n}_{c}") for c in ("n_sensors", "n_rows") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.avg("n_halo").alias("mean_halo_rows"), (F.max(busy) / F.min(busy)).alias("compute_ratio"))


def loads(signals: DataFrame, points: list[tuple[str, int]], window_radius: int = 5) -> DataFrame:
    """(mode, nproc, rank, n_sensors, n_rows, n_halo): what each rank holds of ``signals`` (sensor, row_idx).

    serial: one rank has all. replicated: sensors in turn, by name. partitioned: each sensor in equal runs of
    rows, with ``window_radius`` rows more on both sides. Every row is counted where it falls, and the sums
    of tasks are added up; ranks without rows aren't there.
    """
    # One row for each sensor.
    sizes = signals.groupBy("sensor").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("nth", F.row_number().over(Window.orderBy("sensor")) - 1)
    at = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("nproc")) for m, n in points])).alias("p")
    x = signals.select("sensor", "row_idx").join(sizes, "sensor").select("sensor", "row_idx", "n", "nth", at).select("sensor", "row_idx", "n", "nth", "p.*")
    run = lambda i: F.expr(f"(({i} + 1) * nproc - 1) div n")
    whole = F.when(F.col("mode") == "replicated", F.col("nth") % F.col("nproc")).otherwise(0).cast("long")
    split = F.col("mode") == "partitioned"
    own = F.when(split, run("row_idx")).otherwise(whole)
    near = F.when(split, F.sequence(run(f"greatest(row_idx - {window_radius}, 0)"), run(f"least(row_idx + {window_radius}, n - 1)"))).otherwise(F.array(whole))
    x = x.select("mode", "nproc", "sensor", own.alias("own"), F.explode(near).alias("rank"))
    held = x.groupBy("mode", "nproc", "rank", "sensor").agg(F.count_if(F.col("rank") == F.col("own")).alias("n_rows"), F.count_if(F.col("rank") != F.col("own")).alias("n_halo"))
    return held.groupBy("mode", "nproc", "rank").agg(F.count_if(F.col("n_rows") > 0).alias("n_sensors"), F.sum("n_rows").alias("n_rows"), F.sum("n_halo").alias("n_halo"))


def work_runs(held: DataFrame) -> DataFrame:
    """Runs (mode, nproc, all_times, elapsed_sec) whose times are rows: the busiest rank's, with its halo and without."""
    x = held.groupBy("mode", "nproc").agg(F.array(F.max(F.col("n_rows") + F.col("n_halo")).cast("double"), F.max("n_rows").cast("double")).alias("all_times"))
    return elapsed(x)


def work_shares(held: DataFrame) -> DataFrame:
    """(mode, nproc, ranks, least, most and mean n_sensors and n_rows, mean_n_halo, row_ratio) of ``loads``."""
    return held.groupBy("mode", "nproc").agg(
        F.count("*").alias("ranks"), *[f(c).alias(f"{n}_{c}") for c in ("n_sensors", "n_rows") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.avg("n_halo").alias("mean_n_halo"), (F.max("n_rows") / F.nullif(F.min("n_rows"), F.lit(0))).alias("row_ratio"))
