"""Steady state: features of a time window around each sample, segments, rollups, groups.

Windows reach half the window seconds to both sides, ends included, and must be full to count. A sensor is
cut along time into buckets of ``bucket_seconds``, and each bucket gets the samples within reach; where it
isn't given, a bucket is BUCKET_WINDOWS windows long. Infinite buckets hold whole sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.config import Steady
from tidewright.operators import ranges
from tidewright.operators.signals import valid_samples

#: Windows in a bucket: the samples that a bucket holds twice are one in as many.
BUCKET_WINDOWS = 1024


def thresholds(samples: DataFrame, config: Steady) -> DataFrame:
    """(sensor, n_samples, signal_scale, max_change, max_std, slope_tol) of all rows of ``samples``."""
    scale = F.greatest(F.stddev_pop("value"), (F.max("value") - F.min("value")) / 6, F.lit(1e-12))
    x = samples.groupBy("sensor").agg(F.count("*").alias("n_samples"), scale.alias("signal_scale"))
    fixed = lambda v, e: F.lit(float(v)) if v is not None else e
    x = x.withColumns({
        "max_change": fixed(config.max_change_in_window, F.col("signal_scale") * config.change_fraction_of_scale),
        "max_std": fixed(config.max_std_in_window, F.col("signal_scale") * config.std_fraction_of_scale)})
    return x.withColumn("slope_tol", fixed(config.slope_tolerance_per_second, F.col("max_change") / max(config.steady_window_seconds, 1e-12)))


def window_features(samples: DataFrame, window_seconds: float, bucket_seconds: float | None = None) -> DataFrame:
    """Adds bucket, n_near, span, slope, local_std and endpoint_change of the closed window around each sample."""
    h = window_seconds / 2
    wide = BUCKET_WINDOWS * window_seconds if bucket_seconds is None else bucket_seconds
    at = lambda d: F.floor((F.col("time") + d) / F.lit(float(wide))).cast("long")
    x = samples.withColumn("own", at(0.0)).withColumn("bucket", F.explode(F.sequence(at(-h), at(h))))
    over = f"OVER (PARTITION BY sensor, bucket ORDER BY time RANGE BETWEEN {h!r}D PRECEDING AND {h!r}D FOLLOWING)"
    f = lambda e: F.expr(f"{e} {over}")
    x = x.withColumns({
        "n_near": f("count(*)"), "span": f("max(time)") - f("min(time)"), "t_var": f("var_pop(time)"), "fit": f("regr_slope(value, time)"),
        "local_std": f("stddev_pop(value)"), "endpoint_change": F.abs(f("last_value(value)") - f("first_value(value)"))})
    x = x.withColumn("slope", F.when(F.col("t_var") * F.col("n_near") * F.col("n_near") > 1e-12, F.coalesce("fit", F.lit(0.0))).otherwise(0.0))
    return x.where("bucket = own").drop("own", "t_var", "fit")


def steady_mask(signals: DataFrame, config: Steady | None = None, value: str = "value", bucket_seconds: float | None = None) -> DataFrame:
    """Valid samples with window features, steady and bucket; none for a sensor with fewer than 3."""
    c = config or Steady()
    samples = valid_samples(signals, value)
    limits = thresholds(samples, c).where("n_samples >= 3")
    x = window_features(samples, c.steady_window_seconds, bucket_seconds).join(limits, "sensor")
    steady = ((F.col("n_near") >= c.points) & (F.col("span") >= c.duration) & (F.abs("slope") <= F.col("slope_tol"))
              & (F.col("endpoint_change") <= F.col("max_change")) & (F.col("local_std") <= F.col("max_std")))
    return x.withColumn("steady", steady)


def steady_segments(mask: DataFrame, min_duration: float) -> DataFrame:
    """Runs of steady samples that last long enough, with breakout_time: the next sample, if there is one."""
    partial = [F.count("value").alias("_n"), F.sum("value").alias("_sum"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.sum(F.abs("slope")).alias("_slopes"),
               F.count("slope").alias("_n_slopes"), F.max("endpoint_change").alias("_change"), F.max("local_std").alias("_std")]
    merged = [(F.sum("_sum") / F.sum("_n")).alias("mean_value"), F.min("_min").alias("min_value"), F.max("_max").alias("max_value"), (F.sum("_slopes") / F.sum("_n_slopes")).alias("mean_abs_slope"),
              F.max("_change").alias("max_endpoint_change"), F.max("_std").alias("max_local_std")]
    x = ranges.merged_runs(mask, "sensor", "steady", partial, merged)
    x = x.withColumn("duration_seconds", F.col("end_time") - F.col("start_time")).where(F.col("duration_seconds") >= min_duration)
    return x.select("sensor", "start_time", "end_time", "duration_seconds", "mean_value", "min_value", "max_value", "mean_abs_slope", "max_endpoint_change", "max_local_std", "breakout_time")


def transitions(segments: DataFrame, key: str = "sensor") -> DataFrame:
    """(key, time, from_state, to_state, after_segment_start, after_segment_end) of each breakout."""
    return segments.where("breakout_time is not null").select(
        key, F.col("breakout_time").alias("time"), F.lit("steady").alias("from_state"), F.lit("changing").alias("to_state"),
        F.col("start_time").alias("after_segment_start"), F.col("end_time").alias("after_segment_end"))


def rollup(segments: DataFrame, samples: DataFrame, key: str = "sensor") -> DataFrame:
    """One row for each key of ``samples`` (key, n_samples): number and total of segments, the longest, the first breakout.

    Of equally long segments the first one counts.
    """
    first = F.min_by(F.struct("start_time", "end_time", "duration_seconds"), F.struct(-F.col("duration_seconds"), "start_time"))
    x = segments.groupBy(key).agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("total"), first.alias("longest"), F.min("breakout_time").alias("breakout"))
    return samples.join(x, key, "left").select(
        key, "n_samples", F.coalesce("n", F.lit(0)).alias("n_steady_segments"), F.coalesce("total", F.lit(0.0)).alias("total_steady_duration_seconds"),
        F.col("longest.start_time").alias("longest_steady_start_seconds"), F.col("longest.end_time").alias("longest_steady_end_seconds"),
        F.col("longest.duration_seconds").alias("longest_steady_duration_seconds"), F.col("breakout").alias("first_breakout_seconds"))


def sample_counts(signals: DataFrame, value: str = "value") -> DataFrame:
    """(sensor, n_samples, n_valid): valid samples, and rows with time and value before times are made unique; 0 where there are none."""
    valid = F.count_if(F.col("time").isNotNull() & F.col(value).isNotNull())
    every = signals.groupBy("sensor").agg(valid.alias("n_valid"))
    counts = valid_samples(signals, value).groupBy("sensor").agg(F.count("*").alias("n_samples"))
    return every.join(counts, "sensor", "left").fillna(0, "n_samples").select("sensor", "n_samples", "n_valid")


def resolve_groups(groups: dict[str, list[str]] | None, sensors: list[str]) -> dict[str, list[str]]:
    """Members of each group: names without case, * for all, unknown ones left out, empty groups too."""
    sensors = sorted(sensors)
    by_name = {s.lower(): s for s in sensors}
    out = {}
    for name, members in (groups or {"all_sensors": ["*"]}).items():
        found = sensors if "*" in members else [by_name[m] for m in (str(m).lower() for m in members) if m in by_name]
        if found:
            out[name] = found
    return out


def group_mask(mask: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, time, steady, bucket): whether all members are steady; groups whose members differ in samples have none.

    ``groups`` is as ``resolve_groups`` gives it.
    """
    spark = mask.sparkSession
    rows = [(g, s, len(set(m))) for g, m in groups.items() for s in set(m)]
    members = spark.createDataFrame(rows, "group string, sensor string, members int")
    n = mask.groupBy("sensor").agg(F.count("*").alias("n"))
    # The first sensor by name sets how many samples each member must have.
    base = n.agg(F.min(F.struct("sensor", "n")).alias("b")).select(F.col("b.n").alias("base"))
    even = members.join(n, "sensor", "left").crossJoin(base).groupBy("group").agg(F.bool_and(F.coalesce(F.col("n") == F.col("base"), F.lit(False))).alias("even"))
    kept = members.join(even.where("even").select("group"), "group")
    x = mask.join(kept, "sensor").groupBy("group", "time").agg(F.bool_and("steady").alias("steady"), F.count("*").alias("c"), F.max("members").alias("members"), F.first("bucket").alias("bucket"))
    return x.where("c = members").select("group", "time", "steady", "bucket")


def group_segments(mask: DataFrame, min_duration: float) -> DataFrame:
    """Segments of ``group_mask``: (group, start_time, end_time, duration_seconds, breakout_time)."""
    x = ranges.merged_runs(mask, "group", "steady", [], [])
    x = x.withColumn("duration_seconds", F.col("end_time") - F.col("start_time")).where(F.col("duration_seconds") >= min_duration)
    return x.select("group", "start_time", "end_time", "duration_seconds", "breakout_time")
