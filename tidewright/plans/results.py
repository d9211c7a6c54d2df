"""Queries over result files: what a run writes is read back and held against SQL on the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import files, reports, sinks, workflow
from tidewright.config import Cleaning, Config
from tidewright.functions import number
from tidewright.operators import resample, steady
from tidewright.plans import catalog
from tidewright.plans.catalog import event_signals, events, hourly_filled

CONFIG = Config(cleaning=Cleaning(strategy="drop"), steady_state=replace(catalog.HOURLY, groups={"pair": ["CLICK", "view"], "all": ["*"]}))


def _reports(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Steady-state reports of hourly events in a new folder."""
    data = hourly_filled(spark, sf_dir)
    t = workflow.steady_tables(data, CONFIG)
    return reports.write_steady(spark, files.scratch_folder(spark), t["rollup"], t["segments"], t["limits"], catalog.HOURLY.duration, t["group_rollup"], t["group_segments"], t["groups"])


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = "start_time: double, end_time: double, duration_seconds: double"
    schema = (f"per_sensor array<struct<sensor: string, steady_segments: array<struct<{span}, mean_value: double, max_local_std: double>>, "
              "state_transitions: array<struct<time: double, from_state: string, to_state: string, after_segment_start: double, after_segment_end: double>>>>, "
              f"per_group array<struct<`group`: string, steady_segments: array<struct<{span}, breakout_time: double>>>>")
    return spark.read.option("multiLine", True).schema(schema).json(_reports(spark, sf_dir)["steady_state_summary_json"])


def report_segments(spark, sf_dir):
    """Segments of each sensor as its summary nests them."""
    x = _summary(spark, sf_dir).select(F.explode("per_sensor").alias("s")).select("s.sensor", F.explode("s.steady_segments").alias("g"))
    return x.select("sensor", "g.start_time", "g.end_time", "g.duration_seconds", "g.mean_value", "g.max_local_std")


def report_transitions(spark, sf_dir):
    """Breakouts of each sensor as its summary nests them."""
    x = _summary(spark, sf_dir).select(F.explode("per_sensor").alias("s")).select("s.sensor", F.explode("s.state_transitions").alias("t"))
    return x.select("sensor", "t.time", "t.from_state", "t.to_state", "t.after_segment_start", "t.after_segment_end")


def report_groups(spark, sf_dir):
    """Segments of each group as the summary nests them."""
    x = _summary(spark, sf_dir).select(F.explode("per_group").alias("g")).select("g.group", F.explode("g.steady_segments").alias("s"))
    return x.select("group", "s.start_time", "s.end_time", "s.duration_seconds", "s.breakout_time")


def report_rows(spark, sf_dir):
    """One row for each sensor from the summary as CSV."""
    x = spark.read.option("header", True).option("escape", '"').csv(_reports(spark, sf_dir)["steady_state_summary_csv"])
    return x.select("sensor", F.col("n_samples").cast("long").alias("n_samples"), F.col("n_steady_segments").cast("long").alias("n_steady_segments"), number("total_steady_duration_seconds").alias("total_steady_duration_seconds"),
                    number("first_breakout_seconds").alias("first_breakout_seconds"))


def cleaned_files(spark, sf_dir):
    """Flags and repaired values of flagged events, cleaned in each mode and read back from files by sensor."""
    out = None
    for mode in ("serial", "replicated", "partitioned"):
        path = reports.write_cleaned(workflow.clean(event_signals(spark, sf_dir), CONFIG, mode), files.scratch_folder(spark))
        x = spark.read.parquet(path).where("flag").select(F.lit(mode).alias("mode"), "sensor", "row_idx", "cleaned")
        out = x if out is None else out.union(x)
    return out


def curve_files(spark, sf_dir):
    """Points and end of each dense line, read back from files by sensor."""
    path = reports.write_curves(resample.characterize(hourly_filled(spark, sf_dir), "linear", 2.5), files.scratch_folder(spark))
    x = resample.curve_summary(spark.read.parquet(path)).join(spark.read.parquet(path).groupBy("sensor").agg(F.max("time").alias("last_time"), F.max_by("value", "k").alias("last_value")), "sensor")
    return x.select("sensor", "method", "n_dense", "last_time", "last_value")


def inspected_columns(spark, sf_dir):
    """What inspection tells of a CSV file of events: its columns, their roles and its rows."""
    rows = events(spark, sf_dir).select(F.col("event_id").alias("Elapsed Time"), "value", "event_type", F.col("event_id").alias("row_idx"))
    path = sinks.write_file(rows, f"{files.scratch_folder(spark)}/events.csv")
    got = workflow.inspect(spark, path)
    m = got["schema_mapping"]
    rows = [(c, c == m["time_column"]["original_name"], c in m["sensor_columns"], got["encoding"]) for c in got["columns"]]
    return spark.createDataFrame(rows, "name string, is_time boolean, is_sensor boolean, encoding string")


QUERIES = {f.__name__: f for f in (report_segments, report_transitions, report_groups, report_rows, cleaned_files, curve_files, inspected_columns)}
SQL = {
    "report_segments": f"SELECT sensor, start_time, end_time, duration_seconds, mean_value, max_local_std FROM ({catalog.SQL['steady_segments']})",
    "report_transitions": catalog.SQL["transitions"],
    "report_groups": catalog.SQL["group_segments"].replace(">= 3600", ">= 10800"),
    "report_rows": f"SELECT sensor, n_samples, n_steady_segments, total_steady_duration_seconds, first_breakout_seconds FROM ({catalog.SQL['steady_rollup']})",
    "cleaned_files": f"SELECT mode, sensor, row_idx, cleaned FROM ({catalog.SQL['repair_drop_fill']}), (VALUES ('serial'), ('replicated'), ('partitioned')) AS m(mode)",
    "curve_files": f"SELECT sensor, 'linear_interp_fallback' AS method, count(*) AS n_dense, max(time) AS last_time, arg_max(value, k) AS last_value FROM ({catalog.SQL['dense_linear']}) GROUP BY sensor",
    "inspected_columns": """SELECT * FROM (VALUES ('Elapsed Time', true, false, 'utf-8'), ('value', false, (SELECT avg((value IS NOT NULL)::INT) >= 0.75 FROM events), 'utf-8'),
        ('event_type', false, (SELECT avg((try_cast(event_type AS DOUBLE) IS NOT NULL)::INT) >= 0.75 FROM events), 'utf-8')) AS t(name, is_time, is_sensor, encoding)""",
}
