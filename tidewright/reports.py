"""Result files: summaries with one row for each sensor or group, and signals as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import files, sinks
from tidewright.functions import normalize_header

#: Sentences of the summaries.
FEW = "Not enough valid points to estimate steady-state behavior."
FEW_TIMES = "Not enough unique time samples to estimate steady-state behavior."
NONE = "No sustained steady-state window of at least {:.0f} s was detected. The signal appears to keep changing or stays too noisy for the current thresholds."
SOME = "Detected {} steady-state window(s). Longest steady window: {} to {} ({:.2f} s)."
BREAKOUT = " First clear breakout from steady-state occurs near {}."
GROUP_NONE = "Group `{}` had no interval where all member sensors stayed approximately steady for at least {:.0f} s."
GROUP_SOME = "Group `{}` was simultaneously steady for {} window(s). Longest: {} to {} ({:.2f} s)."
GROUP_BREAKOUT = " First group breakout occurs near {}."
REPORT = ("# Steady-State Report", "", "This report is a practical interpretation of the cleaned signals.",
          "A sensor is marked as steady when it changes only slightly across a sustained time window.", "")

#: Breakouts of a sensor's segments.
TRANSITIONS = ("transform(filter(steady_segments, s -> s.breakout_time IS NOT NULL), s -> named_struct('time', s.breakout_time, 'from_state', 'steady', "
               "'to_state', 'changing', 'after_segment_start', s.start_time, 'after_segment_end', s.end_time))")


def seconds(t: float | None) -> str:
    return "n/a" if t is None else f"{t:.2f} s"


def _text(row: dict, none: str, some: str, breakout: str) -> str:
    if row["longest_steady_start_seconds"] is None:
        return none
    out = some.format(*[seconds(row[f"longest_steady_{k}_seconds"]) for k in ("start", "end")], row["longest_steady_duration_seconds"])
    return out + (breakout.format(seconds(row["first_breakout_seconds"])) if row["first_breakout_seconds"] is not None else "")


def sensor_text(row: dict, min_duration: float) -> str:
    if (row["n_samples"] or 0) < 3:
        return FEW if (row.get("n_valid") or 0) < 3 else FEW_TIMES
    n = row["n_steady_segments"]
    return _text(row, NONE.format(min_duration), SOME.replace("{}", str(n), 1), BREAKOUT)


def group_text(row: dict, min_duration: float) -> str:
    name = row["group"]
    some = GROUP_SOME.replace("{}", name, 1).replace("{}", str(row["n_steady_segments"]), 1)
    return _text(row, GROUP_NONE.format(name, min_duration), some, GROUP_BREAKOUT)


def _rows(df: DataFrame, key: str) -> list[dict]:
    """Summaries of sensors or groups: one row for each."""
    return [r.asDict(recursive=True) for r in df.orderBy(key).collect()]


def _distinct(names: list[str]) -> list[str]:
    """Names with a number where one has come before."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _nested(segments: DataFrame, key: str) -> DataFrame:
    """A key's segments in one row, in order."""
    return segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in segments.columns if c != key]))).alias("_segments"))


def _segments(segments: DataFrame, key: str) -> Column:
    """Segments as ``_nested`` has them; an empty list where there are none."""
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in segments.schema if f.name != key)
    return F.coalesce("_segments", F.expr(f"cast(array() AS array<struct<{kinds}>>)"))


def write_steady(
    spark: SparkSession, folder: str, rollup: DataFrame, segments: DataFrame, limits: DataFrame, min_duration: float,
    group_rollup: DataFrame | None = None, group_segments: DataFrame | None = None, groups: dict[str, list[str]] | None = None,
) -> dict[str, str] | None:
    """Steady-state JSON, CSV and Markdown; nothing without sensors. Returns the paths.

    The driver has one row for each sensor and group; segments go from tasks to files, those of a sensor in one.
    """
    rows = _rows(rollup, "sensor")
    if not rows:
        return None
    for r in rows:
        r["summary_text"] = sensor_text(r, min_duration)
        r.pop("n_valid", None)  # for the sentence only
    out = {"steady_state_summary_json": f"{folder}/steady_state_summary.json", "steady_state_summary_csv": f"{folder}/steady_state_summary.csv", "steady_state_report_md": f"{folder}/steady_state_report.md"}
    files.write_csv(spark, out["steady_state_summary_csv"], rows)
    # Sentences and names are made here, a row for each sensor; what there are many of stays in the plan.
    names = _distinct([normalize_header(r["sensor"]) for r in rows])
    told = spark.createDataFrame([(k, r["sensor"], r["summary_text"], n) for k, (r, n) in enumerate(zip(rows, names, strict=True))], "row_idx long, sensor string, summary_text string, _name string")
    x = rollup.drop("n_valid").join(told, "sensor").join(_nested(segments, "sensor"), "sensor", "left").join(limits.select("sensor", F.struct(*[c for c in limits.columns if c != "sensor"]).alias("thresholds")), "sensor", "left")
    x = x.withColumns({"method": F.lit("steady_state_window"), "steady_segments": _segments(segments, "sensor"), "state_transitions": F.expr(TRANSITIONS)})
    per_sensor = x.select("row_idx", "_name", "sensor", "method", *[c for c in rollup.columns if c not in ("sensor", "n_valid")], "summary_text", "thresholds", "steady_segments", "state_transitions")
    group_rows, per_group = [], None
    if group_rollup is not None and groups:
        for r in _rows(group_rollup, "group"):
            group_rows.append({"group": r["group"], "members": ",".join(groups[r["group"]]), **{k: v for k, v in r.items() if k != "group"}, "summary_text": group_text(r, min_duration)})
    if group_rows:
        told = spark.createDataFrame([(k, r["group"], groups[r["group"]], r["summary_text"]) for k, r in enumerate(group_rows)], "row_idx long, group string, members array<string>, summary_text string")
        per_group = group_rollup.join(told, "group").join(_nested(group_segments, "group"), "group", "left").withColumn("steady_segments", _segments(group_segments, "group"))
        per_group = per_group.select("row_idx", "group", "members", *[c for c in group_rollup.columns if c != "group"], "summary_text", "steady_segments")
    sinks.write_lists(spark, out["steady_state_summary_json"], {"per_sensor": per_sensor.drop("_name"), "per_group": per_group})
    content = F.to_json(F.struct(*[c for c in per_sensor.columns if c not in ("row_idx", "_name")]), {"ignoreNullFields": "false"})
    sinks.write_each(per_sensor.select(F.col("_name").alias("name"), content.alias("content")), f"{folder}/sensors", "_steady_state.json")
    lines = list(REPORT)
    if group_rows:
        out["steady_state_groups_summary_csv"] = files.write_csv(spark, f"{folder}/steady_state_groups_summary.csv", group_rows)
        lines += ["## System / Group Summary", "", *[f"- `{r['group']}` ({r['members']}): {r['summary_text']}" for r in group_rows], "", "## Per-Sensor Summary", ""]
    lines += [f"- `{r['sensor']}`: {r['summary_text']}" for r in rows]
    files.write_text(spark, out["steady_state_report_md"], "\n".join(lines) + "\n")
    return out


def write_cleaned(cleaned: DataFrame, folder: str) -> str:
    """Cleaned values and flags by sensor."""
    cleaned.write.mode("overwrite").partitionBy("sensor").parquet(f"{folder}/cleaned")
    return f"{folder}/cleaned"


def write_curves(curves: DataFrame, folder: str) -> str:
    curves.write.mode("overwrite").partitionBy("sensor").parquet(f"{folder}/characterization")
    return f"{folder}/characterization"
