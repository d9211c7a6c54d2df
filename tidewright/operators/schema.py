"""Which column is time, which are sensors, and raw tables to signals."""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.config import Config
from tidewright.functions import instant, normalize_header, number
from tidewright.operators.signals import elapsed_seconds, quoted, unpivot

LOG = logging.getLogger(__name__)
#: Values of a column that are looked at, and groups of partitions that are merged first.
SAMPLE, GROUPS = 2000, 256
#: Scores of normalized headers, and of parts of them.
NAME_SCORES = {
    "time": 10.0, "t": 7.0, "seconds": 9.0, "second": 8.0, "sec": 8.0, "s": 5.0, "timestamp": 10.0,
    "datetime": 10.0, "date_time": 10.0, "elapsed_time": 10.0, "x_value": 9.0,
}
PART_SCORES = ((("time",), 5.0), (("sec",), 3.0), (("stamp", "date"), 2.0))
#: A time column leads by so much and has so much, confidence is the share of so much; sensors are numbers in this share of rows.
LEAD, LEAST, FULL, NUMERIC = 1.5, 4.0, 15.0, 0.75
#: Reasons where no values are looked at.
MANUAL, NOTHING = "manual override", "no columns found"
#: What the scores of a column's values stand for.
NOTES = {"empty": "all values are missing in sampled rows", "monotone": "values are monotone nondecreasing",
         "elapsed": "values look like elapsed time", "datetime": "values parse as datetimes"}


@dataclass(frozen=True)
class TimeColumn:
    original_name: str | None
    normalized_name: str | None
    confidence: float
    candidate_scores: dict[str, float]
    reasoning: list[str]
    ambiguous: bool


@dataclass(frozen=True)
class Mapping:
    original_headers: list[str]
    normalized_headers: list[str]
    time_column: TimeColumn
    sensor_columns: list[str]
    sensor_columns_normalized: list[str]
    excluded_columns: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def name_score(normalized: str) -> float:
    return NAME_SCORES.get(normalized, 0.0) + sum(s for parts, s in PART_SCORES if any(p in normalized for p in parts))


def with_rows(raw: DataFrame) -> DataFrame:
    """Adds row_idx, 0, 1, ... in the order in which the table is read.

    Partitions are numbered by a count of each (one row for each partition), so no task sees all rows.
    """
    if "row_idx" in raw.columns:
        return raw
    x = raw.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright("_mono", 33)
    sizes = x.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    # One row for each partition of the input.
    x = x.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return x.withColumn("row_idx", F.col("_start") + F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_mono", "_part", "_start")


def first_values(raw: DataFrame, columns: list[str], in_order: bool) -> DataFrame:
    """(column, row_idx, s): the first SAMPLE values of each column as strings.

    A partition hands on at most SAMPLE values of a column, and where rows come in order it stops reading once
    it has them. They are merged in two steps, so that no task sees those of all partitions.
    """

    def run(batches):
        found = {c: (np.zeros(0, np.int64), pa.array([], pa.string())) for c in columns}
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for k, c in enumerate(columns, 1):
                at, values = found[c]
                cells = batch.column(k)
                here = np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False))
                if in_order:
                    here = here[:SAMPLE - len(at)]
                if len(here):
                    at, values = np.append(at, rows[here]), pa.concat_arrays([values, cells.take(pa.array(here))])
                    if len(at) > SAMPLE:
                        least = np.argsort(at, kind="stable")[:SAMPLE]
                        at, values = at[least], values.take(pa.array(least))
                    found[c] = (at, values)
            if in_order and all(len(at) == SAMPLE for at, _ in found.values()):
                break
        part = TaskContext.get().partitionId()
        for c, (at, values) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.string()), pa.array(at), values, pa.array(np.full(len(at), part % GROUPS, np.int32))], names=["column", "row_idx", "s", "grp"])

    x = raw.select(F.col("row_idx").cast("long"), *[F.col(quoted(c)).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    x = x.mapInArrow(run, "column string, row_idx long, s string, grp int")
    for keys in (["column", "grp"], ["column"]):
        x = x.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx"))).where(F.col("nth") <= SAMPLE)
    return x.select("column", "row_idx", "s")


def value_features(raw: DataFrame, columns: list[str], in_order: bool = False) -> DataFrame:
    """One row about the first SAMPLE values of each column that has any: column, n, numeric, monotone, moving, datetime.

    ``in_order`` says that rows are read by row_idx, as ``with_rows`` numbers them; a table without row_idx is numbered here.
    """
    if "row_idx" not in raw.columns:
        raw, in_order = with_rows(raw), True
    x = first_values(raw, columns, in_order).select("column", "row_idx", "s", number("s").alias("v"))
    order = Window.partitionBy("column").orderBy("row_idx")
    # Steps from one number to the next: the last one before it, whatever stands between.
    before = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step, share = F.col("v") - F.col("before"), lambda c: F.avg(c.isNotNull().cast("double"))
    return x.withColumn("before", before).groupBy("column").agg(
        F.count("*").alias("n"), share(F.col("v")).alias("numeric"), F.coalesce(F.bool_and(step >= -1e-12), F.lit(False)).alias("monotone"),
        (F.coalesce(F.percentile(F.abs(step), 0.5), F.lit(0.0)) > 0).alias("moving"), share(instant("s")).alias("datetime"))


def value_score(n: int, numeric: float | None, monotone: bool, moving: bool, datetime: float | None) -> tuple[float, list[str]]:
    """Score and notes of a column by what ``value_features`` tells."""
    if not n:
        return 0.0, [NOTES["empty"]]
    score, notes = 0.0, []
    if numeric > 0.9:
        score += 3.0 + 3.0 * monotone + 1.5 * moving
        notes = [NOTES[k] for k, on in (("monotone", monotone), ("elapsed", moving)) if on]
    elif numeric < 0.5 and datetime > 0.9:
        score, notes = 5.0, [NOTES["datetime"]]
    return score, notes


def infer_time_column(raw: DataFrame, manual: str | None = None, in_order: bool = False) -> TimeColumn:
    """The best column by name and values; ambiguous if it leads by less than LEAD or has less than LEAST."""
    headers = [c for c in raw.columns if c != "row_idx"]
    plain = {h: normalize_header(h) for h in headers}
    if manual is not None:
        # The header itself before one that only looks like it.
        for h in sorted((h for h in headers if plain[h] == normalize_header(manual) or h == manual), key=lambda h: h != manual):
            return TimeColumn(h, plain[h], 1.0, {h: 1.0}, [MANUAL], False)
        raise ValueError(f"no such time column: {manual}")
    if not headers:
        return TimeColumn(None, None, 0.0, {}, [NOTHING], True)
    rows = {f["column"]: f for f in value_features(raw, headers, in_order).collect()}  # a row for each column
    ranked = []
    for place, h in enumerate(headers):
        f = rows.get(h)
        by_value, notes = value_score(f["n"], f["numeric"], f["monotone"], f["moving"], f["datetime"]) if f else (0.0, [NOTES["empty"]])
        by_name = name_score(plain[h])
        ranked.append((-(by_name + by_value), place, h, [f"name_score={by_name:.2f}", f"value_score={by_value:.2f}", *notes]))
    ranked.sort(key=lambda r: r[:2])
    top, _, best, why = ranked[0]
    lead = ranked[1][0] - top if len(ranked) > 1 else float("inf")
    return TimeColumn(best, plain[best], min(-top / FULL, 1.0), {h: -score for score, _, h, _ in sorted(ranked, key=lambda r: r[1])}, why, lead < LEAD or -top < LEAST)


def numeric_fractions(raw: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of all rows in which each column is a number."""
    return raw.agg(*[F.coalesce(F.avg(number(F.col(quoted(c)).cast("string")).isNotNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])


def infer_sensor_columns(raw: DataFrame, time_column: str | None, manual: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Columns that are numbers in three quarters of all rows or more; or those of ``manual`` that exist."""
    headers = [c for c in raw.columns if c != "row_idx"]
    if manual:
        return [c for c in manual if c in headers]
    out = {normalize_header(c) for c in (exclude or [])} | ({normalize_header(time_column)} if time_column else set())
    left = [c for c in headers if normalize_header(c) not in out]
    if not left:
        return []
    shares = numeric_fractions(raw, left).first()
    return [c for c, share in zip(left, shares, strict=True) if share >= NUMERIC]


def infer_schema(raw: DataFrame, config: Config | None = None, in_order: bool = False) -> Mapping:
    s = (config or Config()).schema
    headers = [c for c in raw.columns if c != "row_idx"]
    time = infer_time_column(raw, s.manual_time_column, in_order)
    sensors = infer_sensor_columns(raw, time.original_name, s.manual_sensor_columns, s.exclude_columns)
    notes = []
    if time.ambiguous:
        notes.append("time column inference is ambiguous; consider explicit override")
        LOG.warning("Ambiguous time column: %s", time.candidate_scores)
    return Mapping(headers, [normalize_header(h) for h in headers], time, sensors, [normalize_header(s) for s in sensors], list(s.exclude_columns or []), notes)


def normalize(raw: DataFrame, name: str, config: Config | None = None) -> tuple[DataFrame, dict]:
    """Signals of a raw table, and a summary: name, rows, sensors, where time comes from, the schema mapping.

    Time is the inferred column: numbers as they are, dates in seconds from the first row. Where that is
    ambiguous or neither, it is the row index if the settings allow. An ambiguous column is not a sensor.
    """
    config = config or Config()
    in_order = "row_idx" not in raw.columns
    raw = with_rows(raw)
    mapping = infer_schema(raw, config, in_order)
    column, source, time = mapping.time_column.original_name, "generated_index", F.col("row_idx").cast("double")
    if column is not None and not mapping.time_column.ambiguous:
        text = F.col(quoted(column)).cast("string")
        share = raw.agg(F.avg(number(text).isNotNull().cast("double")), F.avg(instant(text).isNotNull().cast("double"))).first()
        if (share[0] or 0) > 0.9:
            time, source = number(text), column
        elif (share[1] or 0) > 0.9:
            first = raw.orderBy("row_idx").select(instant(text)).first()[0]
            time, source = elapsed_seconds(instant(text), F.lit(first).cast("timestamp")), column
    if source == "generated_index" and not config.allow_index_time_fallback:
        raise ValueError("Could not confidently infer time column; pass a manual override")
    wide = raw.withColumn("_time", time)
    sensors = mapping.sensor_columns
    signals = unpivot(wide, sensors, "_time") if sensors else raw.sparkSession.createDataFrame([], "sensor string, row_idx long, time double, value double")
    summary = {"dataset_name": name, "n_rows": raw.count(), "n_sensors": len(sensors), "sensor_columns": sensors, "time_source": source, "schema_mapping": mapping.as_dict()}
    return signals, summary


def dataset_summary(signals: DataFrame, name: str) -> DataFrame:
    """One row: name, n_rows, n_sensors, sensor_names, time_min, time_max."""
    return signals.agg(
        F.lit(name).alias("dataset_name"), F.countDistinct("row_idx").alias("n_rows"), F.countDistinct("sensor").alias("n_sensors"),
        F.array_sort(F.collect_set("sensor")).alias("sensor_names"), F.min("time").alias("time_min"), F.max("time").alias("time_max"))
