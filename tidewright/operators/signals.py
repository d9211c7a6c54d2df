"""Signals: wide to long and back, time axes, duplicates in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import number
from tidewright.operators import ranges


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpivot(wide: DataFrame, sensors: list[str], time: str = "time", row_idx: str = "row_idx") -> DataFrame:
    """Long signals of a wide table's sensor columns, numbers only."""
    x = wide.select(F.col(quoted(row_idx)).cast("long").alias("row_idx"), number(F.col(quoted(time))).alias("time"), *[number(F.col(quoted(s))).alias(f"c{k}") for k, s in enumerate(sensors)])
    names = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + f"', c{k}" for k, s in enumerate(sensors))
    return x.selectExpr("row_idx", "time", f"stack({len(sensors)}, {names}) as (sensor, value)").select("sensor", "row_idx", "time", "value")


def pivot(signals: DataFrame, sensors: list[str], value: str = "value") -> DataFrame:
    """Wide table (row_idx, time, one column for each sensor)."""
    return signals.groupBy("row_idx", "time").pivot("sensor", sensors).agg(F.first(value))


def by_row(*keys: str):
    return Window.partitionBy(*(keys or ("sensor",))).orderBy("row_idx")


def elapsed_seconds(ts: str | Column, first: Column) -> Column:
    """Seconds from ``first`` to a timestamp, with or without zone."""
    end = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", first, end) / F.lit(1e6)


def numbered(df: DataFrame, sensor: str, ts: str, value: str, *order: str) -> DataFrame:
    """Signals of an event table: rows in time order for each sensor, time in seconds from its first row.

    Rows are sorted in ranges of sensor and time that all tasks share, however long a sensor is.
    """
    keys = [f"o{k}" for k in range(len(order))]
    x = df.select(F.col(sensor).alias("sensor"), F.col(ts).alias("ts"), number(value).alias("value"), *[F.col(o).alias(k) for k, o in zip(keys, order, strict=True)])
    x = ranges.counted(ranges.laid_out(x, ["sensor", "ts", *keys]), "sensor", start="ts")
    return x.select("sensor", F.col("nth").alias("row_idx"), elapsed_seconds("ts", F.col("start")).alias("time"), "value")


def index_time(signals: DataFrame) -> DataFrame:
    """Time generated from the row index."""
    return signals.withColumn("time", F.col("row_idx").cast("double"))


def valid_samples(signals: DataFrame, value: str = "value") -> DataFrame:
    """Samples with time and value, the first row of each time."""
    x = signals.where(F.col("time").isNotNull() & F.col(value).isNotNull())
    least = F.struct("row_idx", F.col(value).alias("value"))
    return x.groupBy("sensor", "time").agg(F.min(least).alias("m")).select("sensor", F.col("m.row_idx").alias("row_idx"), "time", F.col("m.value").alias("value"))
