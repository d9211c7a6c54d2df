"""Spike flags of tables that grow: chunks of rows arrive, flags go out as soon as a row's right side is there.

A sensor's state is its row count, its first time and its last 2 * radius rows, however long it gets. Each
micro-batch continues from it; rows wait for ``window_radius`` rows after them, or for the sensor's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.functions import number

OUT = "sensor string, row_idx long, time double, value double, near long, near_mean double, flag boolean"
STATE = "n long, start long, times array<double>, values array<double>"


def _side(v: np.ndarray, at: np.ndarray, offsets: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population variance of the values at ``at`` plus each offset; NaN and what lies outside don't count."""
    where = at[:, None] + np.array(offsets)[None, :]
    inside = (where >= 0) & (where < len(v))
    x = np.where(inside, v[np.clip(where, 0, max(len(v) - 1, 0))], np.nan)
    n = (~np.isnan(x)).sum(axis=1)
    mean = np.nansum(x, axis=1) / np.maximum(n, 1)
    return n, mean, np.nansum((x - mean[:, None]) ** 2, axis=1) / np.maximum(n, 1)


def spikes(v: np.ndarray, at: np.ndarray, radius: int, z: float, jump: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, near_mean, flag) of the rows at ``at``, as ``operators.spikes.flag_spikes`` defines them."""
    nl, ml, vl = _side(v, at, range(-radius, 0))
    nr, mr, vr = _side(v, at, range(1, radius + 1))
    n = nl + nr
    mean = np.where(nl == 0, mr, np.where(nr == 0, ml, (nl * ml + nr * mr) / np.maximum(n, 1)))
    m2 = nl * vl + nr * vr + np.where((nl > 0) & (nr > 0), (ml - mr) ** 2 * nl * nr / np.maximum(n, 1), 0.0)
    std = np.sqrt(m2 / np.maximum(n - 1, 1))
    off = np.abs(v[at] - mean)
    hit = (std > 0) & (off > z * std)
    if jump > 0:
        hit |= off > jump
    return n, np.where(n > 0, mean, np.nan), hit & (n >= 2) & ~np.isnan(v[at])


def flag_stream(rows: DataFrame, window_radius: int = 5, z_threshold: float = 3.0, absolute_jump_threshold: float = 0.0) -> DataFrame:
    """Flags of a stream (sensor, ts, value, ord): row_idx, time, value, near, near_mean, flag, in append mode.

    A sensor's rows come in order over micro-batches, and are sorted by ts and ord within one. time counts
    seconds from its first row. A row with a null ts ends its sensor, which lets its last rows go; rows
    after that begin it anew.
    """
    w = window_radius

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, start, times, values = state.get if state.exists else (0, None, [], [])
        new = pd.concat(list(parts)).sort_values(["us", "ord"], kind="stable")
        ended = bool(new["us"].isna().any())
        new = new[new["us"].notna()]
        if start is None and len(new):
            start = int(new["us"].iloc[0])
        t = np.append(np.array(times, float), (new["us"].to_numpy(float) - (start or 0)) / 1e6)
        v = np.append(np.array(values, float), new["value"].to_numpy(float))
        first, total = n - len(values), n + len(new)  # the row that v begins with, and the rows so far
        go = np.arange(max(n - w, 0), total if ended else max(total - w, 0))
        if len(go):
            at = go - first
            near, mean, flag = spikes(v, at, w, z_threshold, absolute_jump_threshold)
            yield pd.DataFrame({"sensor": key[0], "row_idx": go, "time": t[at], "value": v[at], "near": near, "near_mean": mean, "flag": flag})
        if ended:
            state.remove()
        else:
            kept = min(2 * w, len(v))
            state.update((total, start, t[len(t) - kept:].tolist(), v[len(v) - kept:].tolist()))

    x = rows.select("sensor", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ord", F.coalesce(number("value"), F.lit(float("nan"))).alias("value"))
    out = x.groupBy("sensor").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "near_mean")})


def run_batch(spark: SparkSession, source: str, schema, out: str, checkpoint: str, fmt: str = "parquet", **settings) -> None:
    """Takes what has come to the folder ``source`` since the last call and appends flags to the folder ``out``.

    The checkpoint folder holds what has been read and each sensor's state, so a run that fails, or another
    session, goes on where the last one ended.
    """
    rows = spark.readStream.schema(schema).format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).load(source)
    q = flag_stream(rows, **settings).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
