"""Dense curves through a signal's samples: straight lines, or a not-a-knot cubic spline.

Long sensors are cut into runs of knots. A spline's slope at a knot depends on knots k away by less than
0.27**k, so a run that is solved with HALO knots more on both sides agrees with the whole to rounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import ranges
from tidewright.operators.signals import valid_samples

#: Knots of a run, and knots more on both sides of it.
RUN, HALO = 50_000, 64


def grid_sizes(samples: DataFrame, dense_factor: float) -> DataFrame:
    """(sensor, n, dense_n, t0, t1): a grid has max(int(n * factor), n) points; under 4 samples there is none."""
    x = samples.groupBy("sensor").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    return x.withColumn("dense_n", F.greatest(F.floor(F.col("n") * F.lit(float(dense_factor))), F.col("n")))


def stretched(samples: DataFrame, sizes: DataFrame, run: int) -> DataFrame:
    """Samples of sensors with 4 or more, with their sensor's sizes and a stretch of time of about ``run`` samples (bucket)."""
    x = samples.join(sizes.where("n >= 4"), "sensor")
    return x.withColumn("bucket", F.floor((F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0")) * F.ceil(F.col("n") / F.lit(run))))


def dense_linear(signals: DataFrame, dense_factor: float = 4, value: str = "value", run: int = RUN) -> DataFrame:
    """(sensor, k, time, value) on the dense grid, by lines between neighbouring samples.

    Each sample makes the grid points up to the next one, so the grid needs no join with the samples.
    """
    samples = valid_samples(signals, value)
    x = stretched(samples, grid_sizes(samples, dense_factor), run)
    x = ranges.with_next(x, "sensor", {"t2": "time", "v2": "value"}).withColumnsRenamed({"time": "t", "value": "v"})
    x = x.withColumn("step", F.col("t1") - F.col("t0")).withColumn("step", F.col("step") / (F.col("dense_n") - 1))
    # A point more on both sides: which of them lie in the interval is told by their own times.
    near = lambda t, d: F.floor((F.col(t) - F.col("t0")) / F.col("step")).cast("long") + d
    x = x.withColumns({"lo": F.greatest(near("t", -1), F.lit(0).cast("long")), "hi": F.least(F.coalesce(near("t2", 1), F.col("dense_n") - 1), F.col("dense_n") - 1)})
    # A long gap's points unfold a run at a time.
    x = x.withColumn("piece", F.explode(F.expr(f"sequence(lo div {RUN}, hi div {RUN})")))
    x = x.withColumn("k", F.explode(F.expr(f"sequence(greatest(lo, piece * {RUN}), least(hi, (piece + 1) * {RUN} - 1))")))
    x = x.withColumn("time", F.when(F.col("k") == F.col("dense_n") - 1, F.col("t1")).otherwise(F.col("t0") + F.col("k") * F.col("step")))
    x = x.where("time >= t AND (t2 IS NULL OR time < t2)")
    line = (F.col("v2") - F.col("v")) / (F.col("t2") - F.col("t")) * (F.col("time") - F.col("t")) + F.col("v")
    return x.select("sensor", "k", "time", F.coalesce(line, F.col("v")).alias("value"))


def spline_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """First derivatives at the knots of the not-a-knot cubic spline (4 knots or more).

    Rows say that second derivatives agree at inner knots; the first and last row, that the third
    derivatives agree at the second and the last but one. One forward and one backward pass solve it.
    """
    h, n = np.diff(t), len(t)
    d = np.diff(v) / h
    low, mid, high, b = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], high[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    b[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    s = h[0] + h[1]
    mid[0], high[0], b[0] = h[1], s, ((h[0] + 2 * s) * h[1] * d[0] + h[0] ** 2 * d[1]) / s
    s = h[-1] + h[-2]
    mid[-1], low[-1], b[-1] = h[-2], s, (h[-1] ** 2 * d[-2] + (2 * s + h[-1]) * h[-2] * d[-1]) / s
    for k in range(1, n):
        f = low[k] / mid[k - 1]
        mid[k] -= f * high[k - 1]
        b[k] -= f * b[k - 1]
    out = np.empty(n)
    out[-1] = b[-1] / mid[-1]
    for k in range(n - 2, -1, -1):
        out[k] = (b[k] - high[k] * out[k + 1]) / mid[k]
    return out


def spline_values(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    m, h = spline_slopes(t, v), np.diff(t)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    u = (at - t[k]) / h[k]
    return (v[k] * (1 + 2 * u) * (1 - u) ** 2 + h[k] * m[k] * u * (1 - u) ** 2 + v[k + 1] * u * u * (3 - 2 * u) + h[k] * m[k + 1] * u * u * (u - 1))


def dense_cubic(signals: DataFrame, dense_factor: float = 4, value: str = "value", run: int = RUN) -> DataFrame:
    """(sensor, k, time, value) on the dense grid, by the not-a-knot cubic spline."""
    samples = valid_samples(signals, value)
    sizes = grid_sizes(samples, dense_factor)
    # Rank within a sensor, by one row for each stretch of time.
    x = stretched(samples, sizes, run).withColumnRenamed("bucket", "stretch")
    sums = x.groupBy("sensor", "stretch").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("sensor").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    x = x.join(sums.select("sensor", "stretch", F.coalesce(before, F.lit(0)).alias("before")), ["sensor", "stretch"])
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("sensor", "stretch").orderBy("time")) - 1 + F.col("before"))
    at = lambda d: F.floor(F.least(F.greatest(F.col("i") + d, F.lit(0)), F.col("n") - 1) / F.lit(run))
    x = x.withColumn("part", F.explode(F.array_distinct(F.array(at(-HALO), at(0), at(HALO)))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        t, v, i = pdf["time"].to_numpy(), pdf["value"].to_numpy(), pdf["i"].to_numpy()
        part, dense, t0, t1, n = (pdf[c].iloc[0] for c in ("part", "dense_n", "t0", "t1", "n"))
        lo = t[np.searchsorted(i, part * run)]
        after = np.searchsorted(i, (part + 1) * run)
        step = (t1 - t0) / (dense - 1)
        end = t[after] if after < len(t) else t1
        k = np.arange(max(0, int((lo - t0) / step) - 1), min(int(dense), int((end - t0) / step) + 3))
        at = np.where(k == dense - 1, t1, t0 + k * step)
        m = (at >= lo) & ((at < end) | (after >= len(t)))
        return pd.DataFrame({"sensor": pdf["sensor"].iloc[0], "k": k[m], "time": at[m], "value": spline_values(t, v, at[m])})

    cols = x.select("sensor", "part", "i", "time", "value", "dense_n", "t0", "t1", "n")
    return cols.groupBy("sensor", "part").applyInPandas(solve, "sensor string, k long, time double, value double")


def characterize(signals: DataFrame, method: str = "cubic_spline", dense_factor: float = 4, value: str = "value") -> DataFrame:
    """(sensor, method, k, time, value): the dense curve, or the samples themselves where there are fewer than 4."""
    cubic = method == "cubic_spline"
    dense = (dense_cubic if cubic else dense_linear)(signals, dense_factor, value).withColumn("method", F.lit("cubic_spline" if cubic else "linear_interp_fallback"))
    samples = valid_samples(signals, value)
    few = samples.groupBy("sensor").agg(F.count("*").alias("n")).where("n < 4").select("sensor")
    k = (F.row_number().over(Window.partitionBy("sensor").orderBy("time")) - 1).cast("long")
    few = samples.join(few, "sensor").select("sensor", F.lit("insufficient_points").alias("method"), k.alias("k"), "time", "value")
    return dense.select("sensor", "method", "k", "time", "value").union(few)


def curve_summary(dense: DataFrame) -> DataFrame:
    """(sensor, method, n_dense) of ``characterize``."""
    return dense.groupBy("sensor", "method").agg(F.count("*").alias("n_dense"))


def pixels(signals: DataFrame, width: int, value: str = "value") -> DataFrame:
    """What a plot of ``width`` pixels shows: for each sensor and pixel column its n, first, last, least and greatest value.

    Lines drawn through these look like lines through all samples, so a curve of any length becomes at most
    four points a column. Columns without samples aren't there; a sensor of one time has one column.
    """
    samples = valid_samples(signals, value)
    ends = samples.groupBy("sensor").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    at = F.least(F.floor((F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0")) * F.lit(width)), F.lit(width - 1))
    x = samples.join(ends, "sensor").withColumn("pixel", F.when(F.col("t1") > F.col("t0"), at).otherwise(0).cast("long"))
    return x.groupBy("sensor", "pixel").agg(
        F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min_by("value", "time").alias("first_value"), F.max_by("value", "time").alias("last_value"),
        F.min("value").alias("least_value"), F.max("value").alias("greatest_value"))
