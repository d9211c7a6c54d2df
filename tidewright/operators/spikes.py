"""Spike detection, repair and gap filling.

Every operator takes ``bucket_rows``: without it, a sensor is one window partition; with it, rows are cut
into buckets of that many, and rows near an edge go to both sides, so that one long sensor spreads over
tasks. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.config import Cleaning
from tidewright.functions import clip

STRATEGIES = ("drop", "nearest", "local_mean", "clip")


def _bucketed(signals: DataFrame, radius: int, bucket_rows: int | None) -> tuple[DataFrame, list[str]]:
    if bucket_rows is None:
        return signals, ["sensor"]
    if bucket_rows < radius:
        raise ValueError("a bucket holds at least as many rows as the window reaches")
    at = lambda d: F.floor((F.col("row_idx") + d) / F.lit(bucket_rows))
    near = F.array_distinct(F.array(at(-radius), at(0), at(radius)))
    x = signals.withColumn("bucket", F.explode(near)).withColumn("own", F.col("bucket") == at(0))
    return x, ["sensor", "bucket"]


def _own(x: DataFrame, bucket_rows: int | None) -> DataFrame:
    return x if bucket_rows is None else x.where("own").drop("bucket", "own")


def _sides(keys: list[str], radius: int):
    w = Window.partitionBy(*keys).orderBy("row_idx")
    return w.rowsBetween(-radius, -1), w.rowsBetween(1, radius)


def _neighbours(keys: list[str], radius: int) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of the neighbours, without the row itself.

    Both sides' moments are merged, which leaves exact zeros where all neighbours are equal.
    """
    side = [tuple(f("value").over(w) for f in (F.count, F.avg, F.var_pop)) for w in _sides(keys, radius)]
    (nl, ml, vl), (nr, mr, vr) = side
    n = nl + nr
    ml, mr, vl, vr = (F.coalesce(c, F.lit(0.0)) for c in (ml, mr, vl, vr))
    mean = F.when(nl == 0, mr).when(nr == 0, ml).otherwise((nl * ml + nr * mr) / n)
    m2 = nl * vl + nr * vr + F.when((nl > 0) & (nr > 0), (ml - mr) * (ml - mr) * nl * nr / n).otherwise(0.0)
    return n, mean, m2


def flag_spikes(
    signals: DataFrame, window_radius: int = 5, z_threshold: float = 3.0, absolute_jump_threshold: float = 0.0, bucket_rows: int | None = None,
) -> DataFrame:
    """Adds flag, near (count of valid neighbours) and near_mean.

    A row is a spike if it has a value and two neighbours within ``window_radius`` rows or more, and lies
    off their mean by more than ``z_threshold`` sample standard deviations (if that is not 0) or by more
    than ``absolute_jump_threshold`` (if that is above 0).
    """
    x, keys = _bucketed(signals, window_radius, bucket_rows)
    n, mean, m2 = _neighbours(keys, window_radius)
    x = x.withColumns({"near": n, "near_mean": mean, "near_m2": m2})
    std = F.sqrt(F.col("near_m2") / (F.col("near") - 1))
    off = F.abs(F.col("value") - F.col("near_mean"))
    spike = (std > 0) & (off > z_threshold * std)
    if absolute_jump_threshold > 0:
        spike = spike | (off > absolute_jump_threshold)
    flag = F.when((F.col("near") >= 2) & F.col("value").isNotNull(), spike)
    x = x.withColumn("flag", F.coalesce(flag, F.lit(False))).withColumn("near_mean", F.when(F.col("near") > 0, F.col("near_mean")))
    return _own(x, bucket_rows).drop("near_m2")


def _bases(flagged: DataFrame, radius: int, bucket_rows: int | None) -> DataFrame:
    """Flagged rows with what their repair takes from rows that no repair changes."""
    x, keys = _bucketed(flagged, radius, bucket_rows)
    left, right = _sides(keys, radius)
    raw = F.when(~F.col("flag"), F.col("value"))
    seen = lambda v: F.when(F.col("value").isNotNull(), v)
    x = x.withColumns({
        "rest": F.coalesce(F.sum(raw).over(left), F.lit(0.0)) + F.coalesce(F.sum("value").over(right), F.lit(0.0)),
        "n": F.count("value").over(left) + F.count("value").over(right),
        "l": F.last(seen(F.struct("row_idx", "value", "flag")), ignorenulls=True).over(left),
        "r": F.first(seen(F.struct("row_idx", "value")), ignorenulls=True).over(right),
    })
    return _own(x, bucket_rows).where("flag").select("sensor", "row_idx", F.struct("row_idx", "rest", "n", "l", "r", F.struct(*flagged.columns).alias("row")).alias("x"))


def _clusters(rows: DataFrame, radius: int) -> DataFrame:
    """Runs of flagged rows that can reach each other; only flagged rows come here."""
    w = Window.partitionBy("sensor").orderBy("row_idx")
    far = F.coalesce((F.col("row_idx") - F.lag("row_idx").over(w) > radius).cast("int"), F.lit(0))
    x = rows.withColumn("far", far).withColumn("cluster", F.sum("far").over(w))
    return x.groupBy("sensor", "cluster").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.signum(a["row_idx"] - b["row_idx"]).cast("int")).alias("rows"))


def repair(
    flagged: DataFrame, strategy: str = "local_mean", window_radius: int = 5, clip_max: float | None = None, bucket_rows: int | None = None,
) -> DataFrame:
    """Adds repaired: ``value`` with flagged rows replaced, from first to last, each by what is repaired so far.

    drop: null. nearest: the closest row with a value, the left one of two. local_mean: the mean of the
    neighbours within ``window_radius``. clip: that, between -|clip_max| and |clip_max|. A row sees
    repaired values on its left and values as they are on its right, so only flagged rows within reach of
    each other depend on one another: these short runs are folded, all other rows are left alone.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown repair strategy: {strategy}")
    if strategy == "drop":
        return flagged.withColumn("repaired", F.when(~F.col("flag"), F.col("value")))
    if strategy == "nearest":
        new = ("CASE WHEN x.l IS NOT NULL AND (x.r IS NULL OR x.row_idx - x.l.row_idx <= x.r.row_idx - x.row_idx) THEN "
               "CASE WHEN x.l.flag THEN filter(acc, y -> y.i = x.l.row_idx)[0].v ELSE x.l.value END ELSE x.r.value END")
    else:
        earlier = f"aggregate(filter(acc, y -> y.i >= x.row_idx - {window_radius}), 0D, (s, y) -> s + y.v)"
        new = f"(x.rest + {earlier}) / x.n"
        if strategy == "clip" and clip_max is not None:
            new = f"least(greatest({new}, {-abs(clip_max)}D), {abs(clip_max)}D)"
    fold = F.expr(f"aggregate(rows, cast(array() as array<struct<i:bigint,v:double>>), (acc, x) -> concat(acc, array(named_struct('i', x.row_idx, 'v', {new}))))")
    # What is flagged comes back from its run with all its columns: there is nothing to join.
    folded = _clusters(_bases(flagged, window_radius, bucket_rows), window_radius).select("rows", fold.alias("new"))
    fixed = folded.select(F.explode(F.expr("transform(rows, (x, i) -> struct(x.row AS row, new[i].v AS repaired))")).alias("f")).select("f.row.*", "f.repaired")
    return flagged.where(~F.col("flag")).withColumn("repaired", F.col("value")).unionByName(fixed)


def local_mean_parallel(flagged: DataFrame, window_radius: int = 5) -> DataFrame:
    """Adds repaired: flagged rows become the mean of their neighbours as they are, each by itself."""
    return flagged.withColumn("repaired", F.when(F.col("flag"), F.col("near_mean")).otherwise(F.col("value")))


def fill_missing(signals: DataFrame, column: str = "value", into: str = "filled", bucket_rows: int | None = None) -> DataFrame:
    """Adds ``into``: gaps of ``column`` on a line over the row index, the ends flat, a sensor without values 0.

    With ``bucket_rows``, what lies beyond a bucket comes from one row for each bucket.
    """
    known = F.when(F.col(column).isNotNull(), F.struct("row_idx", F.col(column).alias("v")))
    if bucket_rows is None:
        x, keys = signals, ["sensor"]
    else:
        x, keys = signals.withColumn("bucket", F.floor(F.col("row_idx") / F.lit(bucket_rows))), ["sensor", "bucket"]
        ends = x.where(F.col(column).isNotNull()).groupBy("sensor", "bucket").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
        all_ = x.select("sensor", "bucket").distinct().join(ends, ["sensor", "bucket"], "left")
        up, down = (Window.partitionBy("sensor").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("bucket"), F.desc("bucket")))
        all_ = all_.withColumns({"before": F.last("hi", ignorenulls=True).over(up), "after": F.last("lo", ignorenulls=True).over(down)})
        x = x.join(all_.select("sensor", "bucket", "before", "after"), ["sensor", "bucket"])
    # Backwards too, the frame grows by a row at a time: one that shrinks would be summed up anew for each row.
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("row_idx"), F.desc("row_idx")))
    x = x.withColumns({"p": F.last(known, ignorenulls=True).over(up), "q": F.last(known, ignorenulls=True).over(down)})
    if bucket_rows is not None:
        x = x.withColumns({"p": F.coalesce("p", "before"), "q": F.coalesce("q", "after")})
    slope = (F.col("q.v") - F.col("p.v")) / (F.col("q.row_idx") - F.col("p.row_idx"))
    line = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), slope * (F.col("row_idx") - F.col("p.row_idx")) + F.col("p.v"))
    filled = F.coalesce(F.col(column), line, F.col("p.v"), F.col("q.v"), F.lit(0.0))
    return x.withColumn(into, filled).drop("p", "q", "bucket", "before", "after")


def clean(signals: DataFrame, config: Cleaning | None = None, bucket_rows: int | None = None) -> DataFrame:
    """(sensor, row_idx, time, original, cleaned, flag): flags, repair, and filling if the policy says so."""
    c = config or Cleaning()
    x = flag_spikes(signals, c.window_radius, c.z_threshold, c.absolute_jump_threshold, bucket_rows)
    x = repair(x, c.strategy, c.window_radius, c.clip_max, bucket_rows)
    if c.nan_policy == "interpolate":
        x = fill_missing(x, "repaired", "cleaned", bucket_rows)
    else:
        x = x.withColumn("cleaned", F.col("repaired"))
    return x.select("sensor", "row_idx", "time", F.col("value").alias("original"), "cleaned", "flag")


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row for each sensor: counts, and mean and population deviation before and after."""
    flagged = F.count_if("flag")
    return cleaned.groupBy("sensor").agg(
        F.count("*").alias("n_points"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("fraction_flagged"),
        F.avg("original").alias("mean_original"), F.avg("cleaned").alias("mean_cleaned"),
        F.stddev_pop("original").alias("std_original"), F.stddev_pop("cleaned").alias("std_cleaned"),
        F.min("cleaned").alias("min_cleaned"), F.max("cleaned").alias("max_cleaned"))


def clipped(signals: DataFrame, limit: float) -> DataFrame:
    """``value`` between -|limit| and |limit|."""
    return signals.withColumn("value", clip(F.col("value"), limit))
