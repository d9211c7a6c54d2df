"""Ordered work on keys of any size: rows in sorted ranges, and what crosses from one range to the next.

A window over a whole key is one task. Here rows are cut into ranges that tasks share, each range is worked
on by itself, and only a row or two for each range (counts, first and last rows) meet in a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright import files


def laid_out(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` in ranges of about as many rows, with part (the range) and pos (0, 1, ... in it).

    Spark picks the ranges from a sample, so they are written below ``spark.checkpoint.dir`` and read back:
    what is counted of a range and what is done to its rows is then about the same rows. The first column
    alone doesn't decide on the range, so rows of one key spread over as many tasks as there are.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    x = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    x = x.withColumns({"part": F.shiftright(at, 33), "pos": at.bitwiseAND((1 << 33) - 1)})
    path = f"{files.scratch_folder(spark)}/ranges"
    x.write.parquet(path)
    return spark.read.schema(x.schema).parquet(path)


def counted(laid: DataFrame, key: str, **firsts: str) -> DataFrame:
    """Rows of ``laid_out`` numbered within their key: adds nth (0, 1, ...), and for name=column the key's first value of it.

    One row for each range and key goes to a window over the key.
    """
    ends = laid.groupBy(F.col(key).alias("_key"), F.col("part").alias("_part")).agg(F.min("pos").alias("_first"), F.count("*").alias("_n"), *[F.min_by(c, "pos").alias(name) for name, c in firsts.items()])
    w = Window.partitionBy("_key").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = ends.select("_key", "_part", (before - F.col("_first")).alias("_shift"), *[F.first(name).over(every).alias(name) for name in firsts])
    x = laid.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return x.withColumn("nth", F.col("pos") + F.col("_shift")).drop("_key", "_part", "_shift")


def merged_runs(rows: DataFrame, key: str, state: str, partial: list[Column], merged: list[Column]) -> DataFrame:
    """Runs of rows (key, bucket, time, ``state``) whose state is true: key, start_time, end_time, breakout_time and ``merged``.

    breakout_time is the key's next time after the run, null at its end. Buckets follow one another in time.
    A bucket's runs are summed up with ``partial`` where they are; those that touch neither end of their
    bucket are whole, so only two runs of each bucket, at most, meet in a window over the key to be merged.
    """
    w = Window.partitionBy(key, "bucket").orderBy("time")
    x = rows.withColumns({"_new": F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0)), "_next": F.lead("time").over(w)})
    x = x.withColumn("_run", F.sum("_new").over(w))
    runs = x.groupBy(key, "bucket", "_run").agg(
        F.first(state).alias("_on"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max_by("_next", "time").alias("_next"), *partial)
    # Inner runs keep to their bucket; first and last ones share a lane over the key.
    runs = runs.withColumn("_lane", F.when((F.col("_run") > 0) & F.col("_next").isNotNull(), F.col("bucket")))
    lane = Window.partitionBy(key, "_lane").orderBy("start_time")
    goes_on = F.col("_on") & F.lag("_on").over(lane) & F.lag("_next").over(lane).isNull() & (F.col("_run") == 0)
    x = runs.withColumns({"_own": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "_after": F.coalesce("_next", F.lead("start_time").over(lane))})
    x = x.withColumn("_island", F.sum("_own").over(lane)).where("_on")
    out = x.groupBy(key, "_lane", "_island").agg(F.max_by("_after", "end_time").alias("breakout_time"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *merged)
    return out.drop("_lane", "_island")


def with_next(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows (key, bucket, time) with the values of the key's next row in time: for name=column, null at the end.

    Within buckets by a window of each; only the first and last rows of buckets meet in a window over the key.
    """
    w = Window.partitionBy(key, "bucket").orderBy("time")
    first, last = F.lag("time").over(w).isNull(), F.lead("time").over(w).isNull()
    x = rows.withColumns({name: F.lead(c).over(w) for name, c in columns.items()} | {"_edge": first | last, "_last": last})
    x = x.withColumn("_lane", F.when(~F.col("_edge"), F.col("bucket")))
    lane = Window.partitionBy(key, "_lane").orderBy("time")
    return x.withColumns({name: F.when(F.col("_last"), F.lead(c).over(lane)).otherwise(F.col(name)) for name, c in columns.items()}).drop("_edge", "_last", "_lane")
