"""Work on sorted ranges against plain windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.config import Steady
from tidewright.operators import ranges, resample, schema, signals, steady


def rows_of(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_one_long_sensor_spreads_over_all_tasks(spark):
    x = spark.range(200_000).select(F.lit("s").alias("sensor"), F.timestamp_seconds(F.col("id") * 7919 % 200_000).alias("ts"), F.col("id").cast("double").alias("value"), "id")
    laid = ranges.laid_out(x.select("sensor", "ts", "value", "id"), ["sensor", "ts", "id"], parts=8)
    sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 200_000 / 8
    got = signals.numbered(x, "sensor", "ts", "value", "id")
    wrong = got.where("row_idx <> time OR pmod(cast(value as long) * 7919, 200000) <> row_idx")
    assert got.count() == 200_000 and wrong.count() == 0
    # No window over rows of a whole sensor: the only ones are over ranges.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "row_number" not in plan


def test_numbered_matches_a_plain_window(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None, "c" * 20]), r.choice([None, r.randrange(40)]), r.random(), k) for k in range(500)]
    rows += [("once", 3, 1.0, 900), ("nulls", None, 1.0, 901), ("nulls", None, None, 902)]
    x = spark.createDataFrame(rows, "sensor string, t int, value double, id long").withColumn("ts", F.timestamp_seconds("t"))
    w = Window.partitionBy("sensor").orderBy("ts", "id")
    want = x.select("sensor", (F.row_number().over(w) - 1).cast("long").alias("row_idx"), signals.elapsed_seconds("ts", F.first("ts").over(w)).alias("time"), "value")
    keys = ("sensor", "row_idx", "time", "value")
    assert rows_of(signals.numbered(x, "sensor", "ts", "value", "id"), *keys) == rows_of(want, *keys)
    assert signals.numbered(x.limit(0), "sensor", "ts", "value", "id").count() == 0


@pytest.mark.parametrize("width", [1.0, 3.0, 7.0, 1e9])
def test_runs_match_islands_of_whole_keys(spark, width):
    r = random.Random(2)
    rows = [(key, float(t), r.random() < share, r.random()) for key, share in (("a", 0.5), ("b", 0.9), ("c", 1.0), ("d", 0.0)) for t in sorted(r.sample(range(200), 90))]
    x = spark.createDataFrame(rows, "key string, time double, on boolean, value double")
    w = Window.partitionBy("key").orderBy("time")
    y = x.withColumns({"new": F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(0)), "next": F.lead("time").over(w)}).withColumn("island", F.sum("new").over(w)).where("on")
    want = y.groupBy("key", "island").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max_by("next", "time").alias("breakout_time"), F.max("value").alias("top"))
    got = ranges.merged_runs(x.withColumn("bucket", F.floor(F.col("time") / width)), "key", "on", [F.max("value").alias("m")], [F.max("m").alias("top")])
    keys = ("key", "start_time", "end_time", "breakout_time", "top")
    assert rows_of(got, *keys) == rows_of(want, *keys)


@pytest.mark.parametrize("run", [2, 5, 1000])
def test_lines_match_interpolation(spark, run):
    import numpy as np

    r = random.Random(3)
    rows = []
    for s, n in (("a", 40), ("b", 7), ("few", 3), ("gap", 6)):
        t = sorted(r.sample(range(300), n - 1)) + [5000 if s == "gap" else 400]
        rows += [(s, k, float(v), r.random()) for k, v in enumerate(t)]
    x = spark.createDataFrame(rows, "sensor string, row_idx long, time double, value double")
    got = {}
    for s, k, t, v in rows_of(resample.dense_linear(x, 3.5, run=run), "sensor", "k", "time", "value"):
        got.setdefault(s, []).append((k, t, v))
    for s in ("a", "b", "gap"):
        t, v = (np.array([q[c] for q in rows if q[0] == s]) for c in (2, 3))
        at = np.linspace(t[0], t[-1], int(len(t) * 3.5))
        assert [k for k, *_ in got[s]] == list(range(len(at)))
        assert np.allclose([q[1] for q in got[s]], at) and np.allclose([q[2] for q in got[s]], np.interp(at, t, v))
    assert "few" not in got


def test_default_buckets_match_whole_sensors(spark, monkeypatch):
    r = random.Random(4)
    rows = [(s, k, float(k), 5.0 + r.random() * (k % 50 > 30)) for s in "ab" for k in range(300)]
    x = spark.createDataFrame(rows, "sensor string, row_idx long, time double, value double")
    c = Steady(steady_window_seconds=6, min_steady_duration_seconds=4)
    monkeypatch.setattr(steady, "BUCKET_WINDOWS", 3)
    near = lambda rs: [tuple(round(v, 9) if isinstance(v, float) else v for v in q) for q in rs]
    keys = ("sensor", "start_time", "end_time", "breakout_time", "mean_value", "mean_abs_slope", "max_local_std")
    small, whole = (near(rows_of(steady.steady_segments(steady.steady_mask(x, c, bucket_seconds=b), 4.0), *keys)) for b in (None, float("inf")))
    assert small == whole and len(small) > 4


def test_first_values_are_bounded_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(schema, "SAMPLE", 50)
    x = spark.range(0, 40_000, 1, 8).select(
        F.col("id").cast("string").alias("all"), F.when(F.col("id") % 1000 == 7, F.col("id").cast("string")).alias("some"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") > 30_000, F.col("id").cast("string")).alias("late"))
    got = {}
    for c, k in rows_of(schema.first_values(schema.with_rows(x), x.columns, True), "column", "row_idx"):
        got.setdefault(c, []).append(k)
    assert got == {"all": list(range(50)), "some": [7 + 1000 * k for k in range(40)], "late": list(range(30_001, 30_051))}
    back = schema.with_rows(x).withColumn("row_idx", 39_999 - F.col("row_idx"))
    assert [k for c, k in rows_of(schema.first_values(back, ["all"], False), "column", "row_idx")] == list(range(50))
    one = schema.first_values(schema.with_rows(x.limit(0)), x.columns, True)
    assert one.count() == 0
    # Every exchange lies above the step that bounds what a partition hands on.
    plan = schema.value_features(schema.with_rows(x), x.columns, True)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "hashpartitioning(column" not in below
