import numpy as np
import pytest

from tidewright import reports
from tidewright.config import Steady
from tidewright.operators import resample, steady
from tidewright.workflow import steady_tables
from tidewright.config import Config

CFG = Steady(steady_window_seconds=30, min_steady_duration_seconds=20, change_fraction_of_scale=0.08, std_fraction_of_scale=0.05)


def plateaus(spark):
    a = [10.0] * 70 + list(np.linspace(10, 20, 40)) + [20.0] * 70
    b = [5.0] * 90 + list(np.linspace(5, 8, 30)) + [8.0] * 60
    return spark.createDataFrame([(s, i, float(i), float(v)) for s, vs in (("sensor_a", a), ("sensor_b", b)) for i, v in enumerate(vs)], "sensor string, row_idx long, time double, value double")


def spans(df, key):
    out = {}
    for r in df.orderBy(key, "start_time").collect():
        out.setdefault(r[key], []).append((r["start_time"], r["end_time"], r["breakout_time"]))
    return out


@pytest.mark.parametrize("bucket", [None, 45.0])
def test_plateau_ramp_plateau(spark, bucket):
    mask = steady.steady_mask(plateaus(spark), CFG, bucket_seconds=bucket)
    found = spans(steady.steady_segments(mask, CFG.duration), "sensor")
    assert found == {"sensor_a": [(5, 56, 57), (123, 174, 175)], "sensor_b": [(5, 76, 77), (133, 174, 175)]}
    scale = {r["sensor"]: r["signal_scale"] for r in mask.select("sensor", "signal_scale").distinct().collect()}
    assert scale["sensor_a"] == pytest.approx(4.625069, abs=1e-6) and scale["sensor_b"] == pytest.approx(1.395034, abs=1e-6)


def test_groups_and_rollup(spark):
    data = plateaus(spark)
    config = Config(steady_state=Steady(**{**CFG.__dict__, "groups": {"pair": ["SENSOR_B", "sensor_a", "ghost"], "all_sensors": ["*"], "nobody": ["ghost"]}}))
    t = steady_tables(data, config)
    assert t["groups"] == {"pair": ["sensor_b", "sensor_a"], "all_sensors": ["sensor_a", "sensor_b"]}
    both = [(5, 56, 57), (133, 174, 175)]
    assert spans(t["group_segments"], "group") == {"pair": both, "all_sensors": both}
    row = t["rollup"].where("sensor = 'sensor_b'").first()
    assert (row["n_steady_segments"], row["total_steady_duration_seconds"], row["longest_steady_start_seconds"], row["first_breakout_seconds"]) == (2, 112.0, 5.0, 77.0)
    tie = t["rollup"].where("sensor = 'sensor_a'").first()
    assert tie["longest_steady_start_seconds"] == 5.0  # of equals, the first


def test_sparse_short_and_odd_times(spark):
    rows = [("slow", i, 7.0 * i, 1.0) for i in range(40)] + [("few", i, float(i), 1.0) for i in range(2)]
    rows += [("twice", i, float(i // 2), float(i % 2)) for i in range(20)] + [("lost", 0, None, 1.0), ("lost", 1, 1.0, None)]
    data = spark.createDataFrame(rows, "sensor string, row_idx long, time double, value double")
    t = steady_tables(data, Config())
    roll = {r["sensor"]: r for r in t["rollup"].collect()}
    assert roll["slow"]["n_steady_segments"] == 0  # a window of 60 s never is full at 7 s steps
    assert (roll["few"]["n_samples"], roll["twice"]["n_samples"], roll["lost"]["n_samples"]) == (2, 10, 0)
    assert roll["few"]["total_steady_duration_seconds"] == 0.0
    assert Steady(min_steady_duration_seconds=0).duration == 60.0


def cubic(x):
    return 0.3 * x**3 - 2 * x**2 + x - 5


def test_dense_curves(spark):
    t = np.sort(np.random.default_rng(3).uniform(0, 10, 40))
    rows = [("p", i, float(x), float(cubic(x))) for i, x in enumerate(t)] + [("s", i, float(i), float(i)) for i in range(3)]
    data = spark.createDataFrame(rows, "sensor string, row_idx long, time double, value double")
    out = resample.characterize(data, "cubic_spline", 4).toPandas().sort_values(["sensor", "k"])
    p = out[out.sensor == "p"]
    assert len(p) == 160 and np.allclose(p.value, cubic(p.time), atol=1e-9) and np.allclose(p.time, np.linspace(t[0], t[-1], 160))
    s = out[out.sensor == "s"]
    assert set(s.method) == {"insufficient_points"} and list(s.value) == [0, 1, 2]
    lin = resample.characterize(data, "straight", 4).where("sensor = 'p'").toPandas().sort_values("k")
    assert np.allclose(lin.value, np.interp(lin.time, t, cubic(t))) and set(lin.method) == {"linear_interp_fallback"}


def test_spline_in_runs_agrees_with_the_whole(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(0.5, 1.5, 1500))
    v = rng.normal(size=1500)
    data = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))], "sensor string, row_idx long, time double, value double")
    got = resample.dense_cubic(data, 3, run=400).toPandas().sort_values("k")
    grid = np.linspace(t[0], t[-1], 4500)
    assert list(got.k) == list(range(4500))
    assert np.allclose(got.value, resample.spline_values(t, v, grid), atol=1e-9)


def test_sentences_of_too_few_samples(spark):
    rows = [("one", 0, 0.0, 1.0), ("one", 1, 1.0, 2.0), ("one", 2, 2.0, None), *[("same", k, float(k % 2), 1.0) for k in range(6)]]
    counts = {r["sensor"]: r.asDict() for r in steady.sample_counts(spark.createDataFrame(rows, "sensor string, row_idx long, time double, value double")).collect()}
    assert {s: (r["n_samples"], r["n_valid"]) for s, r in counts.items()} == {"one": (2, 2), "same": (2, 6)}
    assert {s: reports.sensor_text(r, 60.0) for s, r in counts.items()} == {"one": reports.FEW, "same": reports.FEW_TIMES}
