import random

import numpy as np
import pytest

from tidewright.config import Cleaning
from tidewright.operators import spikes

SCHEMA = "sensor string, row_idx long, time double, value double"


def table(spark, **sensors):
    return spark.createDataFrame([(s, i, float(i), v) for s, vs in sensors.items() for i, v in enumerate(vs)], SCHEMA)


def column(df, name, sensor="s"):
    return [r[name] for r in df.where(f"sensor = '{sensor}'").orderBy("row_idx").collect()]


def spec_flags(values, w, z, jump):
    """Straight from the definition: neighbours without the row itself, sample deviation."""
    out = []
    for i, v in enumerate(values):
        near = [x for j, x in enumerate(values) if j != i and abs(j - i) <= w and x is not None]
        if v is None or len(near) < 2:
            out.append(False)
            continue
        m, s = np.mean(near), np.std(near, ddof=1)
        out.append(bool((s > 0 and abs(v - m) > z * s) or (jump > 0 and abs(v - m) > jump)))
    return out


def spec_repair(values, flags, strategy, w, limit=None):
    a = list(values)
    for i in [i for i, f in enumerate(flags) if f]:
        if strategy == "nearest":
            order = sorted((j for j in range(len(a)) if j != i and a[j] is not None), key=lambda j: (abs(j - i), j))
            a[i] = a[order[0]]
        else:
            near = [a[j] for j in range(max(0, i - w), min(len(a), i + w + 1)) if j != i and a[j] is not None]
            a[i] = float(np.mean(near))
            if strategy == "clip" and limit is not None:
                a[i] = min(max(a[i], -limit), limit)
    return a


def spec_fill(a):
    known = [i for i, v in enumerate(a) if v is not None]
    return [0.0] * len(a) if not known else [float(x) for x in np.interp(range(len(a)), known, [a[i] for i in known])]


def noisy(seed, n=300):
    r = random.Random(seed)
    out = [r.gauss(0, 1) for _ in range(n)]
    for _ in range(n // 12):
        i = r.randrange(n)
        out[i] = r.choice([25.0, -25.0, 40.0, None])
        if r.random() < 0.5 and i + 1 < n:
            out[i + 1] = r.choice([-30.0, 30.0, None])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket", [None, 37])
def test_flags_and_repairs_follow_the_definition(spark, seed, bucket):
    values = noisy(seed)
    df = spikes.flag_spikes(table(spark, s=values, t=noisy(seed + 10)), z_threshold=2.0, bucket_rows=bucket)
    flags = spec_flags(values, 5, 2.0, 0.0)
    assert column(df, "flag") == flags and sum(flags) > 5
    for strategy, limit in (("local_mean", None), ("nearest", None), ("clip", 0.2), ("drop", None)):
        got = column(spikes.repair(df, strategy, clip_max=limit, bucket_rows=bucket), "repaired")
        want = [None if f else v for v, f in zip(values, flags)] if strategy == "drop" else spec_repair(values, flags, strategy, 5, limit)
        assert [g is None for g in got] == [x is None for x in want]
        assert np.allclose([g for g in got if g is not None], [x for x in want if x is not None])
        filled = column(spikes.fill_missing(spikes.repair(df, strategy, clip_max=limit), "repaired", bucket_rows=bucket), "filled")
        assert np.allclose(filled, spec_fill(want))


def test_edges_of_flagging(spark):
    df = spikes.flag_spikes(table(spark, flat=[10.0] * 5 + [13.6] + [10.0] * 6, twins=[0.0] * 6 + [1.0, -1.0] + [0.0] * 6, pair=[1.0, 9.0], one=[None, 5.0, None]), absolute_jump_threshold=0.0)
    assert not any(column(df, "flag", "flat"))  # no deviation around it
    assert column(df, "flag", "twins").count(True) == 2
    assert not any(column(df, "flag", "pair")) and not any(column(df, "flag", "one"))
    jump = spikes.flag_spikes(table(spark, flat=[10.0] * 5 + [13.6] + [10.0] * 6), absolute_jump_threshold=3.0)
    assert column(jump, "flag", "flat") == [i == 5 for i in range(12)]


def test_filling(spark):
    n = None
    df = table(spark, gap=[n, 1.0, n, n, 4.0, n], none=[n, n, n], one=[n, 7.0, n])
    for bucket in (None, 2):
        x = spikes.fill_missing(df, bucket_rows=bucket)
        assert column(x, "filled", "gap") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
        assert column(x, "filled", "none") == [0.0] * 3 and column(x, "filled", "one") == [7.0] * 3


def test_clean_and_stats_of_the_example(spark):
    """A plateau with one spike amid noise of 0.1: repaired to the neighbours' mean."""
    b = [20.0, 20.1, 19.9, 20.0, 23.2, 20.0, 20.1, 19.9, 20.0, 20.0]
    out = spikes.clean(table(spark, s=b))
    assert column(out, "flag") == [i == 4 for i in range(10)]
    assert column(out, "cleaned")[4] == pytest.approx(np.mean([v for i, v in enumerate(b) if i != 4]))
    stats = spikes.cleaning_stats(out).first()
    assert (stats["n_points"], stats["n_flagged"]) == (10, 1)
    assert stats["std_original"] == pytest.approx(np.std(b))
    kept = spikes.clean(table(spark, s=[1.0, None, 3.0]), Cleaning(nan_policy="keep"))
    assert column(kept, "cleaned") == [1.0, None, 3.0]


def test_unknown_strategy_and_empty_input(spark):
    df = spikes.flag_spikes(table(spark))
    with pytest.raises(ValueError):
        spikes.repair(df, "guess")
    assert spikes.clean(table(spark)).count() == 0 and spikes.cleaning_stats(spikes.clean(table(spark))).count() == 0


def test_parallel_local_mean(spark):
    v = [0.0, 0.0, 9.0, 9.0, 0.0, 0.0, 0.0, 1.0]
    df = spikes.flag_spikes(table(spark, s=v), window_radius=3, z_threshold=1.0)
    got = column(spikes.local_mean_parallel(df, 3), "repaired")
    flags = spec_flags(v, 3, 1.0, 0.0)
    for i, f in enumerate(flags):
        near = [v[j] for j in range(max(0, i - 3), min(8, i + 4)) if j != i]
        assert got[i] == pytest.approx(np.mean(near) if f else v[i])
