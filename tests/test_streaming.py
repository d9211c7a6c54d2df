"""Flags of a growing table against flags of the whole one."""

import random

import numpy as np
import pytest

from tidewright import streaming
from tidewright.operators import spikes

SCHEMA = "sensor string, ts timestamp_ntz, value double, ord long"


def events(n=120):
    r = random.Random(6)
    out = []
    for s in "ab":
        for k in range(n if s == "a" else 7):
            v = None if r.random() < 0.1 else r.choice([0.0, r.gauss(0, 1), 30.0 * (r.random() < 0.1)])
            out.append((s, k // 2, v, k))
    return out


def chunk(spark, rows):
    return spark.createDataFrame([(s, None if t is None else np.datetime64("2026-01-01T00:00:00").astype("datetime64[s]").item().replace(minute=t // 60, second=t % 60), v, o) for s, t, v, o in rows], SCHEMA)


@pytest.mark.parametrize("cuts", [[120], [3, 4, 60, 61]])
def test_chunks_give_the_flags_of_the_whole(spark, tmp_path, cuts):
    rows = events()
    signals = spark.createDataFrame([(s, o, float(t), v) for s, t, v, o in rows], "sensor string, row_idx long, time double, value double")
    want = sorted((r["sensor"], r["row_idx"], r["time"], r["value"], r["near"], r["flag"]) for r in spikes.flag_spikes(signals, 4, 2.0, 20.0).collect())
    ends = [0, *cuts, 10_000]
    for a, b in zip(ends, ends[1:]):  # noqa: B905
        part = [q for q in rows if a <= q[3] < b]
        if part:
            chunk(spark, part[::-1]).write.mode("append").parquet(f"{tmp_path}/in")
            streaming.run_batch(spark, f"{tmp_path}/in", chunk(spark, rows).schema, f"{tmp_path}/out", f"{tmp_path}/state", window_radius=4, z_threshold=2.0, absolute_jump_threshold=20.0)
    key = lambda r: (r["sensor"], r["row_idx"], r["time"], r["value"], r["near"], r["flag"])
    waiting = sorted(key(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    sizes = {"a": 120, "b": 7}
    assert waiting == [w for w in want if w[1] < sizes[w[0]] - 4]  # the last rows wait for what may come
    chunk(spark, [("a", None, None, None), ("b", None, None, None)]).write.mode("append").parquet(f"{tmp_path}/in")
    streaming.run_batch(spark, f"{tmp_path}/in", chunk(spark, rows).schema, f"{tmp_path}/out", f"{tmp_path}/state", window_radius=4, z_threshold=2.0, absolute_jump_threshold=20.0)
    got = sorted(key(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == want and sum(w[5] for w in want) > 3
