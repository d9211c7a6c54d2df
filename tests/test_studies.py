"""Scaling studies, their files and switches, and the log of a session."""

import csv
import json

import pytest

from tidewright import studies
from tidewright.__main__ import main
from tidewright.config import Config
from tidewright.operators import scaling


def settings(tmp_path, **more):
    (tmp_path / "c.json").write_text(json.dumps({"analysis_dir": str(tmp_path / "analysis")} | more))
    (tmp_path / "in.csv").write_text("Time,A,B\n" + "\n".join(f"{k},{k * 2},{k % 7}" for k in range(60)))
    return ["--config", str(tmp_path / "c.json")]


def test_points():
    assert studies.points_of(["partitioned", "serial"], [4, 2, 4]) == [("serial", 1), ("partitioned", 2), ("partitioned", 4)]
    assert studies.points_of([], [1]) == [] and studies.points_of(["replicated"], []) == []
    for modes, counts in ((["other"], [1]), (["serial"], [0])):
        with pytest.raises(ValueError):
            studies.points_of(modes, counts)


def test_settings_of_studies():
    c = Config.of({"benchmark": {"enabled_by_default": True, "repeat": 2, "process_counts": [1, 3]}})
    assert (c.benchmark, c.repeat, c.process_counts) == (True, 2, (1, 3))
    assert (c.with_window(30.0).benchmark, c.with_window(30.0).repeat, c.with_window(30.0).process_counts) == (True, 2, (1, 3))
    assert (Config().benchmark, Config.of({}).repeat, Config.of({}).process_counts) == (False, 3, (1, 2, 4, 8))


def test_shares_of_ranks(spark):
    signals = spark.createDataFrame([(s, k) for s, n in (("a", 10), ("b", 4), ("c", 7)) for k in range(n)], "sensor string, row_idx long")
    held = scaling.loads(signals, [("serial", 1), ("replicated", 2), ("partitioned", 2)], 1)
    got = {(r["mode"], r["nproc"]): r for r in scaling.work_shares(held).collect()}
    assert {k: (r["ranks"], r["min_n_rows"], r["max_n_rows"], r["mean_n_rows"]) for k, r in got.items()} == {("serial", 1): (1, 21, 21, 21.0), ("replicated", 2): (2, 4, 17, 10.5), ("partitioned", 2): (2, 10, 11, 10.5)}
    assert got["partitioned", 2]["mean_n_halo"] == 3.0 and got["serial", 1]["mean_n_halo"] == 0.0
    assert scaling.work_shares(scaling.loads(signals.limit(0), [("serial", 1)], 1)).count() == 0


def test_workflow_with_benchmark(spark, tmp_path, capsys):
    out = main([*settings(tmp_path), "workflow", str(tmp_path / "in.csv"), "--skip-inspect", "--skip-clean-runs", "--benchmark", "--process-counts", "1", "2", "--repeat", "2", "--modes", "serial", "partitioned"])
    assert out["runs"] == [] and "inspect" not in out
    summary = json.loads((tmp_path / out["benchmark"]["benchmark_summary_json"]).read_text())["summary"]
    assert [(r["mode"], r["nproc"], r["repeat"]) for r in summary] == [("serial", 1, 2), ("partitioned", 1, 2), ("partitioned", 2, 2)]
    assert summary[0]["speedup_vs_serial"] == 1.0 and all(r["max_elapsed_sec"] >= r["elapsed_sec"] > 0 for r in summary)
    with open(out["benchmark"]["parallel_metrics_summary_csv"]) as f:
        assert [(r["mode"], r["nproc"], r["ranks"], r["max_n_rows"]) for r in csv.DictReader(f)] == [("serial", "1", "1", "120"), ("partitioned", "1", "1", "120"), ("partitioned", "2", "2", "60")]
    with open(out["benchmark"]["timing_breakdown_summary_csv"]) as f:
        assert all(float(r["max_compute_elapsed_sec"]) >= float(r["mean_compute_elapsed_sec"]) > 0 for r in csv.DictReader(f))
    manifest = json.loads((tmp_path / out["benchmark"]["manifest_json"]).read_text())
    assert manifest["process_counts"] == [1, 2] and manifest["repeat"] == 2 and manifest["has_timing_breakdown"] and manifest["has_parallel_metrics"]
    (log,) = (tmp_path / "analysis").glob("*/logs/session.log")
    assert out["session_dir"] in str(log) and log.read_text().rstrip().endswith("done")


def test_failures_are_logged(spark, tmp_path):
    with pytest.raises(ValueError):
        main([*settings(tmp_path), "workflow", "--skip-benchmark"])
    (log,) = (tmp_path / "analysis").glob("*/logs/session.log")
    assert "ValueError: workflow needs an input file or a cache" in log.read_text()


def test_weak_scaling(spark, tmp_path, capsys):
    out = main([*settings(tmp_path), "weak-scaling", "--out", str(tmp_path / "weak"), "--rows-per-rank", "50", "--process-counts", "2", "1", "--modes", "partitioned", "--sensors", "2", "--repeat", "1"])
    rows = json.loads((tmp_path / out["weak_scaling_summary_json"]).read_text())["summary"]
    assert [(r["mode"], r["nproc"], r["rows_per_rank"], r["total_rows"]) for r in rows] == [("partitioned", 1, 50, 50), ("partitioned", 2, 50, 100)]
    assert rows[0]["weak_scaling_efficiency"] == 1.0 and rows[1]["normalized_elapsed"] > 0
    assert json.loads((tmp_path / out["manifest_json"]).read_text()) == {"process_counts": [1, 2], "rows_per_rank": 50, "modes": ["partitioned"]}
