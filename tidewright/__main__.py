"""Command line: inspect, cache-build, clean, characterize, synth, workflow, weak-scaling. Prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewright import cache, files, reports, studies, synth, workflow
from tidewright.config import Config, load_config
from tidewright.operators import resample


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("inspect")
    a.add_argument("inputs", nargs="+")
    a = sub.add_parser("cache-build")
    a.add_argument("input")
    a.add_argument("--sheet-name")
    a = sub.add_parser("clean")
    a.add_argument("--cache-dir", required=True)
    a.add_argument("--mode", choices=["serial", "replicated", "partitioned"], default="serial")
    a.add_argument("--characterize", action="store_true")
    a.add_argument("--steady-window-seconds", type=float)
    a = sub.add_parser("characterize")
    a.add_argument("--cache-dir", required=True)
    a.add_argument("--steady-window-seconds", type=float)
    a = sub.add_parser("synth")
    a.add_argument("--out", required=True)
    for name, kind, default in (("rows", int, 200_000), ("sensors", int, 8), ("spike-fraction", float, 0.002), ("seed", int, 1234), ("noise-sigma", float, 0.1), ("flat-fraction", float, 0.0), ("dropout-fraction", float, 0.0)):
        a.add_argument(f"--{name}", type=kind, default=default)
    a.add_argument("--time-mode", default="numeric")
    a.add_argument("--header-style", default="standard")
    a.add_argument("--include-junk-columns", action="store_true")
    a.add_argument("--format", default="csv")
    a = sub.add_parser("workflow")
    a.add_argument("input", nargs="?")
    a.add_argument("--cache-dir")
    a.add_argument("--sheet-name")
    a.add_argument("--modes", nargs="+")
    a.add_argument("--characterize", action="store_true")
    a.add_argument("--skip-inspect", action="store_true")
    a.add_argument("--skip-clean-runs", action="store_true")
    a.add_argument("--process-counts", nargs="+", type=int)
    a.add_argument("--repeat", type=int)
    timed = a.add_mutually_exclusive_group()
    timed.add_argument("--benchmark", dest="benchmark", action="store_true", default=None)
    timed.add_argument("--skip-benchmark", dest="benchmark", action="store_false")
    a.add_argument("--steady-window-seconds", type=float)
    a = sub.add_parser("weak-scaling")
    a.add_argument("--out", required=True)
    a.add_argument("--rows-per-rank", type=int, required=True)
    a.add_argument("--process-counts", nargs="+", type=int, required=True)
    a.add_argument("--modes", nargs="+", choices=["serial", "replicated", "partitioned"], default=["serial", "replicated", "partitioned"])
    a.add_argument("--sensors", type=int, default=8)
    a.add_argument("--repeat", type=int, default=3)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = load_config(args.config).with_window(getattr(args, "steady_window_seconds", None))
    session = cache.new_session(config.analysis_dir)
    if args.command not in ("cache-build", "clean", "characterize", "workflow"):  # these write nothing there
        out = run(spark, args, config, session)
    else:
        files.describe_session(spark, session, args.command, sys.argv[1:] if argv is None else argv)
        with files.session_log(spark, session):
            out = run(spark, args, config, session)
    print(json.dumps(out, indent=2, default=str))
    return out


def run(spark: SparkSession, args: argparse.Namespace, config: Config, session: str) -> dict:
    """What a command does; its results, or where they are."""
    if args.command == "inspect":
        out = {"files": [workflow.inspect(spark, p, config) for p in args.inputs]}
    elif args.command == "cache-build":
        out = cache.build_cache(spark, args.input, session, config, args.sheet_name)
    elif args.command == "clean":
        out = workflow.run_clean(spark, args.cache_dir, f"{session}/outputs", config, args.mode, args.characterize)
    elif args.command == "characterize":
        data, folder, c = cache.load_cache(spark, args.cache_dir), f"{session}/outputs", config.characterization
        t = workflow.steady_tables(data, config)
        out = {"characterization": reports.write_curves(resample.characterize(data, c.method, c.dense_factor), folder)}
        out |= reports.write_steady(spark, folder, t["rollup"], t["segments"], t["limits"], config.steady_state.duration, t.get("group_rollup"), t.get("group_segments"), t.get("groups")) or {}
    elif args.command == "synth":
        df = synth.table(spark, args.rows, args.sensors, args.spike_fraction, args.seed, args.noise_sigma, args.time_mode, args.header_style, args.include_junk_columns, args.flat_fraction, args.dropout_fraction)
        out = {"path": synth.write(df, args.out, args.format)}
    elif args.command == "weak-scaling":
        out = studies.write_weak_study(spark, studies.weak_study(spark, args.out, args.rows_per_rank, args.process_counts, config, args.modes, args.repeat, args.sensors), args.out)
    else:
        out = workflow.run_workflow(
            spark, args.input, config, args.cache_dir, args.sheet_name, tuple(args.modes) if args.modes else None, args.characterize, not args.skip_inspect,
            not args.skip_clean_runs, args.benchmark, tuple(args.process_counts) if args.process_counts else None, args.repeat, session)
    return out


if __name__ == "__main__":
    main()
