"""Synthetic sensor tables: sums of waves, drift and noise, with spikes, flat stretches and dropouts.

Draws are by hash of seed, sensor and row, so rows can be made anywhere and again; counts follow the
fractions, values are this engine's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import files, sinks

#: Headers of the irregular style, in turn.
IRREGULAR = ("TC-{0:02d} Temp (C)", "flow sensor {0}", "Pressure.Channel.{0}", "sensor {0} reading")

#: Flat stretches number this many times their share of the rows, from the first of these counts to the second.
FLATS_TIMES, FLATS_COUNT = 10, (1, 10)
#: A flat stretch has at least so many rows, and at most one in so many of all, within these bounds.
FLAT_SHORTEST, FLAT_PART, FLAT_LONGEST = 3, 50, (4, 200)


def header(k: int, style: str = "standard") -> str:
    if style == "standard":
        return f"Sensor_{k + 1}"
    if style == "irregular":
        return IRREGULAR[k % len(IRREGULAR)].format(k + 1)
    raise ValueError(f"Unsupported header_style={style}")


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / float(1 << 53)


def _normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(_uniform(*parts, F.lit(1)))) * F.cos(2 * math.pi * _uniform(*parts, F.lit(2)))


def _chosen(rows: DataFrame, n: int, *parts) -> DataFrame:
    """n rows: those with the smallest hashes."""
    return rows.select("row_idx", F.xxhash64(*parts, "row_idx").alias("h")).orderBy("h", "row_idx").limit(n).select("row_idx")


def sensor(spark: SparkSession, k: int, n_rows: int, seed: int, noise: float, spikes: float, flats: float, dropouts: float) -> DataFrame:
    """(row_idx, value) of one sensor."""
    rows = spark.range(n_rows).withColumnRenamed("id", "row_idx")
    key = (F.lit(seed), F.lit(k), F.col("row_idx"))
    at = F.col("row_idx") / float(max(n_rows - 1, 1))
    base = at * (12 * math.pi)
    value = ((1 + 0.15 * k) * F.sin(base * ((0.6 + 0.07 * k) / (2 * math.pi)) + 0.5 * k) + 0.35 * F.cos(base * (0.18 + 0.01 * k) + 0.3 * k)
             + at * (0.5 + 0.05 * k) + noise * _normal(*key, F.lit("noise")))
    x = rows.withColumn("value", value)
    if n := int(n_rows * spikes):
        hit = _chosen(rows, n, F.lit(seed), F.lit(k), F.lit("spike")).withColumn("hit", F.lit(True))
        x = x.join(hit, "row_idx", "left").withColumn("value", F.col("value") + F.when(F.col("hit"), max(6.0, 20 * noise) * _normal(*key, F.lit("size"))).otherwise(0.0)).drop("hit")
    if flats > 0 and n_rows:
        count = sorted((*FLATS_COUNT, int(n_rows * flats * FLATS_TIMES)))[1]
        longest = sorted((*FLAT_LONGEST, n_rows // FLAT_PART + 1))[1]
        starts = spark.range(count).select(
            F.floor(_uniform(F.lit(seed), F.lit(k), F.lit("flat"), "id") * max(n_rows - 2, 1)).alias("start"), (FLAT_SHORTEST + F.floor(_uniform(F.lit(seed), F.lit(k), F.lit("length"), "id") * (longest - FLAT_SHORTEST))).alias("length"))
        inside = starts.select("start", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + F.col("length"), F.lit(n_rows)) - 1)).alias("row_idx")).groupBy("row_idx").agg(F.min("start").alias("start"))
        held = x.join(starts.select("start").distinct(), x.row_idx == F.col("start"), "left_semi").select(F.col("row_idx").alias("start"), F.col("value").alias("held"))
        x = x.join(inside.join(held, "start").select("row_idx", "held"), "row_idx", "left").withColumn("value", F.coalesce("held", "value")).drop("held")
    if n := int(n_rows * dropouts):
        gone = _chosen(rows, n, F.lit(seed), F.lit(k), F.lit("drop")).withColumn("gone", F.lit(True))
        x = x.join(gone, "row_idx", "left").withColumn("value", F.when(F.col("gone").isNull(), F.col("value"))).drop("gone")
    return x


def table(
    spark: SparkSession, n_rows: int = 200_000, n_sensors: int = 8, spike_fraction: float = 0.002, seed: int = 1234, noise_sigma: float = 0.1, time_mode: str = "numeric",
    header_style: str = "standard", include_junk_columns: bool = False, flat_fraction: float = 0.0, dropout_fraction: float = 0.0,
) -> DataFrame:
    """A wide table with row_idx, a time column unless indexless, the sensors, and junk columns if asked for."""
    if time_mode not in ("numeric", "datetime", "indexless"):
        raise ValueError(f"Unsupported time_mode={time_mode}")
    long = None
    for k in range(n_sensors):
        x = sensor(spark, k, n_rows, seed, noise_sigma, spike_fraction, flat_fraction, dropout_fraction).withColumn("sensor", F.lit(k))
        long = x if long is None else long.union(x)
    wide = spark.range(n_rows).withColumnRenamed("id", "row_idx") if long is None else long.groupBy("row_idx").pivot("sensor", list(range(n_sensors))).agg(F.first("value"))
    cols = [F.col("row_idx")]
    if time_mode == "numeric":
        cols.append(F.col("row_idx").cast("double").alias("Time"))
    elif time_mode == "datetime":
        cols.append(F.timestamp_add("SECOND", F.col("row_idx"), F.expr("timestamp_ntz'2026-01-01 00:00:00'")).alias("Timestamp"))
    cols += [F.col(f"`{k}`").alias(header(k, header_style)) for k in range(n_sensors)]
    if include_junk_columns:
        cols += [F.when(F.col("row_idx") % 97 == 0, "check sensor bank").otherwise("ok").alias("Operator Notes"), F.lit(f"run-{seed}").alias("Batch ID"),
                 F.when(F.col("row_idx") % 211 == 0, "WARN").otherwise("PASS").alias("QC Flag")]
    return wide.select(*cols)


def write(df: DataFrame, path: str, fmt: str) -> str:
    """Rows in order: csv and ndjson as a folder of parts, json as one list and xlsx as one sheet in a file."""
    if fmt in ("json", "xlsx"):
        return sinks.write_file(df, path)
    x = df.orderBy("row_idx").drop("row_idx")
    if fmt == "csv":
        x.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "ndjson":
        x.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"Unsupported synthetic output format: {fmt}")
    return path


def campaign(spark: SparkSession, out_dir: str, name: str, row_counts: list[int], num_sensors: int, noise_sigma: float, spike_fraction: float, seed_base: int, formats: tuple[str, ...] = ("csv",), dry_run: bool = False, **more) -> dict:
    """Tables of several sizes and formats with a manifest and a summary; a dry run only plans them."""
    rows = []
    for k, n in enumerate(row_counts):
        for fmt in formats:
            base = f"{name}_rows_{n}_sensors_{num_sensors}_seed_{seed_base + k}"
            meta = {"dataset_name": base, "path": f"{out_dir}/datasets/{base}.{fmt}", "format": fmt, "n_rows": n, "n_sensors": num_sensors, "seed": seed_base + k, "noise_sigma": noise_sigma, "spike_fraction": spike_fraction, **more}
            if not dry_run:
                write(table(spark, n, num_sensors, spike_fraction, seed_base + k, noise_sigma, **more), meta["path"], fmt)
            rows.append(meta)
    manifest = {"campaign_name": name, "out_dir": out_dir, "row_counts": row_counts, "num_sensors": num_sensors, "seed_base": seed_base, "formats": list(formats), "dry_run": dry_run, "datasets": rows}
    out = {"campaign_manifest_json": f"{out_dir}/campaign_manifest.json", "campaign_summary_csv": f"{out_dir}/campaign_summary.csv"}
    if not dry_run:
        files.write_json(spark, out["campaign_manifest_json"], manifest)
        files.write_csv(spark, out["campaign_summary_csv"], rows)
    return out | {"datasets": rows, "dry_run": dry_run}
