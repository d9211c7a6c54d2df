"""Queries over sources: a table is written out in a format, read back as a raw table, and held against SQL on the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import cache, files, sinks, streaming, synth
from tidewright.functions import number
from tidewright.operators import schema
from tidewright.plans.catalog import _SIGNALS, SQL as CATALOG_SQL, event_signals, events
from tidewright.sources import csv_rows, flattened, read_table, xlsx

TIME = "Elapsed Time [s]"
WAVES = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    path = f"{files.scratch_folder(spark)}/events.csv"
    events(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_events(spark, sf_dir):
    """All events through CSV files, whose cells are all strings."""
    raw = read_table(spark, _csv(spark, sf_dir))
    return raw.select(F.col("event_id").cast("long").alias("event_id"), "ts", "event_type", number("value").alias("value"), "props")


def csv_row_count(spark, sf_dir):
    """Rows of a CSV file by its lines: one for each event type, less the header's."""
    path = f"{files.scratch_folder(spark)}/types.csv"
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.option("header", True).csv(path)
    return spark.range(1).select(F.lit(csv_rows(spark, path)).cast("long").alias("n_rows"))


def csv_row_numbers(spark, sf_dir):
    """Row numbers of the raw table are 0, 1, ... without gaps or repeats."""
    raw = read_table(spark, _csv(spark, sf_dir))
    return raw.agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.sum("row_idx").alias("row_sum"))


def ndjson_events(spark, sf_dir):
    """All events through files of one nested object a line, whose keys are then dotted."""
    path = f"{files.scratch_folder(spark)}/events.ndjson"
    events(spark, sf_dir).select("event_id", F.struct("event_type", F.struct("value", "user_id").alias("of")).alias("what")).write.json(path)
    x = flattened(read_table(spark, path))
    return x.select("event_id", F.col("`what.event_type`").alias("event_type"), F.col("`what.of.value`").alias("value"), F.col("`what.of.user_id`").alias("user_id"))


def json_records(spark, sf_dir):
    """Suppliers through one JSON document with a list ``records`` of nested objects."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.struct("s_name", "s_nationkey").alias("of"), F.col("s_suppkey").alias("row_idx"))
    path = sinks.write_file(rows, f"{files.scratch_folder(spark)}/supplier.json", around=('{"records": ', "}"))
    x = read_table(spark, path)
    return x.select("s_suppkey", F.col("`of.s_name`").alias("s_name"), F.col("`of.s_nationkey`").alias("s_nationkey"))


def lvm_segments(spark, sf_dir):
    """Nations through an instrument's text file: a segment for each region, times rebuilt from its start and step."""
    lines = lambda *a: F.posexplode(F.array(*[F.lit(v) if isinstance(v, str) else v for v in a])).alias("at", "line")
    top = spark.range(1).select(F.lit(-1).alias("region"), lines("LabVIEW Measurement\t", "Separator\tTab", "Decimal_Separator\t.", "X_Columns\tNo", "***End_of_Header***\t", ""))
    nation = _table(spark, sf_dir, "nation")
    # Segments without rows are no segments.
    region = nation.select(F.col("n_regionkey").alias("region")).distinct()
    x0 = F.concat(F.lit("X0\t"), (F.col("region") * 10).cast("string"))
    heads = region.select("region", lines("Channels\t2", x0, "Delta_X\t0.5", "***End_of_Header***", "X_Value\tKey\tComment"))
    body = nation.select(F.col("n_regionkey").alias("region"), (F.col("n_nationkey") + 10).alias("at"), F.concat_ws("\t", F.lit(""), F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    path = f"{files.scratch_folder(spark)}/nation.lvm"
    top.union(heads).union(body).orderBy("region", "at").coalesce(1).select("line").write.text(path)
    x = read_table(spark, path)
    return x.select("row_idx", F.col("X_Value").alias("time"), F.col("Key").cast("long").alias("n_nationkey"), F.col("Comment").alias("n_name"))


def lvm_many_segments(spark, sf_dir):
    """Orders through an instrument's text in parts: a segment for each customer, decimal commas, rows that are too long and too short."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    lines = lambda *a: F.posexplode(F.array(*[F.lit(v) if isinstance(v, str) else v for v in a])).alias("at", "line")
    top = spark.range(1).select(F.lit(-1).cast("long").alias("cust"), lines("\ufeffLabVIEW Measurement\t", "Separator\tSemicolon", "Decimal_Separator\t,", "X_Columns\tNo", "***End_of_Header***\t", ""))
    x0 = F.concat(F.lit("X0\t"), F.col("cust").cast("string"), F.lit(",5"))
    heads = o.select(F.col("o_custkey").cast("long").alias("cust")).distinct().select("cust", lines("Channels\t3", x0, "Delta_X\t0,25", "***End_of_Header***", "X_Value\tKey\tPrice\tNote"))
    price = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    body = F.concat_ws("\t", F.lit(""), F.col("o_orderkey").cast("string"), price, F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws("\t", "o_orderstatus", "o_orderpriority")))
    rows = o.select(F.col("o_custkey").cast("long").alias("cust"), (F.col("o_orderkey") + 10).cast("long").alias("at"), body.alias("line"))
    path = f"{files.scratch_folder(spark)}/orders.lvm"
    # Parts in order, none of which holds the whole.
    top.union(heads).union(rows).orderBy("cust", "at").select("line").write.text(path)
    x = read_table(spark, path)
    return x.select("row_idx", F.col("X_Value").alias("time"), F.col("Key").cast("long").alias("o_orderkey"), F.col("Price").alias("price"), F.col("Note").alias("note"))


def _customer_book(spark: SparkSession, sf_dir: str) -> str:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.col("c_custkey").alias("row_idx"))
    return sinks.write_file(rows, f"{files.scratch_folder(spark)}/customer.xlsx", "Customers")


def xlsx_sheet(spark, sf_dir):
    """Customers through a workbook, made and read in tasks; some cells are missing."""
    x = read_table(spark, _customer_book(spark, sf_dir), "Customers")
    return x.select("row_idx", F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", number("c_acctbal").alias("c_acctbal"), "c_mktsegment")


def xlsx_preview(spark, sf_dir):
    """Shape, columns and first rows of a sheet."""
    got = xlsx.preview(spark, _customer_book(spark, sf_dir), None, 3)
    names = [r["c_name"] for r in got["sample_rows"]]
    return spark.createDataFrame([(got["sheet_name"], ",".join(got["columns"]), *got["shape"], ",".join(names))], "sheet_name string, columns string, n_rows long, n_columns long, first_names string")


def csv_file(spark, sf_dir):
    """Orders through one CSV file whose parts are written by tasks."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('say "'), "o_orderpriority", F.lit('", '), "o_orderstatus")).alias("note"), F.col("o_orderkey").alias("row_idx"))  # numbers with gaps: only their order counts
    x = read_table(spark, sinks.write_file(o, f"{files.scratch_folder(spark)}/orders.csv"))
    return x.select("row_idx", F.col("o_orderkey").cast("long").alias("o_orderkey"), number("o_totalprice").alias("o_totalprice"), "note")


def json_file(spark, sf_dir):
    """Customers through one JSON list whose parts are written by tasks."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_custkey").alias("row_idx"))
    x = read_table(spark, sinks.write_file(c, f"{files.scratch_folder(spark)}/customer.json"))
    return x.select("c_custkey", "c_name", "c_acctbal")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw table of strings with a time column and two columns of numbers."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("row_idx"), (F.col("event_id") * 0.25).cast("string").alias(TIME), F.col("value").cast("string").alias("Value A"), F.col("user_id").cast("string").alias("Users"), F.col("event_type").alias("Kind"))


def normalized_signals(spark, sf_dir):
    """Signals of a raw table whose time and sensor columns are inferred."""
    return schema.normalize(_raw(spark, sf_dir), "events")[0].select("sensor", "row_idx", "time", "value")


def schema_roles(spark, sf_dir):
    """What inference makes of each column of a raw table."""
    got = schema.infer_schema(_raw(spark, sf_dir))
    role = {got.time_column.original_name: "time"} | dict.fromkeys(got.sensor_columns, "sensor")
    return spark.createDataFrame([(h, n, role.get(h, "other")) for h, n in zip(got.original_headers, got.normalized_headers, strict=True)], "header string, normalized string, role string")


def sensor_columns(spark, sf_dir):
    """Columns of orders that are numbers in three quarters of all rows."""
    x = _table(spark, sf_dir, "orders")
    x = x.select(*[F.col(c).cast("string").alias(c) for c in x.columns])
    found = schema.infer_sensor_columns(x, "o_orderkey")
    return spark.createDataFrame([(c,) for c in found], "column_name string")


def synthetic_waves(spark, sf_dir):
    """Waves of three sensors without noise, as many rows as events."""
    n = events(spark, sf_dir).count()
    waves = [synth.sensor(spark, k, n, 7, 0.0, 0.0, 0.0, 0.0).select(F.lit(synth.header(k)).alias("sensor"), "row_idx", F.round("value", 6).alias("value")) for k in range(WAVES)]
    return waves[0].union(waves[1]).union(waves[2])


def synthetic_dropouts(spark, sf_dir):
    """How many values of a sensor's rows are gone: a fixed share."""
    n = events(spark, sf_dir).count()
    x = synth.sensor(spark, 0, n, 7, 0.0, 0.0, 0.0, 0.25)
    return x.agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_gone"))


def synthetic_spikes(spark, sf_dir):
    """How many rows of each sensor differ from the same sensor without spikes, by two shares of spikes."""
    n = events(spark, sf_dir).count()
    out = None
    for k, share in ((0, 0.002), (1, 0.03)):
        plain, spiky = (synth.sensor(spark, k, n, 7, 0.1, s, 0.0, 0.0) for s in (0.0, share))
        both = plain.join(spiky.withColumnRenamed("value", "with_spikes"), "row_idx")
        x = both.agg(F.lit(synth.header(k)).alias("sensor"), F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("value") - F.col("with_spikes")) > 1e-9).alias("n_spikes"))
        out = x if out is None else out.union(x)
    return out


def synthetic_flats(spark, sf_dir):
    """Whether rows that flat stretches changed hold the value of an earlier row, within the longest stretch."""
    n = events(spark, sf_dir).count()
    plain, flat = (synth.sensor(spark, 2, n, 7, 0.1, 0.0, f, 0.0) for f in (0.0, 0.01))
    both = plain.join(flat.withColumnRenamed("value", "held"), "row_idx")
    changed = both.where("value <> held").select("row_idx", "held")
    source = plain.select(F.col("row_idx").alias("start"), F.col("value").alias("held"))
    found = changed.join(source, "held").where("start < row_idx").groupBy("row_idx").agg(F.max(F.col("row_idx") - F.col("start")).alias("off"))
    n_changed = changed.agg(F.count("*").alias("c"))
    return found.agg(F.count("*").alias("n"), F.max("off").alias("off")).crossJoin(n_changed).select(
        F.lit(n).cast("long").alias("n_rows"), (F.col("n") == F.col("c")).alias("all_held"), (F.col("off") < synth.FLAT_LONGEST[1]).alias("short"), (F.col("c") > 0).alias("some"))


def synthetic_columns(spark, sf_dir):
    """Time and junk columns of a table with irregular headers, all rows."""
    n = events(spark, sf_dir).count()
    x = synth.table(spark, n, 2, 0.0, 7, 0.0, "datetime", "irregular", True)
    seconds = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'2026-01-01 00:00:00'"), F.col("Timestamp"))
    return x.select("row_idx", seconds.alias("second"), F.col("Operator Notes").alias("notes"), F.col("Batch ID").alias("batch"), F.col("QC Flag").alias("qc"), F.lit(",".join(x.columns[2:4])).alias("headers"))


def spike_flags_stream(spark, sf_dir):
    """Spikes of events that arrive in three chunks of time, each a micro-batch, and then end."""
    folder = files.scratch_folder(spark)
    e = events(spark, sf_dir).select(F.col("event_type").alias("sensor"), "ts", "value", F.col("event_id").alias("ord"))
    ends = e.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    third = F.least(F.floor(F.timestamp_diff("SECOND", F.col("t0"), F.col("ts")) * 3 / (F.timestamp_diff("SECOND", F.col("t0"), F.col("t1")) + 1)), F.lit(2))
    chunks = [e.crossJoin(F.broadcast(ends)).where(third == k).select(*e.columns) for k in range(3)]
    chunks.append(e.select("sensor").distinct().select("sensor", F.lit(None).cast(e.schema["ts"].dataType).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("ord")))
    for chunk in chunks:
        chunk.write.mode("append").parquet(f"{folder}/in")
        streaming.run_batch(spark, f"{folder}/in", e.schema, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").where("flag").select("sensor", "row_idx", "time", "value")


def cache_round_trip(spark, sf_dir):
    """Signals of events through a cache by sensor."""
    return cache.load_cache(spark, cache.write_cache(event_signals(spark, sf_dir), files.scratch_folder(spark))).select("sensor", "row_idx", "time", "value")


def cache_chosen(spark, sf_dir):
    """The same, of two sensors."""
    path = cache.write_cache(event_signals(spark, sf_dir), files.scratch_folder(spark), "float32")
    return cache.load_cache(spark, path, ["click", "view"]).select("sensor", "row_idx")


QUERIES = {f.__name__: f for f in (
    csv_events, csv_row_count, csv_row_numbers, ndjson_events, json_records, lvm_segments, lvm_many_segments, xlsx_sheet, xlsx_preview, csv_file, json_file, normalized_signals, schema_roles, sensor_columns,
    synthetic_waves, synthetic_dropouts, synthetic_spikes, synthetic_flats, synthetic_columns, spike_flags_stream, cache_round_trip, cache_chosen)}

_NUMBERS = "VALUES " + ", ".join(
    f"('{c}', (SELECT avg((try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL)::INT) FROM orders))" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
_WAVE = " UNION ALL ".join(
    f"SELECT 'Sensor_{k + 1}' AS sensor, i AS row_idx, round({1 + 0.15 * k} * sin(a * 12 * pi() * ({0.6 + 0.07 * k} / (2 * pi())) + {0.5 * k}) + 0.35 * cos(a * 12 * pi() * {0.18 + 0.01 * k} + {0.3 * k}) + a * {0.5 + 0.05 * k}, 6) AS value FROM rows"
    for k in range(WAVES))

SQL = {
    "csv_events": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value, props FROM events",
    "csv_row_count": "SELECT count(DISTINCT event_type) AS n_rows FROM events",
    "csv_row_numbers": "SELECT count(*) AS n, 0::BIGINT AS first_row, count(*) - 1 AS last_row, (count(*) * (count(*) - 1) // 2)::BIGINT AS row_sum FROM events",
    "ndjson_events": "SELECT event_id, event_type, value, user_id FROM events",
    "json_records": "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier",
    "lvm_segments": """SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS row_idx, (n_regionkey * 10 + 0.5 * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1))::DOUBLE AS time,
        n_nationkey::BIGINT AS n_nationkey, n_name FROM nation""",
    "lvm_many_segments": """SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_idx, (o_custkey + 0.5 + 0.25 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1))::DOUBLE AS time,
        o_orderkey::BIGINT AS o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || ';' || o_orderpriority END AS note FROM orders""",
    "xlsx_sheet": """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""",
    "xlsx_preview": """SELECT 'Customers' AS sheet_name, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, (SELECT count(*) FROM customer) AS n_rows, 5::BIGINT AS n_columns,
        string_agg(c_name, ',' ORDER BY c_custkey) AS first_names FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)""",
    "csv_file": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey::BIGINT AS o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN 'say "' || o_orderpriority || '", ' || o_orderstatus END AS note FROM orders""",
    "json_file": "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal FROM customer",
    "normalized_signals": """SELECT 'Value A' AS sensor, event_id AS row_idx, (event_id * 0.25)::DOUBLE AS time, value FROM events
        UNION ALL SELECT 'Users', event_id, (event_id * 0.25)::DOUBLE, user_id::DOUBLE FROM events""",
    "schema_roles": """SELECT * FROM (VALUES ('Elapsed Time [s]', 'elapsed_time_s', 'time'), ('Value A', 'value_a', (SELECT CASE WHEN avg((value IS NOT NULL)::INT) >= 0.75 THEN 'sensor' ELSE 'other' END FROM events)),
        ('Users', 'users', (SELECT CASE WHEN avg((user_id IS NOT NULL)::INT) >= 0.75 THEN 'sensor' ELSE 'other' END FROM events)),
        ('Kind', 'kind', (SELECT CASE WHEN avg((try_cast(event_type AS DOUBLE) IS NOT NULL)::INT) >= 0.75 THEN 'sensor' ELSE 'other' END FROM events))) AS t(header, normalized, role)""",
    "sensor_columns": f"SELECT column_name FROM ({_NUMBERS}) AS t(column_name, share) WHERE share >= 0.75",
    "synthetic_waves": f"WITH rows AS (SELECT i, i / greatest((SELECT count(*) FROM events) - 1, 1)::DOUBLE AS a FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i)) {_WAVE}",
    "synthetic_spikes": """SELECT * FROM (SELECT 'Sensor_1' AS sensor, count(*) AS n_rows, floor(count(*) * 0.002::DOUBLE)::BIGINT AS n_spikes FROM events
        UNION ALL SELECT 'Sensor_2', count(*), floor(count(*) * 0.03::DOUBLE)::BIGINT FROM events)""",
    "synthetic_flats": "SELECT count(*) AS n_rows, true AS all_held, true AS short, true AS some FROM events",
    "synthetic_columns": """SELECT i AS row_idx, i AS second, CASE WHEN i % 97 = 0 THEN 'check sensor bank' ELSE 'ok' END AS notes, 'run-7' AS batch, CASE WHEN i % 211 = 0 THEN 'WARN' ELSE 'PASS' END AS qc,
        'TC-01 Temp (C),flow sensor 2' AS headers FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i)""",
    "synthetic_dropouts": "SELECT count(*) AS n_rows, floor(count(*) * 0.25)::BIGINT AS n_gone FROM events",
    "spike_flags_stream": CATALOG_SQL["spike_flags"],
    "cache_round_trip": f"WITH {_SIGNALS} SELECT sensor, row_idx, time, value FROM signals",
    "cache_chosen": f"WITH {_SIGNALS} SELECT sensor, row_idx FROM signals WHERE sensor IN ('click', 'view')",
}
