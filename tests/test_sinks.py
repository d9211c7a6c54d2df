"""Files whose parts tasks write, against what other readers make of them, and instrument text in parts."""

import csv
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidewright import sinks, synth
from tidewright.sources import lvm, read_table, xlsx

ODD = ['plain', 'a "quoted" one', 'comma, here', '<b>&amp;</b>', ' spaces ', None, 'é漢😀', 'x\x01y', "it's"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(3 * k, k * 0.5 if k % 4 else None, ODD[k % len(ODD)], k) for k in range(60)]
    return data, spark.createDataFrame(data, "row_idx long, `a.b` double, text string, n int").repartition(5)


def test_csv_and_json_files(spark, rows, tmp_path):
    data, df = rows
    sinks.write_file(df, f"{tmp_path}/a.csv")
    got = list(csv.reader(open(f"{tmp_path}/a.csv", encoding="utf-8", newline="")))
    assert got[0] == ["a.b", "text", "n"] and [r[1] or None for r in got[1:]] == [t for _, _, t, _ in data] and [int(r[2]) for r in got[1:]] == list(range(60))
    back = read_table(spark, f"{tmp_path}/a.csv").orderBy("row_idx").collect()
    assert [r["text"] for r in back] == [t for _, _, t, _ in data]
    sinks.write_file(df, f"{tmp_path}/a.json")
    assert json.load(open(f"{tmp_path}/a.json", encoding="utf-8")) == [{"a.b": v, "text": t, "n": n} for _, v, t, n in data]
    sinks.write_file(df.limit(0), f"{tmp_path}/none.json")
    assert json.load(open(f"{tmp_path}/none.json")) == []
    sinks.write_file(df, f"{tmp_path}/a.ndjson")
    assert [json.loads(x)["n"] for x in open(f"{tmp_path}/a.ndjson", encoding="utf-8")] == list(range(60))
    with pytest.raises(ValueError):
        sinks.write_file(df, f"{tmp_path}/a.dat")


def test_workbooks_round_trip_in_ranges(spark, rows, tmp_path, monkeypatch):
    data, df = rows
    path = sinks.write_file(df, f"{tmp_path}/a.xlsx", "A & <B>")
    with zipfile.ZipFile(path) as z:
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    assert xlsx.sheet_names(spark, path) == ["A & <B>"]
    monkeypatch.setattr(xlsx, "RANGE", 7)
    back = xlsx.read(spark, path)
    assert back.rdd.getNumPartitions() > 1
    got = back.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(60)) and [r["n"] for r in got] == [str(k) for k in range(60)]
    assert [r["text"] for r in got] == [None if t is None else t.replace("\x01", "") for _, _, t, _ in data]
    assert [r["a.b"] for r in got] == [None if v is None else str(v) for _, v, _, _ in data]
    assert xlsx.preview(spark, path, None, 2)["shape"] == [60, 3]
    assert sinks.column_letters(0) == "A" and sinks.column_letters(701) == "ZZ" and xlsx.column_index(sinks.column_letters(16383)) == 16383


def test_synthetic_tables_as_files(spark, tmp_path):
    df = synth.table(spark, 40, 2, 0.1, 7)
    for fmt in ("json", "xlsx"):
        back = read_table(spark, synth.write(df, f"{tmp_path}/s.{fmt}", fmt))
        assert back.count() == 40 and {"Time", "Sensor_1", "Sensor_2"} <= set(back.columns)


LINES = ["﻿LabVIEW Measurement\t", "Separator\tComma", "Decimal_Separator\t,", "X_Columns\tOne", "Channels\tnot one yet", "***End_of_Header***\t", "", "ignored\t1",
         "Channels\t2", "X_Columns\tNo", "X0\t1,5", "Delta_X\t0,5", "X0\t2,5", "***End_of_Header***", "", "X_Value\tA\tNote", "\t1,25\tx\ty", "\t", "", "\t3\t z ", "",
         "Channels\t1", "***End_of_Header***", "X_Value\tB", "7\t4", "8\tn/a"]
# A line of one tab is blank; an empty cell is null, and a short row's missing ones too.
WANT = [(0, 2.5, 1.25, "x.y", None), (1, 3.0, 3.0, "z", None), (2, 7.0, None, None, "4"), (3, 8.0, None, None, "n/a")]


@pytest.mark.parametrize("cuts", [[], [3], [5, 6], [9, 10, 16, 17, 18], [20, 22, 24], list(range(1, len(LINES)))])
def test_instrument_text_in_parts(spark, tmp_path, cuts):
    folder = tmp_path / "x.lvm"
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(LINES)])):  # noqa: B905
        (folder / f"part-{k:03d}").write_text("\r\n".join(LINES[a:b]) + "\r\n", encoding="utf-8")
    df = read_table(spark, str(folder))
    got = [tuple(r[c] for c in ("row_idx", "X_Value", "A", "Note", "B")) for r in df.orderBy("row_idx").collect()]
    assert got == WANT
    meta = lvm.read(spark, str(folder))[1]
    assert meta["segment_count"] == 2 and meta["segments"][0]["x0"] == "2,5" and meta["segments"][1]["x_columns"] == "One" and meta["global_header"]["Separator"] == "Comma"


def test_broken_instrument_text(spark, tmp_path):
    for k, (lines, says) in enumerate([
            (["a\t1"], "did not contain"), (LINES[:7], "No tabular"), (LINES[:11], "did not contain"), (LINES[:14], "before the tabular"),
            ([*LINES[:10], "Delta_X\t1", *LINES[13:17]], "X0")]):
        p = tmp_path / f"{k}.lvm"
        p.write_text("\n".join(lines), encoding="utf-8")
        with pytest.raises(ValueError, match=says):
            read_table(spark, str(p))


def test_jobs_do_not_depend_on_segments(spark, tmp_path):
    def jobs(n):
        p = tmp_path / f"n{n}.lvm"
        p.write_text("\n".join(LINES[:7] + [x for k in range(n) for x in ("Channels\t1", f"X0\t{k}", "Delta_X\t1", "X_Columns\tNo", "***End_of_Header***", "X_Value\tA", f"\t{k}", "\t5")]), encoding="utf-8")
        spark.sparkContext.setJobGroup(f"lvm{n}", "")
        df = read_table(spark, str(p))
        assert df.agg(F.count("*"), F.sum("X_Value")).first() == (2 * n, sum(2 * k + 1 for k in range(n)))
        out = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lvm{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out

    # Spark's jobs vary with what it broadcasts.
    assert abs(jobs(300) - jobs(3)) < 10


def test_segments_are_numbered_by_blocks_and_lines_cut_once(spark, tmp_path):
    p = tmp_path / "long.lvm"
    body = [x for k in range(3) for x in ("Channels\t1", f"X0\t{k}", "Delta_X\t1", "X_Columns\tNo", "***End_of_Header***", "", f"X_Value\tA\tN{k % 2}", "\t5", "", "\t6\tx\ty\t")]
    p.write_text("\n".join(LINES[:7] + body), encoding="utf-8")
    got = lvm.parsed(spark, str(p))
    # No window over segments, and no line is read again for what is asked of heads or rows.
    for df in (got.heads, got.rows):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "split(" not in plan
    assert got.columns == ["X_Value", "A", "N0", "N1"]
    assert [(r["row_idx"], *r["cells"]) for r in got.rows.orderBy("row_idx").collect()] == [
        (0, "0.0", "5", None, None), (1, "1.0", "6", "x.y.", None), (2, "1.0", "5", None, None), (3, "2.0", "6", None, "x.y."), (4, "2.0", "5", None, None), (5, "3.0", "6", "x.y.", None)]
