import json
import zipfile

import pytest

from tidewright import cache, studies, synth, workflow
from tidewright.__main__ import main
from tidewright.config import Config, Schema
from tidewright.functions import normalize_header
from tidewright.operators import scaling, schema
from tidewright.sources import csv_encoding, lvm, read_table, xlsx


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("row_idx").collect()]


def lvm_text(segments, x_columns="No", decimal="."):
    out = ["LabVIEW Measurement\t", "Separator\tTab", f"Decimal_Separator\t{decimal}", f"X_Columns\t{x_columns}", "***End_of_Header***\t", ""]
    for x0, dx, names, body in segments:
        out += ["Channels\t2", "Samples\t2\t2", f"X0\t{x0}", f"Delta_X\t{dx}", "***End_of_Header***", "\t".join(names)] + ["\t".join(b) for b in body] + [""]
    return "\r\n".join(out)


def test_lvm_with_explicit_time(spark, tmp_path):
    p = tmp_path / "a.lvm"
    p.write_text(lvm_text([("0", "0.5", ["X_Value", "Tube_Inlet_1", "Tube_Outlet_1", "Comment"], [["0", "45.229875", "44.1"], ["0.5", "45.230267", "44.2"], ["1", "45.231", "44.3"]])], "One"))
    df, meta = lvm.read(spark, str(p))
    assert meta["segment_count"] == 1 and df.columns == ["X_Value", "Tube_Inlet_1", "Tube_Outlet_1", "Comment"]
    assert [tuple(r)[:2] for r in df.collect()] == [(0.0, 45.229875), (0.5, 45.230267), (1.0, 45.231)]


def test_lvm_segments_and_decimal_commas(spark, tmp_path):
    names = ["X_Value", "Temperature_0", "Comment"]
    p = tmp_path / "b.lvm"
    p.write_text(lvm_text([("0", "0,5", names, [["", "21,0", "x"], ["", "21,1", "a", "b"]]), ("1,0", "0,5", names, [["", "21,2"], ["", "21,3"]])], decimal=","))
    df = read_table(spark, str(p))
    assert rows(df, "X_Value", "Temperature_0") == [(0.0, 21.0), (0.5, 21.1), (1.0, 21.2), (1.5, 21.3)]
    assert rows(df, "Comment")[1] == ("a\tb",)
    assert lvm.read(spark, str(p))[1]["segments"][1]["x0"] == "1,0"
    data, summary = schema.normalize(df, "b")
    assert summary["time_source"] == "X_Value" and summary["sensor_columns"] == ["Temperature_0"]
    bad = tmp_path / "c.lvm"
    bad.write_text("no header\t1\n")
    with pytest.raises(ValueError):
        lvm.read(spark, str(bad))


def test_json_kinds(spark, tmp_path):
    one = [{"Time": 0, "a": {"b": 1.5}}, {"Time": 1, "a": {"b": 2.5}}]
    for name, value in (("l.json", one), ("r.json", {"records": one})):
        (tmp_path / name).write_text(json.dumps(value))
        assert sorted(r["a.b"] for r in read_table(spark, str(tmp_path / name)).collect()) == [1.5, 2.5]
    (tmp_path / "n.ndjson").write_text("\n".join(map(json.dumps, one)))
    assert [r["a"]["b"] for r in read_table(spark, str(tmp_path / "n.ndjson")).orderBy("row_idx").collect()] == [1.5, 2.5]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x.txt"))


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="First" r:id="r1"/><sheet name="Second" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Time</t></si><si><t>Sen</t><t>sor</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row><c r="A2"><v>0</v></c><c r="C2"><v>1.5</v></c><c r="D2"><v>9</v></c></row><row><c r="A3"><v>1</v></c><c r="C3" t="inlineStr"><is><t>n/a</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")


def test_workbooks(spark, tmp_path):
    p = tmp_path / "w.xlsx"
    workbook(p)
    df = read_table(spark, str(p))
    assert [c for c in df.columns if c != "row_idx"] == ["Time", "unnamed_1", "Sensor", "unnamed_3"]
    assert rows(df, "Time", "Sensor", "unnamed_3") == [("0", "1.5", "9"), ("1", "n/a", None)]
    assert list(xlsx.sheets(p.read_bytes())) == ["First", "Second"] and xlsx.column_index("AB7") == 27
    assert read_table(spark, str(p), "Second").count() == 0
    with pytest.raises(ValueError):
        read_table(spark, str(p), "Third")


def test_schema_inference(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("Timestamp,TC-01 Temp (°C),Notes,Flow\n" + "\n".join(f"2026-01-01 00:00:{i:02d},{20 + i},ok,{'' if i % 7 == 0 else i % 3}" for i in range(30)))
    df = read_table(spark, str(p))
    m = schema.infer_schema(df)
    assert m.time_column.original_name == "Timestamp" and not m.time_column.ambiguous
    assert m.sensor_columns == ["TC-01 Temp (°C)", "Flow"] and m.normalized_headers[1] == "tc_01_temp_degc"
    data, summary = schema.normalize(df, "d", Config(schema=Schema(exclude_columns=["flow"])))
    assert summary["sensor_columns"] == ["TC-01 Temp (°C)"]
    assert [(r["time"], r["value"]) for r in data.orderBy("row_idx").limit(3).collect()] == [(0.0, 20.0), (1.0, 21.0), (2.0, 22.0)]
    assert csv_encoding(spark, str(p)) == "utf-8"
    with pytest.raises(ValueError):
        schema.infer_time_column(df, "missing")
    assert schema.infer_time_column(df, "notes").confidence == 1.0


def test_ambiguous_time(spark):
    raw = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(50)], "row_idx long, p double, q double")
    data, summary = schema.normalize(raw, "x")
    assert summary["time_source"] == "generated_index" and summary["sensor_columns"] == ["q"]
    with pytest.raises(ValueError):
        schema.normalize(raw, "x", Config(allow_index_time_fallback=False))


def test_headers():
    assert normalize_header(" TC-01 Temp (°C) ") == "tc_01_temp_degc" and normalize_header("__A  b__") == "a_b"


def test_synthetic_tables(spark, tmp_path):
    df = synth.table(spark, 128, 4, 0.05, 7, time_mode="datetime", header_style="irregular", include_junk_columns=True, dropout_fraction=0.1, flat_fraction=0.01)
    assert df.columns[1:] == ["Timestamp", "TC-01 Temp (C)", "flow sensor 2", "Pressure.Channel.3", "sensor 4 reading", "Operator Notes", "Batch ID", "QC Flag"]
    assert df.count() == 128 and df.where("`Pressure.Channel.3` is null").count() == 12
    again = synth.table(spark, 128, 4, 0.05, 7, time_mode="datetime", header_style="irregular", include_junk_columns=True, dropout_fraction=0.1, flat_fraction=0.01)
    assert df.exceptAll(again).count() == 0
    made = synth.campaign(spark, str(tmp_path / "c"), "t", [32, 64], 3, 0.1, 0.01, 10)
    assert [d["seed"] for d in made["datasets"]] == [10, 11]
    assert read_table(spark, made["datasets"][1]["path"]).count() == 64


def test_workflow_writes_and_reuses(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text("Time,Sensor_A,Sensor_B\n" + "\n".join(f"{10 * i},{10 + (i % 2) * 0.1 + (5 if i == 7 else 0)},{20.0 + i}" for i in range(35)))
    config = Config(analysis_dir=str(tmp_path / "analysis"))
    report = workflow.run_workflow(spark, str(src), config, characterize=True)
    run = report["runs"][0]
    assert report["cache"]["status"] == "built" and report["inspect"]["estimated_rows"] == 35
    for key in ("cleaning_summary_csv", "characterization_summary_csv", "steady_state_summary_json", "steady_state_groups_summary_csv", "steady_state_report_md"):
        assert (tmp_path / run[key]).exists()
    text = open(run["cleaning_summary_csv"]).read().splitlines()
    assert text[0] == "sensor,n_points,n_flagged,fraction_flagged,mean_original,mean_cleaned,std_original,std_cleaned,min_cleaned,max_cleaned" and text[1].startswith("Sensor_A,35,1,")
    about = json.loads(open(f"{report['session_dir']}/session_metadata.json").read())
    assert about["command_name"] == "workflow" and report["session_dir"].endswith(about["session_id"]) and about["paths"]["outputs_dir"] == f"{report['session_dir']}/outputs"
    assert cache.ensure_cache(spark, config.analysis_dir, str(src), config)["status"] == "reused"
    data = cache.load_cache(spark, report["cache"]["cache_dir"])
    want = workflow.clean(data, config).orderBy("sensor", "row_idx").collect()
    for mode in ("replicated", "partitioned"):
        assert workflow.clean(data, config, mode).orderBy("sensor", "row_idx").collect() == want
    src.write_text(src.read_text() + "\n350,1,2")
    assert cache.find_cache(spark, config.analysis_dir, str(src), config) is None


def test_scaling_summaries(spark):
    runs = scaling.elapsed(spark.createDataFrame([("replicated", 2, [5.0, 6.0]), ("other", 1, [1.0])], "mode string, nproc int, all_times array<double>"))
    assert [r["speedup_vs_serial"] for r in scaling.benchmark_summary(runs).collect()] == [None, None]
    loads = spark.createDataFrame([(0.1, 2.0, 3, 10, 1), (0.3, 1.0, 2, 12, 2), (0.2, 0.0, 2, 8, 0)], "load_sec double, compute_sec double, n_sensors int, n_rows int, n_halo int")
    m = scaling.work_metrics(loads).first()
    assert m["compute_ratio"] == 2.0 and m["max_load_elapsed_sec"] == 0.3 and m["mean_halo_rows"] == 1.0
    study = studies.scaling_study(spark, lambda mode, n: {"timing_breakdown": {"compute": 1.0}}, [("serial", 1), ("partitioned", 2)], 2)
    assert scaling.benchmark_summary(study).count() == 2
    wide = scaling.wide_metrics(scaling.metric_summary(study.selectExpr("mode", "nproc", "explode(breakdowns) as metrics")), ["compute"])
    assert [r["max_compute"] for r in wide.collect()] == [1.0, 1.0]
    texts = spark.createDataFrame([("a", 1, 0, {"host": None, "kind": "x"}), ("a", 1, 2, {"host": "n2", "kind": "y"}), ("a", 1, 1, {"host": "n1"})], "mode string, nproc int, run int, texts map<string,string>")
    assert sorted(tuple(r) for r in scaling.text_summary(texts).collect()) == [("a", 1, "host", "n1"), ("a", 1, "kind", "x")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("Time,A\n" + "\n".join(f"{k},{k * 2}" for k in range(20)))
    (tmp_path / "c.json").write_text(json.dumps({"analysis_dir": str(tmp_path / "analysis")}))
    out = main(["--config", str(tmp_path / "c.json"), "cache-build", str(tmp_path / "in.csv")])
    assert out["status"] == "built" and json.loads(capsys.readouterr().out)["status"] == "built"
    (about,) = (tmp_path / "analysis").glob("*/session_metadata.json")
    assert json.loads(about.read_text())["argv"][2] == "cache-build"


def test_settings():
    assert Config.of({}).modes == ("serial", "replicated", "partitioned")
    with pytest.raises(TypeError):
        Config.of({"characterization": {"method": "linear", "other": 1}})


def test_values_of_all_columns_at_once(spark):
    rows = [(k, str(k * 0.5), None if k % 3 else str(k % 2), None, f"2024-01-{k + 1:02d}") for k in range(9)]
    got = {r["column"]: tuple(r)[1:] for r in schema.value_features(spark.createDataFrame(rows, "row_idx long, t string, few string, none string, `a.day` string"), ["t", "few", "none", "a.day"]).collect()}
    assert got == {"t": (9, 1.0, True, True, 0.0), "few": (3, 1.0, False, True, 0.0), "a.day": (9, 0.0, False, False, 1.0)}
