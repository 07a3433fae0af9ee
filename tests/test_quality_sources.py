import json

import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly
from wattline.operators import quality as Q
from wattline.sources import files, reports
from wattline.sources.weather import read_weather_payload

SHORT = "series_id string, datetime timestamp_ntz, demand_mw double, temp_c double"


def flat(values):
    return pd.DataFrame(
        {"series_id": "a", "datetime": pd.date_range("2024-01-01", periods=len(values), freq="h"), "demand_mw": values, "temp_c": 25.0}
    )


def test_valid(spark):
    report = Q.validate(frame(spark, sine_hourly(48))).first()
    assert report["passed"] and report["total_rows"] == 48 and report["issues"] == []


@pytest.mark.parametrize(
    "values, message",
    [([5000.0] * 23 + [-100.0], "non-positive or negative"), ([5000.0] * 23 + [np.nan], "unresolved missing values"), ([5000.0] * 23 + [0.0], "non-positive"), ([5000.0] * 23 + [20000.5], "above the ceiling")],
)
def test_breaches(spark, values, message):
    with pytest.raises(Q.DataQualityError, match=message):
        Q.validate(frame(spark, flat(values), SHORT))


def test_missing_can_be_allowed(spark):
    report = Q.validate(frame(spark, flat([5000.0, np.nan]), SHORT), allow_missing=True).first()
    assert report["passed"] and report["null_demand_mw"] == 1


def test_weather_bounds_and_duplicates(spark):
    pdf = sine_hourly(4)
    pdf.loc[1, "temp_c"], pdf.loc[2, "relative_humidity"] = 61.0, 101.0
    pdf.loc[3, "datetime"] = pdf.loc[2, "datetime"]
    report = Q.quality_report(frame(spark, pdf)).first()
    assert report["n_duplicates"] == 1 and report["n_temp_outside"] == 1 and report["n_humidity_outside"] == 1
    assert [i.split()[1] for i in report["issues"]] == ["duplicate", "outside", "outside"]


def test_arrival_order(spark):
    hours = [2, 1, 3, 3, 5, 4, 9, 8, 7]
    rows = [("a", i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for i, h in enumerate(hours)]
    df = spark.createDataFrame([(s, i, t.to_pydatetime()) for s, i, t in rows], "series_id string, seq int, datetime timestamp_ntz")
    assert Q.count_out_of_order(df, "seq").first()["n_out_of_order"] == 4
    assert Q.count_duplicates(df).first()["n_duplicates"] == 1


def test_order_rule_comes_first(spark):
    df = spark.sql("select 'a' series_id, seq, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 2 - seq) datetime, -1D demand_mw from values 0, 1 t(seq)")
    with pytest.raises(Q.DataQualityError, match="monotonically"):
        Q.validate(df, seq="seq")


def test_schema(spark):
    df = spark.createDataFrame([("x", 1.0)], "datetime string, demand_mw double")
    assert Q.validate_schema(df)
    with pytest.raises(ValueError, match="target"):
        Q.validate_schema(df.drop("demand_mw"))
    with pytest.raises(Q.DataQualityError):
        Q.quality_report(df)


def test_custom_csv(spark, tmp_path):
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=24, freq="h").astype(str), "load_mw": np.linspace(4000, 6000, 24), "temperature": 22.5, "note": "x"})
    path = str(tmp_path / "grid.csv")
    pdf.to_csv(path, index=False)
    df = files.read_csv_series(spark, path, date_col="timestamp", demand_col="load_mw", temp_col="temperature")
    assert df.columns == ["series_id", "datetime", "demand_mw", "temp_c"] and df.count() == 24
    assert df.schema["datetime"].dataType.simpleString() == "timestamp_ntz"
    meta = files.dataset_metadata(df, dataset_name="grid").first()
    assert meta["data_provenance"] == "real_recorded" and meta["n_rows"] == 24
    with pytest.raises(KeyError, match="date column"):
        files.read_csv_series(spark, path)
    with pytest.raises(KeyError, match="demand column"):
        files.read_csv_series(spark, path, date_col="timestamp")
    with pytest.raises(FileNotFoundError):
        files.read_csv_series(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        files.with_provenance(df, "guess")


def test_csv_round_trip(spark, tmp_path):
    df = frame(spark, sine_hourly(30)).drop("series_id")
    path = files.write_csv(df, str(tmp_path / "out"), ["datetime"])
    back = files.read_cached_series(spark, path)
    assert back.drop("series_id").exceptAll(df).count() == 0 and back.count() == 30


def test_payload(spark):
    payload = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [10.5, None], "relative_humidity_2m": [80.0, 81.0]}})
    df = spark.createDataFrame([("a", payload)], "series_id string, payload string")
    got = read_weather_payload(df).orderBy("datetime").collect()
    assert [tuple(r)[2:] for r in got] == [(10.5, 80.0, "nwp_forecast"), (None, 81.0, "nwp_forecast")]
    assert str(got[1]["datetime"]) == "2024-01-01 01:00:00"


def test_reports(spark, tmp_path):
    schema = "model string, mape double, mae double, rmse double, r2 double, wape double"
    df = spark.createDataFrame([("Naive", 0.0624, 412.73, 523.21, 0.73199, 0.06298)], schema)
    line = reports.markdown_rows(df).first()["value"]
    assert line == "| **Naive** | 6.24% | 412.7 MW | 523.2 MW | 0.7320 | 6.30% |"
    assert reports.display_metrics(df).first()["mae"] == "412.7 MW"
    assert json.loads(reports.metrics_json(df).first()["value"])["Naive"]["r2"] == 0.73199
    path = reports.write_markdown(df, str(tmp_path / "md"))
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert text[0].startswith("| Model") and text[2] == line
    reports.write_metrics_json(df, str(tmp_path / "json"))


@pytest.mark.parametrize("mark", ["NA", "NaN", "nan", "N/A", "null", ""])
def test_marks_for_missing_values_are_null(spark, tmp_path, mark):
    (tmp_path / "a.csv").write_text(f"datetime,demand_mw,temp_c\n2024-01-01 00:00:00,5.5,{mark}\n2024-01-01 01:00:00,{mark},1\n")
    rows = files.read_csv_series(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["demand_mw"], r["temp_c"]) for r in rows] == [(5.5, None), (None, 1.0)]


def test_other_texts_still_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,demand_mw\n2024-01-01 00:00:00,five\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_csv_series(spark, str(tmp_path / "a.csv")).collect()


def test_readings_without_a_series_are_reported(spark):
    rows = [(None, 0, pd.Timestamp("2024-01-01").to_pydatetime(), -5.0), ("a", 1, pd.Timestamp("2024-01-01").to_pydatetime(), 5.0)]
    df = spark.createDataFrame(rows, "series_id string, seq long, datetime timestamp_ntz, demand_mw double")
    got = {r["series_id"]: r["passed"] for r in Q.quality_report(df, seq="seq").collect()}
    assert got == {None: False, "a": True}
