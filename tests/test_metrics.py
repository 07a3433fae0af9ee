import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly, to_sorted_pandas
from pyspark.sql import functions as F
from wattline.operators import metrics as M

PAIRS = "series_id string, datetime timestamp_ntz, y_true double, y_pred double"


def reference_metrics(y, p):
    keep = (y != 0) & ~np.isnan(y) & ~np.isnan(p)
    y, p = y[keep], p[keep]
    e = y - p
    return {
        "mape": np.mean(np.abs(e) / np.abs(y)),
        "mae": np.mean(np.abs(e)),
        "rmse": np.sqrt(np.mean(e**2)),
        "r2": 1 - np.sum(e**2) / np.sum((y - y.mean()) ** 2),
        "wape": np.sum(np.abs(e)) / np.sum(np.abs(y)),
        "max_err": np.max(np.abs(e)),
    }


def pairs(n=800, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "series_id": "a",
            "datetime": pd.date_range("2024-01-01", periods=n, freq="h"),
            "y_true": rng.normal(100, 30, n).round(1),
            "y_pred": rng.normal(100, 30, n),
        }
    )
    pdf.loc[3, "y_true"], pdf.loc[7, "y_true"], pdf.loc[11, "y_pred"] = 0.0, np.nan, np.nan
    return pdf


def test_four_points(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 310.0), (400.0, 390.0)], "y_true double, y_pred double")
    row = M.metrics(df).first()
    assert (row["mae"], row["rmse"], row["max_err"]) == (10, 10, 10)
    assert row["wape"] == pytest.approx(0.04) and row["r2"] > 0.98


def test_against_numpy(spark):
    pdf = pairs()
    row = M.metrics(frame(spark, pdf, PAIRS), ["series_id"]).first()
    for name, value in reference_metrics(pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy()).items():
        assert row[name] == pytest.approx(value, rel=1e-10)
    assert M.usable_pairs(frame(spark, pdf, PAIRS)).count() == 797


def test_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 1.0), (None, 1.0)], "y_true double, y_pred double")
    assert all(v is None for v in M.metrics(df).first())
    same = spark.createDataFrame([(5.0, 5.0), (5.0, 6.0)], "y_true double, y_pred double")
    assert M.metrics(same).first()["r2"] == 0.0
    assert M.metrics(same.filter("y_pred = 5")).first()["r2"] is None


def test_horizon_segments(spark):
    pdf = pairs()
    got = M.horizon_segments(frame(spark, pdf, PAIRS)).toPandas().set_index("segment")
    known = pdf.dropna()
    for label, n in M.SEGMENTS:
        want = reference_metrics(known["y_true"].to_numpy()[:n], known["y_pred"].to_numpy()[:n])
        assert got.loc[label, "n_observations"] == n
        assert got.loc[label, "mape"] == pytest.approx(want["mape"])
        assert got.loc[label, "r2"] == pytest.approx(want["r2"])


@pytest.mark.parametrize("chunk_steps", [7, 32768])
def test_tail(spark, chunk_steps):
    pdf = pd.concat([sine_hourly(100), sine_hourly(30, start="2023-05-05", series="b")]).sample(frac=0.8, random_state=1)
    got = to_sorted_pandas(M.tail(frame(spark, pdf), 40, chunk_steps=chunk_steps))
    want = pdf.sort_values(["series_id", "datetime"]).groupby("series_id").tail(40)
    assert got["datetime"].tolist() == want["datetime"].tolist()


def test_residual_diagnostics(spark):
    pdf = sine_hourly(300).assign(pred=lambda d: d["demand_mw"] + np.random.default_rng(5).normal(0, 40, 300))
    pdf["is_holiday"] = (pdf["datetime"].dt.day % 5 == 0).astype(int)
    schema = "series_id string, datetime timestamp_ntz, demand_mw double, pred double, is_holiday int"
    df = M.residuals(frame(spark, pdf, schema))
    r = (pdf["pred"] - pdf["demand_mw"]).to_numpy()
    ape = np.abs(r) / pdf["demand_mw"].to_numpy() * 100

    summary = M.residual_summary(df).first()
    assert summary["residual_mean"] == pytest.approx(r.mean()) and summary["residual_std"] == pytest.approx(r.std(ddof=1))

    counts, edges = np.histogram(r, bins=40)
    got = M.residual_histogram(df, chunk_steps=50).orderBy("bin").toPandas()
    assert got["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(got["bin_start"], edges[:-1])

    by_hour = pd.Series(ape).groupby(pdf["datetime"].dt.hour).mean()
    hourly = M.mape_by_hour(df)
    np.testing.assert_allclose(hourly.orderBy("hour").toPandas()["mape"], by_hour)
    best = M.worst_and_best_hour(hourly).first()
    assert (best["worst_hour"], best["best_hour"]) == (by_hour.idxmax(), by_hour.idxmin())

    kinds = pd.Series(ape).groupby(pdf["is_holiday"]).mean()
    row = M.mape_by_holiday(df).first()
    assert row["regular_mape"] == pytest.approx(kinds[0]) and row["holiday_mape"] == pytest.approx(kinds[1])
    assert M.mape_by_holiday(df.withColumn("is_holiday", F.lit(0))).first()["holiday_mape"] == 0.0


def test_constant_residuals_fall_into_one_bin(spark):
    pdf = sine_hourly(10).assign(pred=lambda d: d["demand_mw"] + 1)
    df = frame(spark, pdf, "series_id string, datetime timestamp_ntz, demand_mw double, pred double")
    got = M.residual_histogram(M.residuals(df).withColumn("residual", F.lit(1.0))).toPandas()
    assert got["n"].sum() == 10 and got["n"].max() == 10 and len(got) == 40


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [("a", 100.0, 110.0), ("a", 200.0, nan), ("a", nan, 5.0), ("a", 300.0, 270.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, y_true double, y_pred double")
    got = M.metrics(df, ["series_id"]).first()
    assert got["mae"] == 20.0 and got["max_err"] == 30.0 and abs(got["mape"] - 0.1) < 1e-12
    assert M.usable_pairs(df).count() == 2
    assert [r["residual"] for r in M.residuals(df, "y_true", "y_pred").collect()] == [10.0, None, None, -30.0, None]
