import datetime as dt

import numpy as np
import pandas as pd
import pytest

from helpers import assert_same, frame, sine_hourly, to_sorted_pandas
from pyspark.sql import functions as F
from wattline.models.ridge import fit_ridge
from wattline.operators import features as X
from wattline.operators.holidays import add_holiday_features, fixed_date_holidays
from wattline.operators.resample import resample_daily_mean


@pytest.fixture(scope="module")
def holidays(spark):
    days = ["2023-01-05", "2023-01-06", "2023-01-26", "2023-04-20"]
    rows = [("IN", dt.date.fromisoformat(d), f"h{i}") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "country string, holiday_date date, name string")


def pandas_hourly(g: pd.DataFrame, spec: X.FeatureSpec) -> pd.DataFrame:
    out = g.copy()
    v, t, h = g["demand_mw"], g["temp_c"], g["relative_humidity"]
    for k in spec.lags:
        out[spec.lag_name(k)] = v.shift(k)
    for w, stats in spec.rolling:
        for s in stats:
            out[f"rolling_{s}_{w}{spec.suffix}"] = getattr(v.shift(1).rolling(w), s)()
    m = f"rolling_mean_{spec.ratio_window}{spec.suffix}"
    out[f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean"] = v.shift(1) / (out[m] + 1e-5)
    for n, k in spec.temp_lags:
        out[n] = t.shift(k)
    for n, w in spec.temp_means:
        out[n] = t.shift(1).rolling(w).mean()
    out["humidity_rolling_mean"] = h.shift(1).rolling(spec.humidity_window).mean()
    return out


def two_series(n=1100):
    a, b = sine_hourly(n, series="a"), sine_hourly(n, start="2023-02-03 05:00", series="b", seed=9)
    a.loc[[40, 41, 300], "demand_mw"] = np.nan
    return pd.concat([a, b], ignore_index=True)


@pytest.mark.parametrize("chunk_steps", [97, 32768])
def test_window_features_match_pandas(spark, holidays, chunk_steps):
    spec = X.HOURLY.limited(720)
    pdf = two_series()
    want = pd.concat([pandas_hourly(g, spec) for _, g in pdf.groupby("series_id")], ignore_index=True)
    got = X.feature_matrix(
        frame(spark, pdf).repartition(7), holidays, freq="hour", spec=spec, drop_na=False, chunk_steps=chunk_steps
    )
    assert_same(to_sorted_pandas(got)[list(want.columns)], want, atol=2e-6)


def test_hourly_matrix_has_61_features():
    names = X.feature_columns(X.HOURLY)
    assert len(names) == 61 and len(set(names)) == 61
    assert len(X.feature_columns(X.DAILY)) == 50


def test_matrix_columns_and_dropna(spark, holidays):
    pdf = sine_hourly(1000)
    got = X.feature_matrix(frame(spark, pdf), holidays, freq="hour", spec=X.HOURLY.limited(720))
    assert set(X.select_features(got).columns) == set(X.feature_columns(X.HOURLY.limited(720)))
    assert got.count() == 1000 - 720


def test_leakage(spark, holidays):
    pdf = sine_hourly(300)
    changed = pdf.copy()
    changed.loc[200, "demand_mw"] += 1000
    spec = X.HOURLY.limited(168)
    left, right = (
        to_sorted_pandas(X.feature_matrix(frame(spark, p), holidays, freq="hour", spec=spec, drop_na=False))
        for p in (pdf, changed)
    )
    names = X.feature_columns(spec)
    assert_same(left[names].iloc[:201], right[names].iloc[:201], atol=0)
    assert left.loc[201, "lag_1h"] != right.loc[201, "lag_1h"]
    assert left.loc[24, "rolling_mean_24h"] == pytest.approx(pdf["demand_mw"][:24].mean(), rel=1e-9)


@pytest.mark.parametrize("chunk_steps", [1000, 32768])
def test_annual_lag_only_in_long_series(spark, chunk_steps):
    pdf = pd.concat([sine_hourly(9000, series="long"), sine_hourly(8800, series="short")], ignore_index=True)
    got = to_sorted_pandas(X.demand_lag_features(frame(spark, pdf), freq="hour", chunk_steps=chunk_steps))
    long = got[got.series_id == "long"].reset_index(drop=True)
    assert long["lag_8760h"].notna().sum() == 240
    np.testing.assert_array_equal(long["lag_8760h"][8760:], long["demand_mw"][:240])
    assert got[got.series_id == "short"]["lag_8760h"].isna().all()


def test_drop_sparse(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 1.0)], "x double, lag_8760h double")
    assert X.drop_sparse(df, "lag_8760h").columns == ["x"]
    assert X.drop_sparse(df, "x").columns == ["x", "lag_8760h"]


def test_require_features(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError, match="lag_24h"):
        X.require_features(df, ["x", "lag_24h"])
    assert X.require_features(df, ["x", "lag_24h"], 0.0).first()["lag_24h"] == 0.0


def test_calendar_matches_pandas(spark, holidays):
    pdf = sine_hourly(24 * 400, start="2023-11-20")
    got = to_sorted_pandas(X.add_calendar_features(frame(spark, pdf), holidays, freq="hour"))
    i = pd.DatetimeIndex(pdf["datetime"])
    want = {
        "hour": i.hour,
        "is_peak_hour": ((i.hour >= 9) & (i.hour <= 11) | (i.hour >= 18) & (i.hour <= 22)).astype(int),
        "is_night_valley": ((i.hour >= 1) & (i.hour <= 5)).astype(int),
        "day_of_week": i.dayofweek,
        "day_of_month": i.day,
        "day_of_year": i.dayofyear,
        "week_of_year": i.isocalendar().week.astype(int),
        "month": i.month,
        "quarter": i.quarter,
        "year": i.year,
        "season": i.month % 12 // 3 + 1,
        "annual_position": i.dayofyear / 365.25,
        "is_weekend": (i.dayofweek >= 5).astype(int),
        "sin_hour": np.sin(2 * np.pi * i.hour / 24),
        "cos_week": np.cos(2 * np.pi * i.dayofweek / 7),
        "sin_year": np.sin(2 * np.pi * i.dayofyear / 365.25),
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), np.asarray(values, float), atol=1e-12, err_msg=name)


def test_holiday_distances(spark, holidays):
    pdf = pd.DataFrame({"datetime": pd.date_range("2022-11-20", "2023-06-15", freq="D")})
    got = add_holiday_features(frame(spark, pdf, "datetime timestamp_ntz"), holidays, country="IN")
    got = got.toPandas().sort_values("datetime").reset_index(drop=True)
    days = pd.to_datetime(["2023-01-05", "2023-01-06", "2023-01-26", "2023-04-20"])
    for row in got.itertuples():
        gaps = (days - row.datetime).days.to_numpy()
        until = min([g for g in gaps if g >= 0] + [30])
        since = min([-g for g in gaps if g <= 0] + [30])
        assert (row.days_until_holiday, row.days_since_holiday) == (until, since)
        assert row.is_holiday == (0 in gaps) and row.is_pre_holiday == (1 in gaps) and row.is_post_holiday == (-1 in gaps)
        assert row.is_working_day == (row.datetime.dayofweek < 5 and 0 not in gaps)


def test_fixed_dates(spark):
    got = fixed_date_holidays(spark, 1999, 2001, [(1, 26, "a"), (12, 25, "b")], "IN").collect()
    assert len(got) == 6 and {r["holiday_date"].year for r in got} == {1999, 2000, 2001}


def test_daily_matrix(spark, holidays):
    pdf = sine_hourly(24 * 120)
    daily = resample_daily_mean(frame(spark, pdf))
    spec = X.DAILY.limited(30)
    want = pdf.set_index("datetime")[["demand_mw", "temp_c", "relative_humidity"]].resample("1D").mean().reset_index()
    want = pandas_hourly(want.assign(series_id="a"), spec)
    got = to_sorted_pandas(X.feature_matrix(daily, holidays, freq="day", spec=spec, drop_na=False))
    assert_same(got[list(want.columns)], want, atol=1e-6)
    assert "hour" not in got.columns and "sin_hour" not in got.columns


def test_features_at_equals_full_matrix(spark, holidays):
    spec = X.HOURLY.limited(168)
    df = frame(spark, sine_hourly(600))
    at = pd.Timestamp("2023-01-20 07:00")
    full = X.feature_matrix(df, holidays, freq="hour", spec=spec, drop_na=False).filter(F.col("datetime") == F.lit(at).cast("timestamp_ntz"))
    one = X.features_at(df, holidays, F.lit(str(at)), freq="hour", spec=spec)
    assert_same(to_sorted_pandas(one), to_sorted_pandas(full), atol=1e-8)


def test_derived_weather(spark):
    pdf = sine_hourly(24, start="2024-01-01").assign(temp_c=[35.0] * 12 + [15.0] * 12, relative_humidity=60.0)
    got = to_sorted_pandas(X.add_derived_weather(frame(spark, pdf)))
    assert got["cdd"].round(6).tolist() == [16.67] * 12 + [0.0] * 12
    assert got["hdd"].round(6).tolist() == [0.0] * 12 + [3.33] * 12
    assert got["heat_index_c"][20] == 15.0 and got["heat_index_c"][0] == pytest.approx(45.05, abs=0.01)
    assert got["temp_humidity_interaction"][0] == 21.0
    missing = pdf.assign(temp_c=np.nan)
    assert to_sorted_pandas(X.add_derived_weather(frame(spark, missing)))["cdd"].isna().all()


def test_mixed_lengths_equal_single_runs(spark, holidays):
    both = [sine_hourly(17600, series="long"), sine_hourly(1500, series="short")]
    run = lambda pdf: to_sorted_pandas(X.feature_matrix(frame(spark, pdf), holidays, freq="hour"))
    got = run(pd.concat(both, ignore_index=True))
    assert len(got[got.series_id == "long"]) == 17600 - 8760 and len(got[got.series_id == "short"]) == 1500 - 720
    for pdf in both:
        alone = run(pdf)
        own = got[got.series_id == pdf["series_id"][0]].reset_index(drop=True)
        pd.testing.assert_frame_equal(own, alone, rtol=1e-12)
    assert (got[got.series_id == "short"]["lag_8760h"] == 0).all()
    matrix = X.feature_matrix(frame(spark, pd.concat(both, ignore_index=True)), holidays, freq="hour")
    names = X.feature_columns(X.HOURLY)
    fitted = {r["series_id"]: r["coefficients"][names.index("lag_8760h")] for r in fit_ridge(matrix, names, 10.0).collect()}
    assert fitted["short"] == 0 and fitted["long"] != 0
