import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly, to_sorted_pandas
from pyspark.sql import functions as F
from wattline.operators import explore as E
from wattline.operators import kpi as K

FORECAST = "series_id string, datetime timestamp_ntz, forecast_mw double"


def day_frame():
    values = [100.0, 90.0, 120.0, 150.0, 150.0, 90.0, 130.0]
    return pd.DataFrame({"series_id": "a", "datetime": pd.date_range("2024-01-01", periods=7, freq="h"), "forecast_mw": values})


def test_kpi_day_takes_first_of_ties(spark):
    row = K.kpi_day(frame(spark, day_frame(), FORECAST).repartition(4)).first()
    assert (row["peak_time"].hour, row["trough_time"].hour) == (3, 1)
    assert row["max_ramp_mw_hr"] == 40.0 and row["load_factor"] == pytest.approx(row["avg_mw"] / 150)
    assert row["total_gwh"] == pytest.approx(0.83)


def week_frame(spark):
    pdf = pd.DataFrame(
        {
            "series_id": "a",
            "datetime": pd.date_range("2024-01-03", periods=7, freq="D"),
            "forecast_mean_mw": [100.0, 110, 105, 80, 70, 120, 90],
            "peak_mw": [150.0, 160, 160, 100, 95, 155, 120],
            "min_mw": [50.0, 52, 49, 40, 41, 60, 40],
            "total_gwh": [2.4, 2.6, 2.5, 1.9, 1.7, 2.9, 2.2],
        }
    )
    pdf["day_of_week"] = pdf["datetime"].dt.day_name()
    pdf["is_weekend"] = (pdf["datetime"].dt.dayofweek >= 5).astype(int)
    pdf["day_over_day_change_mw"] = pdf["forecast_mean_mw"].diff().fillna(0.0)
    pdf["temp_c"] = 20.0
    schema = "series_id string, datetime timestamp_ntz, forecast_mean_mw double, peak_mw double, min_mw double, total_gwh double, day_of_week string, is_weekend int, day_over_day_change_mw double, temp_c double"
    return frame(spark, pdf, schema), pdf


def test_kpi_week(spark):
    df, pdf = week_frame(spark)
    row = K.kpi_week(df).first()
    assert (row["peak_day"], row["min_day"]) == ("Thursday", "Saturday")
    assert row["week_total_gwh"] == pytest.approx(pdf["total_gwh"].sum())
    split = K.kpi_weekday_weekend(df).first()
    assert split["weekend_avg_mw"] == 75.0 and split["weekend_delta"] == pytest.approx((75 - 105) / 105)
    change = K.kpi_max_change(df).first()
    assert (change["max_change_mw"], change["max_change_day"]) == (50.0, "Monday")
    assert K.planning_table(df).columns == ["series_id", *K.PLANNING_COLUMNS]


def test_month(spark):
    pdf = pd.DataFrame({"series_id": "a", "datetime": pd.date_range("2024-07-01", periods=30, freq="D"), "forecast_mw": np.r_[np.arange(20.0), np.arange(10.0)], "total_daily_gwh": np.arange(30.0), "temp_c": 30.0, "weather_source": ["nwp_forecast"] * 14 + ["climatology"] * 16})
    df = frame(spark, pdf, "series_id string, datetime timestamp_ntz, forecast_mw double, total_daily_gwh double, temp_c double, weather_source string")
    row = K.kpi_month(df).first()
    assert row["month_total_gwh"] == 435 and row["month_peak_date"].day == 20
    want = pdf.resample("W", on="datetime")["total_daily_gwh"].sum()
    got = K.weekly_energy(df).orderBy("week_end").toPandas()
    assert got["total_daily_gwh"].tolist() == want.tolist() and got["week"].tolist() == [f"Week {i + 1}" for i in range(len(want))]
    assert [str(d) for d in got["week_end"]] == [str(d.date()) for d in want.index]
    nwp, rest = K.weather_source_split(df)
    assert (nwp.count(), rest.count()) == (14, 16)
    assert K.preview(df, 5, ["datetime", "forecast_mw"]).count() == 5


def test_band(spark):
    df = frame(spark, day_frame(), FORECAST).withColumns({f"{s}_bound_{k}": F.lit(float(k)) for s in ("lower", "upper") for k in (80, 90, 95)})
    assert K.confidence_band(df, 80).first()["lower_bound"] == 80.0
    with pytest.raises(ValueError):
        K.confidence_band(df, 99)


@pytest.mark.parametrize("chunk_steps", [50, 32768])
def test_acf_pacf(spark, chunk_steps):
    pdf = pd.concat([sine_hourly(300), sine_hourly(200, series="b", seed=8)])
    df = E.acf(frame(spark, pdf), chunk_steps=chunk_steps)
    got = df.orderBy("series_id", "lag").toPandas()
    for s, g in pdf.groupby("series_id"):
        x = g["demand_mw"].to_numpy() - g["demand_mw"].mean()
        want = np.array([np.sum(x[k:] * x[: len(x) - k]) for k in range(49)]) / np.sum(x * x)
        np.testing.assert_allclose(got[got.series_id == s]["acf"], want, atol=1e-10)
        # Partial autocorrelation of lag k: last coefficient of the Yule-Walker system of order k.
        partial = [1.0] + [
            np.linalg.solve([[want[abs(i - j)] for j in range(k)] for i in range(k)], want[1 : k + 1])[-1] for k in range(1, 49)
        ]
        mine = E.pacf(df).filter(F.col("series_id") == s).orderBy("lag").toPandas()["pacf"]
        np.testing.assert_allclose(mine, partial, atol=1e-6)


@pytest.mark.parametrize("chunk_steps", [31, 32768])
def test_decompose(spark, chunk_steps):
    pdf = sine_hourly(200)
    got = to_sorted_pandas(E.seasonal_decompose(frame(spark, pdf), chunk_steps=chunk_steps))
    v = pdf["demand_mw"]
    weights = np.r_[0.5, np.ones(23), 0.5] / 24
    trend = np.r_[[np.nan] * 12, np.convolve(v, weights, "valid"), [np.nan] * 12]
    phase = np.arange(200) % 24
    means = pd.Series(v - trend).groupby(phase).mean()
    seasonal = (means - means.mean())[phase].to_numpy()
    np.testing.assert_allclose(got["trend"], trend)
    np.testing.assert_allclose(got["seasonal"], seasonal, atol=1e-8)
    np.testing.assert_allclose(got["resid"], v - trend - seasonal, atol=1e-8)


@pytest.mark.parametrize("chunk_steps", [40, 32768])
def test_zoom_ramp_and_profiles(spark, chunk_steps):
    pdf = sine_hourly(24 * 70)
    df = frame(spark, pdf)
    zoom = to_sorted_pandas(E.week_zoom(df, chunk_steps=chunk_steps))
    start = pdf["datetime"].iloc[-24 * 60]
    assert zoom["datetime"].tolist() == list(pd.date_range(start, start + pd.Timedelta(days=7), freq="h"))
    ramps = to_sorted_pandas(E.ramp(df, chunk_steps=chunk_steps))["ramp_mw_hr"]
    np.testing.assert_allclose(ramps, pdf["demand_mw"].diff().fillna(0.0))
    assert E.recent_window(df, 48, chunk_steps=chunk_steps).count() == 48
    for profile, key in ((E.profile_hour, "hour"), (E.profile_day_of_week, "dayofweek"), (E.profile_month, "month")):
        want = pdf.groupby(getattr(pdf["datetime"].dt, key))["demand_mw"].mean()
        got = profile(df).toPandas().iloc[:, 1:].sort_values(by=profile(df).columns[1])
        np.testing.assert_allclose(got["mean_mw"], want)
    stats = E.summary_stats(df).first()
    assert stats["demand_std"] == pytest.approx(pdf["demand_mw"].std()) and stats["n_rows"] == 1680
    corr = E.weather_demand_correlation(df).first()
    assert corr["temp_corr"] == pytest.approx(pdf["temp_c"].corr(pdf["demand_mw"]))
    assert E.weather_demand_pairs(df).columns == ["series_id", "temp_c", "relative_humidity", "demand_mw"]
