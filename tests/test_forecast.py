import datetime as dt

import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly, to_sorted_pandas
from pyspark.sql import functions as F
from wattline.functions.uncertainty import DAILY_UNCERTAINTY, HOURLY_UNCERTAINTY, Uncertainty
from wattline.functions.weather import Climatology
from wattline.models.recursive import recursive_model_forecast, recursive_ridge_forecast, unserved
from wattline.models.ridge import fit_ridge, predict_ridge
from wattline.models.trees import Trees, fit_trees
from wattline.operators import horizon as H
from wattline.operators.features import DAILY, HOURLY, feature_columns, feature_matrix
from wattline.plans import forecasts as P

WEATHER = "datetime timestamp_ntz, temp_c double, relative_humidity double"


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame([("IN", dt.date(2023, 2, 15), "x")], "country string, holiday_date date, name string")


def test_sigma_spot_values(spark):
    df = spark.createDataFrame([(1,), (24,), (168,), (720,)], "step int")
    sigma = [r[0] for r in df.select(Uncertainty(130.0).sigma(F.col("step"))).orderBy("step").collect()]
    assert sigma == sorted(sigma) and len(set(sigma)) == 4
    first = df.select(F.round(HOURLY_UNCERTAINTY.sigma(F.col("step")), 2), F.round(DAILY_UNCERTAINTY.sigma(F.col("step")), 2)).first()
    assert tuple(first) == (132.85, 112.75)
    assert df.select(Uncertainty().sigma(F.lit(0))).first()[0] == df.select(Uncertainty().sigma(F.lit(1))).first()[0]


def test_intervals_are_nested(spark):
    df = spark.range(1, 25).select(F.col("id").cast("int").alias("step"), F.lit(5000.0).alias("forecast_mw"))
    for r in HOURLY_UNCERTAINTY.attach_intervals(df).collect():
        assert r["lower_bound_95"] <= r["lower_bound_90"] <= r["lower_bound_80"] <= r["forecast_mw"]
        assert r["forecast_mw"] <= r["upper_bound_80"] <= r["upper_bound_90"] <= r["upper_bound_95"]
    low = HOURLY_UNCERTAINTY.attach_intervals(df.withColumn("forecast_mw", F.lit(10.0))).first()
    assert low["lower_bound_95"] == 0.0


def test_climatology(spark):
    # Offsets as in the published forecasts; spot value of their first hour.
    model = Climatology(temp_offset=0.39737132240898615, humidity_offset=-0.2765286023423693)
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1),)], "datetime timestamp_ntz")
    assert tuple(df.select(model.temp(F.col("datetime")), model.humidity(F.col("datetime"))).first()) == (33.44, 61.92)
    hours = frame(spark, pd.DataFrame({"datetime": pd.date_range("2024-06-01", periods=48, freq="h")}), "datetime timestamp_ntz")
    t, h = (hours.select(c(F.col("datetime")).alias("v")).toPandas()["v"] for c in (Climatology().temp, Climatology().humidity))
    assert t.between(10, 55).all() and h.between(10, 100).all()


def test_weather_for_horizon(spark):
    history = frame(spark, sine_hourly(10))
    future = H.future_grid(history, 20 * 24)
    start = pd.Timestamp("2023-01-01 10:00")
    forecast = pd.DataFrame({"datetime": pd.date_range(start, periods=16 * 24, freq="h"), "temp_c": 20.0, "relative_humidity": 50.0})
    forecast.loc[5, "temp_c"] = np.nan
    got = H.weather_for_horizon(future, frame(spark, forecast, WEATHER)).orderBy("step").toPandas()
    assert len(got) == 480 and (got["datetime"] == pd.date_range(start, periods=480, freq="h")).all()
    source = got["weather_source"].tolist()
    assert source[:5] == ["nwp_forecast"] * 5 and source[5] == "climatology" and source[6] == "nwp_forecast"
    assert source[14 * 24 - 1] == "nwp_forecast" and set(source[14 * 24 :]) == {"climatology"}
    assert got["temp_c"].notna().all()
    limited = H.limit_weather_forecast(frame(spark, forecast, WEATHER), F.lit("2023-01-01 10:00:00"))
    assert limited.count() == 14 * 24
    tagged = frame(spark, forecast.assign(weather_source="climatological_fallback"), WEATHER + ", weather_source string")
    assert H.weather_for_horizon(future, tagged).filter("step = 1").first()["weather_source"] == "climatological_fallback"


def test_scenarios(spark):
    df = H.add_scenarios(spark.createDataFrame([(1, 20.0)], "step int, temp_c double"), (-1.5, 0.0, 2.0))
    assert [(r["scenario_id"], r["temp_c"]) for r in df.orderBy("scenario_id").collect()] == [(0, 18.5), (1, 20.0), (2, 22.0)]


@pytest.mark.parametrize("chunk_steps", [9, 32768])
def test_history_tail(spark, chunk_steps):
    got = H.history_tail(frame(spark, sine_hourly(100)), 30, chunk_steps=chunk_steps)
    assert got.count() == 30


def test_naive_week_and_month(spark, holidays):
    pdf = pd.concat([sine_hourly(400), sine_hourly(500, start="2023-03-01 07:00", series="b", seed=2)])
    outlook = P.Outlook(holidays)
    hourly, daily = P.forecast_next_week(frame(spark, pdf), P.naive_forecaster("hour"), outlook)
    got = to_sorted_pandas(hourly)
    for s, g in pdf.groupby("series_id"):
        np.testing.assert_allclose(got[got.series_id == s]["forecast_mw"], g["demand_mw"].tail(168).round(2), atol=0.011)
    check_daily_summary(got[got.series_id == "b"], to_sorted_pandas(daily.filter("series_id = 'b'")))

    month = to_sorted_pandas(P.forecast_next_month(frame(spark, pdf), P.naive_forecaster("day"), outlook))
    days = pdf[pdf.series_id == "b"].set_index("datetime")["demand_mw"].resample("1D").mean()
    values = list(days)
    for _ in range(30):
        values.append(values[-7])
    b = month[month.series_id == "b"]
    np.testing.assert_allclose(b["forecast_mw"], np.round(values[-30:], 2), atol=0.011)
    assert b["datetime"].tolist() == list(pd.date_range(days.index[-1] + pd.Timedelta(days=1), periods=30))
    np.testing.assert_allclose(b["total_daily_gwh"], b["forecast_mw"] * 24 / 1000, atol=0.0051)


def check_daily_summary(hourly: pd.DataFrame, daily: pd.DataFrame):
    want = hourly.resample("1D", on="datetime").agg(
        {"forecast_mw": ["mean", "max", "min", "sum"], "temp_c": "mean", "lower_bound_90": "mean"}
    )
    np.testing.assert_allclose(daily["forecast_mean_mw"], want[("forecast_mw", "mean")])
    np.testing.assert_allclose(daily["peak_mw"], want[("forecast_mw", "max")])
    np.testing.assert_allclose(daily["total_gwh"], want[("forecast_mw", "sum")] / 1000)
    np.testing.assert_allclose(daily["lower_bound_mw"], want[("lower_bound_90", "mean")])
    assert daily["day_of_week"].tolist() == list(want.index.day_name())
    change = want[("forecast_mw", "mean")].diff().fillna(0.0).round(1)
    np.testing.assert_allclose(daily["day_over_day_change_mw"], change, atol=0.11)


def test_constant_month(spark, holidays):
    got = P.forecast_next_month(frame(spark, sine_hourly(60)), None, P.Outlook(holidays)).toPandas()
    assert len(got) == 30 and (got["forecast_mw"] == 5000.0).all()
    assert set(got["weather_source"]) == {"climatology"}


def brute_force(pdf, future, spec, fitted, features, holidays, spark, horizon):
    """Recompute the whole matrix for every step and feed the prediction back."""
    work = pd.concat([pdf, future.assign(demand_mw=np.nan)], ignore_index=True)
    for h in range(horizon):
        at = len(pdf) + h
        rows = frame(spark, work.iloc[: at + 1])
        matrix = feature_matrix(rows, holidays, freq=spec.freq, spec=spec, drop_na=False)
        last = matrix.orderBy(F.desc("datetime")).limit(1)
        value = predict_ridge(last, fitted, features).first()["pred"]
        work.loc[at, "demand_mw"] = max(value, 0.0)
    return work["demand_mw"].to_numpy()[len(pdf) :]


@pytest.mark.parametrize("chunk_steps", [40, 32768])
def test_recursive_ridge_equals_step_by_step(spark, holidays, chunk_steps):
    spec = HOURLY.limited(48)
    pdf = sine_hourly(400)
    history = frame(spark, pdf)
    features = feature_columns(spec)
    matrix = feature_matrix(history, holidays, freq="hour", spec=spec)
    fitted = fit_ridge(matrix, features, 10.0).persist()
    horizon = 5
    outlook = P.Outlook(holidays, temp_deltas=(0.0, 3.0))
    future = P.future_weather(history, horizon, outlook)
    got = recursive_ridge_forecast(history, future, fitted, features, holidays, spec=spec, horizon=horizon, chunk_steps=chunk_steps)
    for scenario in (0, 1):
        rows = future.filter(F.col("scenario_id") == scenario).orderBy("step").toPandas()
        want = brute_force(pdf, rows[list(pdf.columns.drop("demand_mw"))], spec, fitted, features, holidays, spark, horizon)
        mine = got.filter(F.col("scenario_id") == scenario).orderBy("step").toPandas()["forecast_mw"]
        np.testing.assert_allclose(mine, want, rtol=1e-7)


def test_ridge_products(spark, holidays):
    spec = HOURLY.limited(168)
    pdf = pd.concat([sine_hourly(500), sine_hourly(520, start="2023-02-01", series="b", seed=3)])
    history = frame(spark, pdf)
    features = feature_columns(spec)
    fitted = fit_ridge(feature_matrix(history, holidays, freq="hour", spec=spec), features, 10.0).persist()
    # Weather of the horizon continues the sine wave of the history.
    ahead = pd.concat([sine_hourly(600), sine_hourly(620, start="2023-02-01", series="b")])
    weather = frame(spark, ahead).drop("demand_mw")
    outlook = P.Outlook(holidays, weather=weather, temp_deltas=(0.0, 2.0))
    day = P.forecast_next_day(history, P.ridge_forecaster(fitted, features, outlook, horizon=24, spec=spec), outlook)
    got = day.toPandas()
    assert len(got) == 24 * 2 * 2 and got["forecast_mw"].notna().all()
    truth = 4000 + 500 * np.sin(2 * np.pi * np.arange(500, 524) / 24)
    mine = got[(got.series_id == "a") & (got.scenario_id == 0)].sort_values("step")["forecast_mw"]
    assert np.abs(mine.to_numpy() - truth).mean() < 120
    assert {"hour", "day_of_week", "weather_source", "uncertainty_sigma_mw"} <= set(got.columns)


def test_ridge_month(spark, holidays):
    spec = DAILY.limited(14)
    history = frame(spark, sine_hourly(24 * 120))
    outlook = P.Outlook(holidays)
    from wattline.operators.resample import resample_daily_mean

    matrix = feature_matrix(resample_daily_mean(history), holidays, freq="day", spec=spec)
    features = feature_columns(spec)
    fitted = fit_ridge(matrix, features, 5.0)
    got = P.forecast_next_month(history, P.ridge_forecaster(fitted, features, outlook, horizon=30, freq="day", spec=spec), outlook).toPandas()
    assert len(got) == 30 and got["forecast_mw"].notna().all()


def test_short_history_has_no_forecast(spark, holidays):
    spec = HOURLY.limited(48)
    features = feature_columns(spec)
    fitted = fit_ridge(feature_matrix(frame(spark, sine_hourly(300)), holidays, freq="hour", spec=spec), features, 10.0)
    history = frame(spark, sine_hourly(20))
    future = P.future_weather(history, 3, P.Outlook(holidays))
    got = recursive_ridge_forecast(history, future, fitted, features, holidays, spec=spec, horizon=3)
    assert [r["forecast_mw"] for r in got.collect()] == [None] * 3
    short = unserved(history, spec, 3).collect()
    assert [r["series_id"] for r in short] == ["a"] and "20 rows" in short[0]["reason"]


def test_missing_feature_raises(spark, holidays):
    spec = HOURLY.limited(48)
    history = frame(spark, sine_hourly(300))
    future = P.future_weather(history, 3, P.Outlook(holidays))
    fitted = spark.createDataFrame([("a", 0, 0.0, [1.0])], "series_id string, fold int, intercept double, coefficients array<double>")
    with pytest.raises(ValueError, match="lag_720h"):
        recursive_ridge_forecast(history, future, fitted, ["lag_720h"], holidays, spec=spec, horizon=3)


def test_recursive_trees(spark, holidays):
    spec = HOURLY.limited(24)
    history = frame(spark, sine_hourly(200))
    matrix = feature_matrix(history, holidays, freq="hour", spec=spec)
    model = fit_trees(matrix, feature_columns(spec), Trees(3, 0.5, 3))
    future = P.future_weather(history, 2, P.Outlook(holidays))
    got = recursive_model_forecast(history, future, model, holidays, spec=spec, horizon=2).orderBy("step").collect()
    assert len(got) == 2 and all(3000 < r["forecast_mw"] < 5000 for r in got)
