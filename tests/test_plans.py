import datetime as dt

import pandas as pd

from helpers import frame, sine_hourly
from wattline.models.registry import load_model
from wattline.models.trees import Trees
from wattline.operators.features import DAILY, HOURLY, feature_columns
from wattline.plans import forecasts as P
from wattline.plans.tables import build_features, prepare
from wattline.plans.training import NAIVE, RIDGE, train_all
from wattline.sources.files import read_forecast_csv, read_table


def test_from_raw_readings_to_forecasts(spark, tmp_path):
    path = str(tmp_path)
    pdf = pd.concat([sine_hourly(24 * 60), sine_hourly(24 * 60, series="b", seed=7)])
    raw = frame(spark, pdf.sample(frac=0.97, random_state=2))
    holidays = spark.createDataFrame([("IN", dt.date(2023, 1, 26), "x")], "country string, holiday_date date, name string")
    hourly_spec, daily_spec = HOURLY.limited(168), DAILY.limited(14)

    prepare(raw, path)
    hourly, daily = build_features(spark, path, holidays, hourly=hourly_spec, daily=daily_spec)
    assert hourly.count() == 2 * (24 * 60 - 168) and daily.count() == 2 * (60 - 14)

    board = train_all(
        spark,
        path,
        hourly=dict(n_splits=2, test_size=48, trees={"Hourly Trees (Default)": Trees(2, 0.5, 3)}),
        daily=dict(n_splits=2, test_size=5, trees={}),
    )
    scores = {r["model"]: r["mape"] for r in board.collect()}
    assert set(scores) == {NAIVE["hour"], RIDGE["hour"], "Hourly Trees (Default)", NAIVE["day"], RIDGE["day"]}
    assert scores[RIDGE["hour"]] < scores[NAIVE["hour"]]

    model, meta = load_model(spark, f"{path}/best_model_hour")
    assert meta["model_name"] == RIDGE["hour"] and set(meta["feature_columns"]) == set(feature_columns(hourly_spec))
    outlook = P.Outlook(holidays)
    grid = read_table(spark, f"{path}/hourly_demand")
    products = P.forecast_all(
        grid,
        lambda h: P.ridge_forecaster(model, meta["feature_columns"], outlook, horizon=h, spec=hourly_spec),
        P.naive_forecaster("day"),
        outlook,
        path,
    )
    sizes = {name: df.count() for name, df in products.items()}
    assert sizes == {"next_day": 48, "next_week": 336, "next_week_daily": 14, "next_month": 60}
    assert spark.read.option("header", True).csv(f"{path}/forecast_next_month").count() == 60
