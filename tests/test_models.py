import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly, to_sorted_pandas
from pyspark.sql import functions as F
from wattline.models import folds as folding
from wattline.models.naive import naive_column, predict_naive
from wattline.models.registry import load_model, save_model
from wattline.models.ridge import fit_ridge, predict_ridge
from wattline.models.trees import Trees, best_round, cv_trees, fit_trees, importance_table, predict_trees

ROWS = "series_id string, datetime timestamp_ntz, demand_mw double, x1 double, x2 double, year int"


def rows(n, series="a", seed=0):
    rng = np.random.default_rng(seed)
    pdf = sine_hourly(n, series=series, seed=seed)
    pdf["x1"], pdf["x2"] = rng.normal(50, 9, n), rng.normal(5000, 300, n)
    pdf["year"] = 2020 + np.arange(n) // 50
    pdf["demand_mw"] = 3 * pdf["x1"] + 0.5 * pdf["x2"] + 20 * pdf["year"] + rng.normal(0, 5, n)
    return pdf


def ridge_by_hand(pdf, features, alpha):
    x, y = pdf[features].to_numpy(float), pdf["demand_mw"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(features)), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


@pytest.mark.parametrize("chunk_steps", [13, 32768])
def test_time_folds(spark, chunk_steps):
    n, size, k = 130, 20, 5
    df = frame(spark, rows(n), ROWS).repartition(5)
    got = folding.time_folds(df, freq="hour", n_splits=k, test_size=size, chunk_steps=chunk_steps).toPandas()
    start = pd.Timestamp("2023-01-01")
    got["pos"] = (got["datetime"] - start) // pd.Timedelta(hours=1)
    for fold in range(1, k + 1):
        first = n - (k - fold + 1) * size
        part = got[got.fold == fold]
        assert sorted(part[part.role == "train"]["pos"]) == list(range(first))
        assert sorted(part[part.role == "valid"]["pos"]) == list(range(first, first + size))


def test_too_short_series_is_named(spark):
    df = frame(spark, pd.concat([rows(100), rows(130, "b", 4)], ignore_index=True), ROWS)
    sizes = dict(freq="hour", n_splits=5, test_size=20)
    assert {r["series_id"] for r in folding.time_blocks(df, **sizes).collect()} == {"b"}
    short = folding.unserved(df, **sizes).collect()
    assert [(r["series_id"], r["n_rows"]) for r in short] == [("a", 100)] and "more than 100" in short[0]["reason"]


def test_patience_ends_at_the_best_round():
    errors = [9.0, 7.0, 8.0, 6.0, 6.5, 6.4, 6.3, 1.0]
    assert best_round(errors, 2) == 4 and best_round(errors, 9) == 8 and best_round(errors, 1) == 2
    assert best_round([3.0], 5) == 1


def test_ridge_matches_normal_equations(spark):
    features = ["x1", "x2", "year"]
    pdf = pd.concat([rows(230), rows(180, "b", 4)], ignore_index=True)
    df = frame(spark, pdf, ROWS)
    blocks = folding.time_blocks(df, freq="hour", n_splits=3, test_size=30)
    fitted = fit_ridge(blocks.repartition(6), features, 10.0, block="block")
    got = {(r["series_id"], r["fold"]): r for r in fitted.collect()}
    assert len(got) == 8
    for series, g in pdf.groupby("series_id"):
        n = len(g)
        for fold in range(4):
            used = g if fold == 0 else g.iloc[: n - (3 - fold + 1) * 30]
            intercept, w = ridge_by_hand(used, features, 10.0)
            r = got[(series, fold)]
            assert r["n_rows"] == len(used)
            np.testing.assert_allclose(r["coefficients"], w, rtol=1e-6)
            assert r["intercept"] == pytest.approx(intercept, abs=1e-4)  # of terms near 40,000
    valid = blocks.filter("block > 0").withColumnRenamed("block", "fold")
    pred = predict_ridge(valid, fitted, features).filter("series_id = 'b' and fold = 2").orderBy("datetime").toPandas()
    intercept, w = ridge_by_hand(pdf[pdf.series_id == "b"].iloc[:120], features, 10.0)
    np.testing.assert_allclose(pred["pred"], pred[features].to_numpy(float) @ w + intercept, rtol=1e-8)


def test_naive(spark):
    df = spark.createDataFrame([(4500.0, 1), (4600.0, 2), (4700.0, 3)], "lag_168h double, other int")
    assert [r["pred"] for r in predict_naive(df).collect()] == [4500.0, 4600.0, 4700.0]
    assert naive_column(["lag_24h"]) == "lag_24h"
    with pytest.raises(ValueError):
        naive_column(["x"])


def test_champion_and_leaderboard(spark):
    schema = "series_id string, model string, mape double, mae double, rmse double, r2 double, wape double"
    a = spark.createDataFrame([("s", "m1", 0.2, 1.0, 1.0, 0.5, 0.1), ("s", "m2", 0.1, 1.0, 1.0, 0.5, 0.1)], schema)
    b = spark.createDataFrame([("s", "m3", 0.1, 1.0, 1.0, 0.5, 0.1), ("s", "m4", None, 1.0, 1.0, 0.5, 0.1)], schema)
    board = folding.leaderboard(a, b)
    assert board.count() == 4
    best = folding.select_champion(board, ["m4", "m1", "m3", "m2"])
    assert best.first()["model"] == "m3"


def test_trees_and_registry(spark, tmp_path):
    features = ["x1", "x2", "year"]
    df = frame(spark, rows(200), ROWS)
    small = Trees(5, 0.3, 3, 2)
    blocks = folding.time_blocks(df, freq="hour", n_splits=2, test_size=40)
    scored = cv_trees(blocks, features, small, 2).withColumn("model", F.lit("t"))
    result = folding.cv_mean(folding.fold_metrics(scored))
    assert scored.count() == 80 and result.first()["mape"] < 0.2
    model = fit_trees(df, features, small)
    top = importance_table(df, model, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]

    path = str(tmp_path / "model")
    metrics = {"t": {"mape": 0.1, "mae": 1.0, "rmse": 2.0, "r2": 0.9, "wape": 0.1}}
    save_model(model, path, features=features, metrics=metrics, model_name="t", spark=spark)
    loaded, meta = load_model(spark, path)
    assert meta["model_name"] == "t" and meta["feature_columns"] == features and meta["metrics"]["t"]["r2"] == 0.9
    want = to_sorted_pandas(predict_trees(df, model))["pred"]
    np.testing.assert_allclose(to_sorted_pandas(predict_trees(df, loaded))["pred"], want)

    fitted = fit_ridge(df, features, 1.0)
    save_model(fitted, path + "2", features=features, metrics=metrics, model_name="r")
    loaded, meta = load_model(spark, path + "2")
    assert meta["model_class"] == "RidgeCoefficients" and loaded.first()["coefficients"] == fitted.first()["coefficients"]
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "nothing"))
