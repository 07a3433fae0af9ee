"""Forests against plain versions, and the queries of the tree line with few rounds on the smallest tables."""

import dataclasses

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from helpers import frame, sine_hourly, to_sorted_pandas
from wattline.models import folds as folding
from wattline.models.boosting import Forest, bin_edges, binned_blocks, boost, cv_forests, fit_forests, forest_importance, predict_forests
from wattline.models.recursive import recursive_forest_forecast
from wattline.models.registry import published_models, publish_models
from wattline.models.trees import CANDIDATES, Trees
from wattline.operators.features import HOURLY, any_length, feature_columns, feature_matrix, without_annual_gaps
from wattline.operators.horizon import append_future
from wattline.plans import forecasts as P
from wattline.plans import training

ROWS = "series_id string, datetime timestamp_ntz, demand_mw double, x1 double, x2 double, x3 double"


def table(n=300, series="a", seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"series_id": series, "datetime": pd.date_range("2023-01-01", periods=n, freq="h")})
    pdf["x1"], pdf["x2"], pdf["x3"] = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.normal(size=n)
    pdf["demand_mw"] = 100 + 10 * (pdf.x1 > 0.3) * (pdf.x2 > 1) + 3 * np.sin(pdf.x3) + rng.normal(0, 0.5, n)
    return pdf


def plain_boost(codes, y, trees, rounds, x):
    """The same trees by trying every split of every leaf."""
    margin, out = np.full(len(y), y.mean()), np.full(len(x), y.mean())
    for _ in range(rounds):
        slope = y - margin
        leaves = [(np.arange(len(y)), np.arange(len(x)), 0)]

        def best(rows, depth):
            found = (1e-9, None, None)
            if trees.leaves is None and depth >= trees.max_depth:
                return found
            for f in range(codes.shape[1]):
                for b in range(codes[:, f].max() + 1):
                    low = codes[rows, f] <= b
                    left, right = rows[low], rows[~low]
                    if min(len(left), len(right)) < max(trees.min_rows, 1):
                        continue
                    parts = [slope[p].sum() ** 2 / (len(p) + trees.l2) for p in (left, right, rows)]
                    gain = parts[0] + parts[1] - parts[2]
                    if gain > found[0] + 1e-9:
                        found = (gain, f, b)
            return found

        while len(leaves) < (trees.leaves or 2**trees.max_depth):
            scored = [best(rows, depth) for rows, _, depth in leaves]
            at = int(np.argmax([s[0] for s in scored]))
            _, f, b = scored[at]
            if f is None:
                break
            rows, others, depth = leaves.pop(at)
            low, low_others = codes[rows, f] <= b, x[others, f] <= b
            leaves += [(rows[low], others[low_others], depth + 1), (rows[~low], others[~low_others], depth + 1)]
        for rows, others, _ in leaves:
            value = trees.learning_rate * slope[rows].sum() / (len(rows) + trees.l2)
            margin[rows] += value
            out[others] += value
    return margin, out


@pytest.mark.parametrize("trees", [Trees(4, 0.3, min_rows=5, leaves=6), Trees(4, 0.3, 2, 1, l2=1.0), Trees(3, 0.5, min_rows=20, leaves=40)])
def test_trees_equal_trying_every_split(trees):
    rng = np.random.default_rng(2)
    codes = np.stack([rng.integers(0, 12, 150), rng.integers(0, 2, 150), rng.integers(0, 30, 150)], 1).astype(np.uint8)
    y = codes[:, 0] * 2.0 + (codes[:, 2] > 11) * codes[:, 1] * 7 + rng.normal(0, 1, 150)
    fresh = np.stack([rng.integers(0, 12, 60), rng.integers(0, 2, 60), rng.integers(0, 30, 60)], 1).astype(np.uint8)
    done = boost(codes, y, trees, (fresh, np.zeros(60)))
    margin, out = plain_boost(codes, y, trees, trees.rounds, fresh)
    np.testing.assert_allclose(done.booster.margin, margin, rtol=1e-10)
    np.testing.assert_allclose(done.margin, out, rtol=1e-10)
    forest = done.booster.forest(trees.rounds, [np.arange(40.0)] * 3)
    np.testing.assert_allclose(forest.score(fresh.astype(float)), out, rtol=1e-10)


def test_sampled_rounds_are_repeatable_and_keep_margins():
    rng = np.random.default_rng(3)
    codes, y = rng.integers(0, 50, (400, 5)).astype(np.uint8), rng.normal(size=400)
    trees = Trees(6, 0.3, 4, 3, "0.6", 0.7)
    one, two = boost(codes, y, trees), boost(codes, y, trees)
    assert one.booster.value == two.booster.value and one.rounds == 6
    score = one.booster.forest(6, [np.arange(60.0)] * 5).score(codes.astype(float))
    np.testing.assert_allclose(score, one.booster.margin, rtol=1e-10)


@pytest.mark.parametrize("patience", [1, 5, 400])
def test_early_stopping_keeps_the_best_prefix(patience):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 40, (300, 4)).astype(np.uint8)
    y = codes[:, 0] + rng.normal(0, 8, 300)
    held = (codes[200:], y[200:])
    full = Trees(60, 0.4, min_rows=3, leaves=8)
    errors = [float(((boost(codes[:200], y[:200], full, held, k).margin - held[1]) ** 2).mean()) for k in range(1, 61)]
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    done = boost(codes[:200], y[:200], dataclasses.replace(full, patience=patience), held)
    assert done.rounds == best + 1 and done.run == min(60, done.rounds + patience)
    assert float(((done.margin - held[1]) ** 2).mean()) == pytest.approx(errors[best])


def test_no_split_without_gain_and_constant_features():
    codes = np.zeros((10, 2), np.uint8)
    done = boost(codes, np.full(10, 5.0), Trees(3, 0.5, leaves=4), (codes, np.full(10, 5.0)))
    assert done.margin.tolist() == [5.0] * 10 and set(done.booster.feature) == {-1}


SMALL = {"one": Trees(5, 0.4, min_rows=4, leaves=7), "two": Trees(4, 0.3, 3, 2, "0.7", 0.8, patience=2, l2=1.0)}
NAMES = ["x1", "x2", "x3"]


def test_fits_of_spark_equal_those_by_hand_at_any_chunk(spark):
    pdf = pd.concat([table(300), table(260, "b", 5)])
    blocks = folding.time_blocks(frame(spark, pdf, ROWS), freq="hour", n_splits=2, test_size=40)
    results = []
    for steps in (32_768, 37):
        binned = binned_blocks(blocks, NAMES, freq="hour", block="block", chunk_steps=steps)
        assert binned.count() > (2 if steps < 100 else 1)
        cv = cv_forests(binned, SMALL, [1, 2], freq="hour")
        results.append(cv.orderBy("series_id", "model", "fold", "datetime").toPandas())
    pd.testing.assert_frame_equal(*results)
    got = results[0]
    assert len(got) == 2 * 2 * 2 * 40
    edges = {r["series_id"]: r["edges"] for r in bin_edges(blocks, NAMES).collect()}
    marked = to_sorted_pandas(blocks)
    for (series, model, fold), part in got.groupby(["series_id", "model", "fold"]):
        own = marked[marked.series_id == series]
        codes = np.stack([np.searchsorted(edges[series][j], own[c], side="left") for j, c in enumerate(NAMES)], 1).astype(np.uint8)
        seen, held = (own.block < fold).to_numpy(), (own.block == fold).to_numpy()
        y = own.demand_mw.to_numpy()
        done = boost(codes[seen], y[seen], SMALL[model], (codes[held], y[held]))
        np.testing.assert_allclose(part.sort_values("datetime").pred, done.margin, rtol=1e-12)
        assert set(part.n_rounds) == {done.rounds} and set(part.n_run) == {done.run}


def test_a_series_doesnt_depend_on_its_neighbours(spark):
    both, alone = (frame(spark, p, ROWS) for p in (pd.concat([table(200), table(150, "b", 6)]), table(200)))
    fitted = []
    for df in (both, alone):
        forests = fit_forests(binned_blocks(df, NAMES, freq="hour"), {"one": SMALL["one"]}).persist()
        fitted.append(forests.filter("series_id = 'a'").collect())
        scored = predict_forests(df, forests, NAMES, freq="hour", chunk_steps=61)
        row = Forest.of(fitted[-1][0])
        mine = to_sorted_pandas(scored.filter("series_id = 'a'"))
        np.testing.assert_allclose(mine["pred"], row.score(mine[NAMES].to_numpy()))
        assert ((mine.pred - mine.demand_mw) ** 2).mean() < 0.5 * mine.demand_mw.var()
    assert fitted[0] == fitted[1]


def test_importance_nulls_and_empty_tables(spark):
    pdf = table(200)
    pdf.loc[3, "x1"] = np.nan
    df = frame(spark, pdf, ROWS)
    forests = fit_forests(binned_blocks(df, NAMES, freq="hour"), {"one": SMALL["one"]}).persist()
    assert forests.first()["n_rows"] == 199
    assert predict_forests(df, forests.drop("model"), NAMES, freq="hour").count() == 199
    ranked = forest_importance(forests, NAMES, 3).orderBy("rank").collect()
    assert ranked[0]["feature"] in ("x1", "x2") and [r["rank"] for r in ranked] == [1, 2, 3] and sum(r["importance"] for r in ranked) == pytest.approx(1.0)
    assert fit_forests(binned_blocks(df.limit(0), NAMES, freq="hour"), SMALL).count() == 0


def test_recursion_equals_one_step_at_a_time(spark):
    spec = HOURLY.limited(24)
    holidays = spark.createDataFrame([("IN", pd.Timestamp("2023-01-26").date(), "x")], "country string, holiday_date date, name string")
    history = frame(spark, pd.concat([sine_hourly(200), sine_hourly(220, series="b", seed=4)])).persist()
    matrix = feature_matrix(history, holidays, freq="hour", spec=spec).persist()
    features = feature_columns(spec)
    forests = fit_forests(binned_blocks(matrix, features, freq="hour"), {"m": Trees(12, 0.3, min_rows=5, leaves=9)}).drop("model").persist()
    future = P.future_weather(history, 4, P.Outlook(holidays, temp_deltas=(0.0, 6.0))).persist()
    got = recursive_forest_forecast(history, future, forests, features, holidays, spec=spec, horizon=4).toPandas()
    assert len(got) == 16 and got["forecast_mw"].between(3000, 5000).all()
    keys = ["series_id", "scenario_id"]
    known = append_future(history.join(future.select(*keys).distinct(), "series_id"), future).toPandas()
    schema = "series_id string, scenario_id int, datetime timestamp_ntz, demand_mw double, temp_c double, relative_humidity double, step int"
    names = [c.split()[0] for c in schema.split(", ")]

    def plain(name, v):
        if pd.isna(v):
            return None
        return v.to_pydatetime() if name == "datetime" else int(v) if name in ("step", "scenario_id") else v

    for step in range(1, 5):
        rows = known[known.step.isna() | (known.step.astype(float) <= step)]
        grid = spark.createDataFrame([tuple(map(plain, names, r)) for r in rows[names].itertuples(index=False)], schema)
        x = without_annual_gaps(feature_matrix(grid, holidays, freq="hour", spec=any_length(spec), drop_na=False, by=keys), spec)
        now = x.filter(F.col("step") == step).toPandas()
        for series, part in now.groupby("series_id"):
            forest = Forest.of(forests.filter(F.col("series_id") == series).first())
            for k, value in zip(part.index, np.maximum(forest.score(part[features].to_numpy(float)), 0), strict=True):
                same = (known.series_id == series) & (known.scenario_id == part.scenario_id[k]) & (known.step.astype(float) == step)
                known.loc[same, "demand_mw"] = value
    want = known[known.step.notna()][[*keys, "step", "demand_mw"]].merge(got, on=[*keys, "step"])
    assert len(want) == 16
    np.testing.assert_allclose(want["forecast_mw"], want["demand_mw_x"] if "demand_mw_x" in want else want["demand_mw"], rtol=1e-9)


def test_short_history_has_no_forest_forecast(spark):
    spec = HOURLY.limited(24)
    holidays = spark.createDataFrame([], "country string, holiday_date date, name string")
    long = frame(spark, sine_hourly(120))
    features = feature_columns(spec)
    forests = fit_forests(binned_blocks(feature_matrix(long, holidays, freq="hour", spec=spec), features, freq="hour"), {"m": Trees(2, 0.3, leaves=3)})
    short = frame(spark, sine_hourly(10))
    future = P.future_weather(short, 2, P.Outlook(holidays))
    got = recursive_forest_forecast(short, future, forests.drop("model"), features, holidays, spec=spec, horizon=2)
    assert [r["forecast_mw"] for r in got.collect()] == [None, None]


def test_each_series_gets_and_publishes_its_own_champion(spark, tmp_path):
    spec = HOURLY.limited(168)
    holidays = spark.createDataFrame([("IN", pd.Timestamp("2023-01-26").date(), "x")], "country string, holiday_date date, name string")
    history = frame(spark, pd.concat([sine_hourly(700, series=s, seed=k) for k, s in enumerate("abcd")])).persist()
    matrix = feature_matrix(history, holidays, freq="hour", spec=spec).persist()
    features, path = feature_columns(spec), str(tmp_path)
    few = {"t": Trees(6, 0.3, min_rows=5, leaves=9)}
    rows = [("a", training.NAIVE["hour"], None), ("b", training.RIDGE["hour"], None), ("c", "t", None), ("d", None, "too short")]
    champions = spark.createDataFrame(rows, "series_id string, model string, reason string")
    with pytest.raises(FileNotFoundError):
        published_models(spark, path)
    models = training.refit_each(matrix, champions, features, freq="hour", trees=few)
    first = publish_models(models.filter("kind = 'naive'"), path, features=features, freq="hour")
    second = publish_models(models, path, features=features, freq="hour")
    assert (first, second) == (1, 2)
    assert published_models(spark, path, 1)[0].count() == 1
    loaded, row = published_models(spark, path)
    assert row["version"] == 2 and row["n_series"] == 3 and row["feature_columns"] == features
    outlook = P.Outlook(holidays)
    day = P.forecast_next_day(history, P.champion_forecaster(loaded, features, outlook, horizon=24, spec=spec), outlook)
    got = {r["series_id"]: (r["model"], r["n"]) for r in day.groupBy("series_id", "model").agg(F.count("forecast_mw").alias("n")).collect()}
    assert got == {"a": (training.NAIVE["hour"], 24), "b": (training.RIDGE["hour"], 24), "c": ("t", 24)}
    assert [tuple(r) for r in P.without_champion(history, loaded, champions).collect()] == [("d", "too short")]
    assert P.without_champion(history, loaded).first()["reason"] == "not in the training table"
    scored = training.predict_each(matrix, loaded, features, freq="hour")
    assert {r["series_id"]: r["count"] for r in scored.groupBy("series_id").count().collect()} == {s: 532 for s in "abc"}
    with pytest.raises(ValueError, match="unknown candidates"):
        training.refit_each(matrix, champions.withColumn("model", F.lit("nobody")), features, freq="hour", trees=few)


QUERIES = ("cv_evaluate_ridge", "early_stopping", "feature_importance_topk", "forecast_champions", "model_gbt_daily", "model_gbt_default", "model_gbt_depth5",
           "model_gbt_tuned", "recursive_forecast_trees", "recursive_forecast_trees_month", "recursive_forecast_trees_week", "refit_champion",
           "train_both_horizons", "unserved_champions")


@pytest.mark.parametrize("name", QUERIES)
def test_tree_queries_equal_their_sql(spark, sf_dir, name, monkeypatch):
    """Really run, with few rounds; the candidates are otherwise those of the library."""
    for freq in CANDIDATES:
        for candidate, trees in CANDIDATES[freq].items():
            monkeypatch.setitem(CANDIDATES[freq], candidate, dataclasses.replace(trees, rounds=20 if name == "feature_importance_topk" else 4))
    db = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
    got = sorted(tuple(map(str, r)) for r in contract.queries()[name](spark, sf_dir).select(*columns).collect())
    assert len(want) > 0 and got == want


def test_candidates_have_all_their_rounds():
    assert [t.rounds for t in CANDIDATES["hour"].values()] == [300, 400, 300] and [t.rounds for t in CANDIDATES["day"].values()] == [250]
