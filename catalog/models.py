"""Models, folds, cross-validation and leaderboard."""

from __future__ import annotations

from catalog import views as V
from catalog.features import daily_matrix, hourly_matrix, lag_sql, matrix_sql
from catalog.registry import query, scratch
from pyspark.sql import Window
from pyspark.sql import functions as F
from wattline.models import folds as folding
from wattline.models.naive import predict_naive
from wattline.models.boosting import binned_blocks, cv_forests, fit_forests, forest_importance, predict_forests
from wattline.models.ridge import ALL_ROWS, fit_ridge, predict_ridge
from wattline.models.registry import published_models, publish_models
from wattline.models.trees import CANDIDATES
from wattline.operators import features as X
from wattline.plans import training
from wattline.sources.files import read_table, write_table

DAILY_SPEC = X.DAILY

_HOURLY = V.with_(V.clean_sql(V.MIXED_SQL))
_DAILY = V.with_(V.clean_sql(V.ORDERS_SQL, "day"))


def stored(spark, matrix):
    """A feature table, written once and read by every fit."""
    return read_table(spark, write_table(matrix, scratch(spark)))


def hourly_naive(spark, sf_dir):
    grid = X.add_lags(V.mixed(spark, sf_dir), {"lag_168h": 168}, freq="hour")
    return grid.filter(F.col("lag_168h").isNotNull())


def daily_naive(spark, sf_dir):
    grid = X.add_lags(V.daily(spark, sf_dir), {"lag_7d": 7}, freq="day")
    return grid.filter(F.col("lag_7d").isNotNull())


@query("model_seasonal_naive", _HOURLY + f"""SELECT series_id, datetime, demand_mw, pred
FROM (SELECT *, {lag_sql('demand_mw', 168)} AS pred FROM cleaned) WHERE pred IS NOT NULL""", "demand_mw pred")
def model_seasonal_naive(spark, sf_dir):
    return predict_naive(hourly_naive(spark, sf_dir)).select("series_id", "datetime", "demand_mw", "pred")


def _blocks_sql(source: str, name: str, size: int) -> str:
    """Five blocks of ``size`` rows at the end of each series."""
    return f"""{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
{name} AS (SELECT *, CAST(CASE WHEN pos < n - 5 * {size} THEN 0 ELSE (pos - (n - 5 * {size})) // {size} + 1 END AS INTEGER) AS block FROM {name}_rows WHERE n > 5 * {size})"""


_NAIVE_DAILY_SQL = f"known AS (SELECT * FROM (SELECT *, {lag_sql('demand_mw', 7)} AS pred FROM cleaned) WHERE pred IS NOT NULL)"


@query("cv_time_split", _DAILY + ", " + _NAIVE_DAILY_SQL + ", " + _blocks_sql("known", "blocks", 60) + """
SELECT series_id, datetime, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'valid' ELSE 'train' END AS role
FROM blocks, (SELECT unnest(generate_series(1, 5)) AS fold) WHERE block <= fold""")
def cv_time_split(spark, sf_dir):
    return folding.time_folds(daily_naive(spark, sf_dir), freq="day").select("series_id", "datetime", "fold", "role")


def metrics_sql(y: str, p: str, only: tuple[str, ...] = ("mape", "mae", "rmse", "r2", "wape", "max_err")) -> str:
    texts = {
        "mape": f"avg(abs({y} - {p}) / abs({y}))",
        "mae": f"avg(abs({y} - {p}))",
        "rmse": f"sqrt(avg(({y} - {p}) * ({y} - {p})))",
        "r2": f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))",
        "wape": f"sum(abs({y} - {p})) / sum(abs({y}))",
        "max_err": f"max(abs({y} - {p}))",
    }
    return ", ".join(f"{texts[m]} AS {m}" for m in only)


_NAIVE_NAMES = training.NAIVE

# CTEs ending in ``results``: mean fold metrics of both naive candidates.
CV_SQL = (
    V.with_(V.clean_sql(V.MIXED_SQL))
    + f""", h_known AS (SELECT * FROM (SELECT *, {lag_sql('demand_mw', 168)} AS pred FROM cleaned) WHERE pred IS NOT NULL),
{_blocks_sql("h_known", "h_blocks", 720)},
"""
    + V.clean_sql(V.ORDERS_SQL, "day", name="d_cleaned")
    .replace("readings", "d_readings")
    .replace("grid", "d_grid")
    .replace("clipped", "d_clipped")
    + f""",
d_known AS (SELECT * FROM (SELECT *, {lag_sql('demand_mw', 7)} AS pred FROM d_cleaned) WHERE pred IS NOT NULL),
{_blocks_sql("d_known", "d_blocks", 60)},
valid AS (
  SELECT series_id, '{_NAIVE_NAMES["hour"]}' AS model, block AS fold, demand_mw, pred FROM h_blocks WHERE block > 0
  UNION ALL SELECT series_id, '{_NAIVE_NAMES["day"]}', block, demand_mw, pred FROM d_blocks WHERE block > 0),
folds AS (SELECT series_id, model, fold, {metrics_sql("demand_mw", "pred")} FROM valid WHERE demand_mw <> 0 GROUP BY 1, 2, 3),
results AS (SELECT series_id, model, avg(mape) AS mape, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2, avg(wape) AS wape FROM folds GROUP BY 1, 2)"""
)


def _fold_scores(spark, sf_dir):
    hours = folding.validation_rows(hourly_naive(spark, sf_dir), freq="hour")
    days = folding.validation_rows(daily_naive(spark, sf_dir), freq="day")
    hours = predict_naive(hours).withColumn("model", F.lit(_NAIVE_NAMES["hour"]))
    days = predict_naive(days, "lag_7d").withColumn("model", F.lit(_NAIVE_NAMES["day"]))
    return folding.fold_metrics(hours), folding.fold_metrics(days)


def cv_results(spark, sf_dir):
    return folding.leaderboard(*(folding.cv_mean(s).drop("n_folds") for s in _fold_scores(spark, sf_dir)))


_METRICS = "mape mae rmse r2 wape"


@query("cv_evaluate", CV_SQL + " SELECT * FROM folds", _METRICS + " max_err")
def cv_evaluate(spark, sf_dir):
    """All metrics of every fold of the naive candidates."""
    return folding.leaderboard(*_fold_scores(spark, sf_dir))


@query("leaderboard", CV_SQL + " SELECT * FROM results", _METRICS)
def leaderboard(spark, sf_dir):
    return cv_results(spark, sf_dir)


def _matrix_sql(freq):
    prefix, spec = (V.with_(V.clean_sql(V.MIXED_SQL)), X.HOURLY) if freq == "hour" else (_DAILY, X.DAILY)
    return prefix + ", " + matrix_sql(spec)


def as_good_as_naive(results, freq):
    """A flag for models whose mean error is at most the naive one's."""
    naive = results.filter(F.col("model") == _NAIVE_NAMES[freq]).select("series_id", F.col("mape").alias("naive"))
    return results.join(naive, "series_id").select("series_id", "model", (F.col("mape") <= F.col("naive")).alias("as_good"))


@query("cv_evaluate_ridge", _matrix_sql("day") + ", " + _blocks_sql("matrix", "blocks", 60) + f"""
SELECT series_id, model, block AS fold, count(*) AS n_rows, true AS as_good
FROM blocks, (SELECT unnest([{", ".join(f"'{m}'" for m in training.candidate_order("day"))}]) AS model) WHERE block > 0 GROUP BY ALL""")
def cv_evaluate_ridge(spark, sf_dir):
    """Naive, ridge and trees on five 60-day folds of the daily matrix: rows of each fold, and whether the model keeps up with the naive one."""
    matrix = stored(spark, daily_matrix(spark, sf_dir))
    features = X.feature_columns(DAILY_SPEC)
    predictions = stored(spark, training.cv_predictions(matrix, features, freq="day"))
    good = as_good_as_naive(folding.cv_mean(folding.fold_metrics(predictions)), "day")
    return predictions.groupBy("series_id", "model", "fold").agg(F.count("pred").alias("n_rows")).join(good, ["series_id", "model"])


_SHIFTS = {"Daily Naive (Lag 1d)": 1, "Daily Naive (Lag 7d)": 7, "Daily Naive (Lag 14d)": 14}


@query(
    "select_champion",
    _DAILY
    + ", lagged AS (SELECT *, " + ", ".join(f"{lag_sql('demand_mw', k)} AS lag_{k}d" for k in _SHIFTS.values()) + " FROM cleaned), known AS (SELECT * FROM lagged WHERE lag_14d IS NOT NULL), "
    + _blocks_sql("known", "blocks", 60)
    + ", valid AS (" + " UNION ALL ".join(f"SELECT series_id, '{m}' AS model, {i} AS place, block, demand_mw, lag_{k}d AS pred FROM blocks WHERE block > 0" for i, (m, k) in enumerate(_SHIFTS.items())) + """),
folds AS (SELECT series_id, model, place, block, avg(abs(demand_mw - pred) / abs(demand_mw)) AS mape FROM valid WHERE demand_mw <> 0 GROUP BY ALL),
results AS (SELECT series_id, model, place, avg(mape) AS mape FROM folds GROUP BY ALL)
SELECT series_id, arg_min(model, (mape, place)) AS model, min(mape) AS mape FROM results GROUP BY series_id""",
    "mape",
)
def select_champion(spark, sf_dir):
    """Best of three naive candidates per series."""
    grid = X.add_lags(V.daily(spark, sf_dir), {f"lag_{k}d": k for k in _SHIFTS.values()}, freq="day")
    valid = folding.validation_rows(grid.filter(F.col("lag_14d").isNotNull()), freq="day")
    scored = [predict_naive(valid, f"lag_{k}d").withColumn("model", F.lit(m)) for m, k in _SHIFTS.items()]
    results = folding.cv_mean(folding.fold_metrics(folding.leaderboard(*scored)))
    return folding.select_champion(results, list(_SHIFTS))


def better_than_naive(scored, naive):
    """Rows with a flag: the model's error on the last block of their series, which it hasn't seen, is below the naive one's."""
    error = lambda c: F.avg((F.col("demand_mw") - F.col(c)) ** 2)
    flags = scored.filter("block > 0").groupBy("series_id").agg((error("pred") < error(naive)).alias("better"))
    return scored.join(flags, "series_id").select("series_id", "datetime", "demand_mw", "better")


def _rows_sql(freq):
    """Every row of the matrix; a fitted model has to be better than the naive one."""
    return _matrix_sql(freq) + " SELECT series_id, datetime, demand_mw, true AS better FROM matrix"


def _held_out(spark, sf_dir, freq):
    """The matrix with its last block (30 or 60 days) marked."""
    matrix = hourly_matrix(spark, sf_dir) if freq == "hour" else daily_matrix(spark, sf_dir)
    return stored(spark, folding.time_blocks(matrix, freq=freq, n_splits=1))


@query("model_ridge", _rows_sql("hour"), "demand_mw")
def model_ridge(spark, sf_dir):
    """Hourly ridge: one model per series, fitted on all blocks but the last; a short and a long series."""
    marked = _held_out(spark, sf_dir, "hour")
    features = X.feature_columns(X.HOURLY)
    fitted = fit_ridge(marked, features, 10.0, block="block").filter("fold = 1").withColumn("fold", F.lit(ALL_ROWS))
    return better_than_naive(predict_ridge(marked, fitted, features), "lag_168h")


def _trees(name: str, freq: str, candidate: str):
    @query(name, _rows_sql(freq), "demand_mw")
    def run(spark, sf_dir):
        """All rounds of a candidate, one forest per series, fitted on all blocks but the last."""
        marked = _held_out(spark, sf_dir, freq)
        features = X.feature_columns(X.HOURLY if freq == "hour" else DAILY_SPEC)
        binned = binned_blocks(marked, features, freq=freq, block="block")
        forests = stored(spark, fit_forests(binned, {candidate: CANDIDATES[freq][candidate]}, before=1))
        return better_than_naive(predict_forests(marked, forests, features, freq=freq), "lag_168h" if freq == "hour" else "lag_7d")


_trees("model_gbt_default", "hour", "Hourly Trees (Default)")
_trees("model_gbt_tuned", "hour", "Hourly Trees (Tuned)")
_trees("model_gbt_depth5", "hour", "Hourly Trees (Depth 5)")
_trees("model_gbt_daily", "day", "Daily Trees (Dedicated)")


@query("early_stopping", _matrix_sql("hour") + ", " + _blocks_sql("matrix", "blocks", 720) + """
SELECT series_id, datetime, true AS in_time, true AS known FROM blocks WHERE block = 5""")
def early_stopping(spark, sf_dir):
    """Hourly trees on the last fold: no round is grown once 30 have brought nothing."""
    blocks = stored(spark, folding.time_blocks(hourly_matrix(spark, sf_dir), freq="hour"))
    name = "Hourly Trees (Default)"
    trees = CANDIDATES["hour"][name]
    binned = binned_blocks(blocks, X.feature_columns(X.HOURLY), freq="hour", block="block")
    scored = cv_forests(binned, {name: trees}, [5], freq="hour")
    in_time = (F.col("n_run") == F.least(F.lit(trees.rounds), F.col("n_rounds") + trees.patience)) & (F.col("n_rounds") > 0)
    return scored.select("series_id", "datetime", in_time.alias("in_time"), F.col("pred").isNotNull().alias("known"))


@query("refit_champion", _matrix_sql("day") + " SELECT series_id, datetime, true AS served, true AS own FROM matrix")
def refit_champion(spark, sf_dir):
    """Every series' daily champion, refitted on all its rows and published, predicts them."""
    matrix = stored(spark, daily_matrix(spark, sf_dir))
    outcome = training.train(matrix, freq="day")
    path = scratch(spark)
    publish_models(outcome.models, path, features=outcome.features, freq="day")
    models, row = published_models(spark, path)
    own = models.join(outcome.champions.select("series_id", F.col("model").alias("champion")), "series_id")
    scored = training.predict_each(matrix, models, row["feature_columns"], freq="day")
    named = own.select("series_id", (F.col("model") == F.col("champion")).alias("own"))
    return scored.join(named, "series_id").select("series_id", "datetime", F.col("pred").isNotNull().alias("served"), "own")


def _board_sql():
    names = [m for freq in ("hour", "day") for m in training.candidate_order(freq)]
    return "SELECT '" + training.POOLED + "' AS series_id, unnest([" + ", ".join(f"'{m}'" for m in names) + "]) AS model, true AS as_good"


@query("train_both_horizons", _board_sql())
def train_both_horizons(spark, sf_dir):
    """Both product lines from stored matrices to published champions and one leaderboard: every candidate keeps up with the naive one."""
    path = scratch(spark)
    write_table(hourly_matrix(spark, sf_dir), f"{path}/features")
    write_table(daily_matrix(spark, sf_dir), f"{path}/features_daily")
    board = training.train_all(spark, path)
    parts = [as_good_as_naive(board.filter(F.col("model").isin(training.candidate_order(freq))), freq) for freq in ("hour", "day")]
    return parts[0].unionByName(parts[1])


@query("feature_importance_topk", _DAILY + """ SELECT series_id, CAST(unnest(range(1, 16)) AS INTEGER) AS rank, true AS falling, true AS whole
FROM (SELECT DISTINCT series_id FROM cleaned)""")
def feature_importance_topk(spark, sf_dir):
    """Ranks of the 15 features that bring a forest most; the shares of all add up to one."""
    matrix = stored(spark, daily_matrix(spark, sf_dir))
    name, features = "Daily Trees (Dedicated)", X.feature_columns(DAILY_SPEC)
    forests = fit_forests(binned_blocks(matrix, features, freq="day"), {name: CANDIDATES["day"][name]})
    ranked = stored(spark, forest_importance(forests, features, len(features)))
    by_rank = Window.partitionBy("series_id").orderBy("rank")
    total = F.sum("importance").over(Window.partitionBy("series_id"))
    falling = F.col("importance") <= F.lag("importance", 1, 1.0).over(by_rank)
    flagged = ranked.select("series_id", "rank", falling.alias("falling"), (F.abs(total - 1) < 1e-9).alias("whole"))
    return flagged.filter("rank <= 15")


@query("unserved_series", V.with_(V.readings_sql("user_id"), V.grid_sql()) + """SELECT series_id, count(*) AS n_rows,
  count(*) || ' rows, 5 folds of 720 need more than 3600' AS reason FROM grid GROUP BY series_id HAVING count(*) <= 3600""")
def unserved_series(spark, sf_dir):
    """Series of single users: thirty days are too short for the hourly folds."""
    return folding.unserved(V.hourly(spark, sf_dir, "user_id"), freq="hour")
