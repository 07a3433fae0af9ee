"""Metrics and error diagnostics of the naive hourly forecast."""

from __future__ import annotations

from catalog import views as V
from catalog.features import holiday_join_sql, lag_sql
from catalog.models import hourly_naive, metrics_sql
from catalog.registry import query
from pyspark.sql import functions as F
from wattline.models.naive import predict_naive
from wattline.operators import features as X
from wattline.operators import metrics as M
from wattline.operators.holidays import add_holiday_features

_PAIRS = V.with_(V.clean_sql()) + f""", pairs AS (
  SELECT series_id, datetime, demand_mw AS y_true, {lag_sql('demand_mw', 168)} AS y_pred FROM cleaned),
used AS (SELECT * FROM pairs WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND y_true <> 0) """


def pairs(spark, sf_dir):
    grid = X.add_lags(V.cleaned(spark, sf_dir), {"y_pred": 168}, freq="hour")
    return grid.select("series_id", "datetime", F.col("demand_mw").alias("y_true"), "y_pred")


@query("metric_mask", _PAIRS + "SELECT * FROM used", "y_true y_pred")
def metric_mask(spark, sf_dir):
    return M.usable_pairs(pairs(spark, sf_dir))


def _single(metric: str):
    @query(f"metric_{metric}", _PAIRS + f"SELECT series_id, {metrics_sql('y_true', 'y_pred', (metric,))} FROM used GROUP BY series_id", metric)
    def run(spark, sf_dir):
        return M.metrics(pairs(spark, sf_dir), ["series_id"], only=[metric])


for _metric in M.METRICS:
    _single(_metric)


@query("metric_all", _PAIRS + f"SELECT series_id, {metrics_sql('y_true', 'y_pred')} FROM used GROUP BY series_id", " ".join(M.METRICS))
def metric_all(spark, sf_dir):
    return M.metrics(pairs(spark, sf_dir), ["series_id"])


@query("metric_horizon_segments", _PAIRS + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY datetime) AS r FROM pairs WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
segments AS (SELECT * FROM (VALUES ('Next-Day (1-24h)', 24), ('Next-Week (1-168h)', 168), ('Next-Month (1-720h)', 720)) t(segment, n)),
parts AS (SELECT segment, n.* FROM numbered n JOIN segments s ON r <= s.n),
sizes AS (SELECT series_id, segment, count(*) AS n_observations FROM parts GROUP BY 1, 2),
scores AS (SELECT series_id, segment, {metrics_sql('y_true', 'y_pred')} FROM parts WHERE y_true <> 0 GROUP BY 1, 2)
SELECT c.*, n_observations FROM scores c JOIN sizes z ON c.series_id = z.series_id AND c.segment = z.segment""", " ".join(M.METRICS))
def metric_horizon_segments(spark, sf_dir):
    return M.horizon_segments(pairs(spark, sf_dir))


_NAN_SQL = _PAIRS.split(", pairs AS")[0] + f""", pairs AS (
  SELECT series_id, datetime, demand_mw AS y_true, {lag_sql('demand_mw', 168)} AS y_pred FROM cleaned),
used AS (SELECT * FROM pairs WHERE y_pred IS NOT NULL AND y_true <> 0 AND hour(datetime) NOT IN (3, 5)) """


@query("metric_nan", _NAN_SQL + f"SELECT series_id, {metrics_sql('y_true', 'y_pred')} FROM used GROUP BY series_id", " ".join(M.METRICS))
def metric_nan(spark, sf_dir):
    """NaN predictions at three and NaN readings at five o'clock count as missing."""
    nan = F.lit(float("nan"))
    marked = pairs(spark, sf_dir).withColumns({"y_pred": F.when(F.hour("datetime") == 3, nan).otherwise(F.col("y_pred")), "y_true": F.when(F.hour("datetime") == 5, nan).otherwise(F.col("y_true"))})
    return M.metrics(marked, ["series_id"])


_DAILY = V.with_(V.clean_sql(V.ORDERS_SQL, "day"))


@query("holdout_tail", _DAILY + "SELECT series_id, datetime, demand_mw FROM cleaned QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) <= 1440", "demand_mw")
def holdout_tail(spark, sf_dir):
    return M.tail(V.daily(spark, sf_dir), M.HOLDOUT_ROWS, freq="day").select("series_id", "datetime", "demand_mw")


@query("holdout_naive", _DAILY + f""", shifted AS (SELECT *, {lag_sql('demand_mw', 168)} AS pred FROM cleaned),
held AS (SELECT * FROM shifted WHERE pred IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) <= 1440)
SELECT series_id, {metrics_sql('demand_mw', 'pred', ('mape', 'mae'))} FROM held WHERE demand_mw <> 0 GROUP BY series_id""", "mape mae")
def holdout_naive(spark, sf_dir):
    """Value 168 steps ago on the last 1,440 steps of the daily series."""
    grid = X.add_lags(V.daily(spark, sf_dir), {"pred": 168}, freq="day").filter(F.col("pred").isNotNull())
    held = M.tail(grid, M.HOLDOUT_ROWS, freq="day")
    return M.metrics(held, ["series_id"], "demand_mw", "pred", only=("mape", "mae"))


_RESIDUALS = V.with_(V.clean_sql(V.MIXED_SQL)) + f""", predicted AS (
  SELECT * FROM (SELECT *, {lag_sql('demand_mw', 168)} AS pred FROM cleaned) WHERE pred IS NOT NULL),
res AS (SELECT series_id, datetime, demand_mw, pred, pred - demand_mw AS residual,
  CASE WHEN demand_mw <> 0 THEN abs(pred - demand_mw) / demand_mw * 100 END AS abs_pct_error FROM predicted)"""


def residual_rows(spark, sf_dir):
    return M.residuals(predict_naive(hourly_naive(spark, sf_dir)))


@query("residuals", _RESIDUALS + " SELECT * FROM res", "demand_mw pred residual abs_pct_error")
def residuals(spark, sf_dir):
    return residual_rows(spark, sf_dir).select("series_id", "datetime", "demand_mw", "pred", "residual", "abs_pct_error")


@query("residual_summary", _RESIDUALS + " SELECT series_id, count(*) AS n_residuals, avg(residual) AS residual_mean, stddev_samp(residual) AS residual_std FROM res GROUP BY series_id", "residual_mean residual_std")
def residual_summary(spark, sf_dir):
    return M.residual_summary(residual_rows(spark, sf_dir))


@query("residual_histogram", _RESIDUALS + """, ends AS (SELECT series_id, min(residual) AS lo, max(residual) AS hi FROM res GROUP BY 1),
bins AS (SELECT series_id, lo, hi, CAST(unnest(generate_series(1, 40)) AS INTEGER) AS bin FROM ends),
counted AS (SELECT r.series_id, least(CAST(floor((residual - lo) / ((hi - lo) / 40)) AS INTEGER) + 1, 40) AS bin, count(*) AS n
  FROM res r JOIN ends e ON r.series_id = e.series_id GROUP BY 1, 2)
SELECT b.series_id, b.bin, lo + (hi - lo) / 40 * (b.bin - 1) AS bin_start, lo + (hi - lo) / 40 * b.bin AS bin_end, coalesce(n, 0) AS n
FROM bins b LEFT JOIN counted c ON b.series_id = c.series_id AND b.bin = c.bin""", "bin_start bin_end")
def residual_histogram(spark, sf_dir):
    return M.residual_histogram(residual_rows(spark, sf_dir))


_BY_HOUR = _RESIDUALS + ", by_hour AS (SELECT series_id, CAST(hour(datetime) AS INTEGER) AS hour, avg(abs_pct_error) AS mape FROM res GROUP BY 1, 2)"


@query("mape_by_hour", _BY_HOUR + " SELECT * FROM by_hour", "mape")
def mape_by_hour(spark, sf_dir):
    return M.mape_by_hour(residual_rows(spark, sf_dir))


@query("mape_worst_best_hour", _BY_HOUR + """ SELECT series_id, arg_max(hour, (round(mape, 9), -hour)) AS worst_hour, max(mape) AS worst_mape,
  arg_min(hour, (round(mape, 9), hour)) AS best_hour, min(mape) AS best_mape FROM by_hour GROUP BY series_id""", "worst_mape best_mape")
def mape_worst_best_hour(spark, sf_dir):
    return M.worst_and_best_hour(M.mape_by_hour(residual_rows(spark, sf_dir)))


@query("mape_by_holiday", _RESIDUALS + ", " + V.holidays_sql() + ", " + holiday_join_sql("res", "marked") + """
SELECT series_id, coalesce(avg(abs_pct_error) FILTER (is_holiday = 0), 0) AS regular_mape,
  coalesce(avg(abs_pct_error) FILTER (is_holiday = 1), 0) AS holiday_mape FROM marked GROUP BY series_id""", "regular_mape holiday_mape")
def mape_by_holiday(spark, sf_dir):
    return M.mape_by_holiday(add_holiday_features(residual_rows(spark, sf_dir), V.holidays(spark), country="IN"))

