"""Scans, sinks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.forecasts import next_day_sql, next_day_unrounded
from catalog.models import CV_SQL, cv_results
from catalog.registry import query, scratch
from wattline.models.registry import load_model, save_model
from wattline.models.ridge import fit_ridge, predict_ridge
from wattline.plans.training import pooled_results
from wattline.sources import files, reports
from wattline.sources.weather import read_weather_payload

_ALL = "SELECT series_id, datetime, demand_mw, temp_c, relative_humidity FROM"


@query("scan_csv_mapped", V.with_(V.readings_sql()) + "SELECT series_id, datetime, demand_mw, temp_c FROM readings", "demand_mw temp_c")
def scan_csv_mapped(spark, sf_dir):
    """Readings written with foreign column names, read back through the column mapping."""
    path = scratch(spark)
    foreign = V.readings(spark, sf_dir).select(
        F.col("series_id").alias("zone"),
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("demand_mw").alias("load_mw"),
        F.col("temp_c").alias("temperature"),
        F.col("event_id").alias("note"),
    )
    files.write_csv(foreign, path)
    return files.read_csv_series(
        spark, path, date_col="timestamp", demand_col="load_mw", temp_col="temperature", series_col="zone"
    )


@query("scan_csv_missing", V.with_(V.readings_sql()) + """SELECT series_id, datetime, CASE WHEN event_id % 7 <> 0 THEN demand_mw END AS demand_mw,
  CASE WHEN event_id % 5 <> 0 THEN temp_c END AS temp_c FROM readings""", "demand_mw temp_c")
def scan_csv_missing(spark, sf_dir):
    """Marks for missing values in CSV files are nulls."""
    path = scratch(spark)
    rows = V.readings(spark, sf_dir)
    mark = F.element_at(F.array(*[F.lit(m) for m in ("NA", "NaN", "N/A", "null", "nan", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    marked = rows.select(
        "series_id",
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"),
        F.when(F.col("event_id") % 7 == 0, mark).otherwise(F.col("demand_mw").cast("string")).alias("demand_mw"),
        F.when(F.col("event_id") % 5 == 0, mark).otherwise(F.col("temp_c").cast("string")).alias("temp_c"),
    )
    files.write_csv(marked, path)
    return files.read_csv_series(spark, path, series_col="series_id")


@query("scan_csv_cached", V.with_(V.clean_sql()) + "SELECT series_id, datetime, demand_mw, temp_c, relative_humidity FROM cleaned", "demand_mw temp_c relative_humidity")
def scan_csv_cached(spark, sf_dir):
    """Stored series in canonical columns."""
    path = scratch(spark)
    files.write_csv(V.cleaned(spark, sf_dir), path)
    return files.read_cached_series(spark, path, series_col="series_id")


@query("scan_parquet", V.with_(V.readings_sql()) + f"{_ALL} readings", "demand_mw temp_c relative_humidity")
def scan_parquet(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("series_id"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("demand_mw"),
        (F.get_json_object("props", "$.k").cast("double") * 0.5).alias("temp_c"),
        (100.0 - F.get_json_object("props", "$.k").cast("double")).alias("relative_humidity"),
    )


_FORECAST_COLUMNS = (
    "forecast_mw, lower_bound_80, upper_bound_80, lower_bound_90, upper_bound_90, lower_bound_95, upper_bound_95, "
    "uncertainty_sigma_mw, datetime, hour, day_of_week, temp_c, relative_humidity, weather_source"
)


@query(
    "scan_forecast_csv",
    next_day_sql() + f"SELECT {_FORECAST_COLUMNS} FROM next_day",
    "forecast_mw lower_bound_80 upper_bound_80 lower_bound_90 upper_bound_90 lower_bound_95 upper_bound_95 uncertainty_sigma_mw",
)
def scan_forecast_csv(spark, sf_dir):
    """A written next-day product, read with its file schema."""
    path = scratch(spark)
    files.write_csv(next_day_unrounded(spark, sf_dir).select(*_FORECAST_COLUMNS.split(", ")), path)
    return files.read_forecast_csv(spark, path, "next_day")


@query("sink_parquet", V.with_(V.clean_sql()) + f"{_ALL} cleaned", "demand_mw temp_c relative_humidity")
def sink_parquet(spark, sf_dir):
    return files.read_table(spark, files.write_table(V.cleaned(spark, sf_dir), scratch(spark)))


@query("sink_csv", V.with_(V.clean_sql()) + f"{_ALL} cleaned", "demand_mw temp_c relative_humidity")
def sink_csv(spark, sf_dir):
    path = files.write_csv(V.cleaned(spark, sf_dir), scratch(spark), ["series_id", "datetime"])
    return spark.read.option("header", True).schema(f"series_id string, {files.SERIES_SCHEMA}").csv(path)


@query("sink_metrics_json", CV_SQL + " SELECT model, avg(mape) AS mape, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2, avg(wape) AS wape FROM results GROUP BY model", "mape mae rmse r2 wape")
def sink_metrics_json(spark, sf_dir):
    """Metrics per model over all series, written as one JSON object and read again."""
    path = reports.write_metrics_json(pooled_results(cv_results(spark, sf_dir)), scratch(spark))
    scores = F.from_json("value", "map<string, struct<mape: double, mae: double, rmse: double, r2: double, wape: double>>")
    return spark.read.text(path).select(F.explode(scores).alias("model", "scores")).select("model", "scores.*")


def _rounded_board(spark, sf_dir):
    board = cv_results(spark, sf_dir)
    return board.select("series_id", "model", *[F.round(m, 9).alias(m) for m in ("mape", "mae", "rmse", "r2", "wape")])


_BOARD_SQL = CV_SQL + """, board AS (
  SELECT series_id, model, round(mape, 9) AS mape, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(r2, 9) AS r2, round(wape, 9) AS wape
  FROM results)"""


@query(
    "sink_metrics_markdown",
    _BOARD_SQL
    + """ SELECT series_id, printf('| **%s** | %.2f%% | %.1f MW | %.1f MW | %.4f | %.2f%% |', model, mape * 100, mae, rmse, r2, wape * 100) AS value
  FROM board""",
)
def sink_metrics_markdown(spark, sf_dir):
    return reports.markdown_rows(_rounded_board(spark, sf_dir))


@query(
    "format_metrics_display",
    _BOARD_SQL
    + """ SELECT series_id, model, printf('%.2f%%', mape * 100) AS mape, printf('%.1f MW', mae) AS mae,
  printf('%.1f MW', rmse) AS rmse, printf('%.4f', r2) AS r2, printf('%.2f%%', wape * 100) AS wape FROM board""",
)
def format_metrics_display(spark, sf_dir):
    return reports.display_metrics(_rounded_board(spark, sf_dir))


@query("scan_weather_payload", V.with_(V.readings_sql(), V.grid_sql()) + "SELECT series_id, datetime, temp_c, relative_humidity, 'historical_reanalysis' AS weather_source FROM grid", "temp_c relative_humidity")
def scan_weather_payload(spark, sf_dir):
    """One payload per series and day (24 hours at most), unnested again."""
    hour = F.struct("datetime", "temp_c", "relative_humidity")
    days = V.hourly(spark, sf_dir).groupBy("series_id", F.to_date("datetime").alias("day")).agg(F.collect_list(hour).alias("h"))
    payload = F.struct(
        F.struct(
            F.transform("h", lambda x: F.date_format(x["datetime"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
            F.col("h.temp_c").alias("temperature_2m"),
            F.col("h.relative_humidity").alias("relative_humidity_2m"),
        ).alias("hourly")
    )
    payloads = days.select("series_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    return read_weather_payload(payloads, source="historical_reanalysis")


# Normal equations around the means, with the penalty 10 on the diagonal, solved for two features.
_TWO_SQL = V.with_(V.clean_sql()) + """, sums AS (SELECT series_id, avg(temp_c) AS m1, avg(relative_humidity) AS m2, avg(demand_mw) AS my,
  var_pop(temp_c) * count(*) + 10 AS s11, var_pop(relative_humidity) * count(*) + 10 AS s22, covar_pop(temp_c, relative_humidity) * count(*) AS s12,
  covar_pop(temp_c, demand_mw) * count(*) AS b1, covar_pop(relative_humidity, demand_mw) * count(*) AS b2 FROM cleaned GROUP BY series_id),
solved AS (SELECT *, (b1 * s22 - b2 * s12) / (s11 * s22 - s12 * s12) AS w1, (b2 * s11 - b1 * s12) / (s11 * s22 - s12 * s12) AS w2 FROM sums)
SELECT c.series_id, datetime, demand_mw, temp_c, relative_humidity, my + w1 * (temp_c - m1) + w2 * (relative_humidity - m2) AS pred,
  'Hourly Ridge Regression' AS model_name FROM cleaned c JOIN solved s ON c.series_id = s.series_id"""


@query("model_save_load", _TWO_SQL, "demand_mw temp_c relative_humidity pred")
def model_save_load(spark, sf_dir):
    """Ridge coefficients stored with their metadata, loaded and used."""
    features = ["temp_c", "relative_humidity"]
    grid = V.cleaned(spark, sf_dir)
    path = scratch(spark)
    scores = {"Hourly Ridge Regression": dict(mape=0.1, mae=1.0, rmse=1.0, r2=0.5, wape=0.1)}
    save_model(fit_ridge(grid, features, 10.0), path, features=features, metrics=scores, model_name="Hourly Ridge Regression")
    model, metadata = load_model(spark, path)
    out = predict_ridge(grid, model, metadata["feature_columns"])
    return out.withColumn("model_name", F.lit(metadata["model_name"]))


@query(
    "provenance_metadata",
    V.with_(V.readings_sql())
    + """SELECT series_id, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS n_rows,
  'real_recorded' AS data_provenance, 'events' AS dataset_name FROM readings GROUP BY series_id""",
)
def provenance_metadata(spark, sf_dir):
    return files.dataset_metadata(V.readings(spark, sf_dir), dataset_name="events")
