"""Calendar, lag, rolling and assembled features."""

from __future__ import annotations

from functools import reduce

from catalog import views as V
from catalog.registry import query, scratch
from pyspark.sql import functions as F
from wattline.functions.calendar import fourier_columns, temporal_columns
from wattline.operators import features as X
from wattline.operators.explore import ramp
from wattline.operators.holidays import add_holiday_features
from wattline.operators.resample import resample_mean
from wattline.plans.tables import build_features
from wattline.sources.files import write_table

# --- SQL of the single features ----------------------------------------------------

_DOW = "CAST(isodow(datetime) - 1 AS INTEGER)"
_DOY = "CAST(dayofyear(datetime) AS INTEGER)"
TEMPORAL_SQL = {
    "hour": "CAST(hour(datetime) AS INTEGER)",
    "is_peak_hour": "CAST(hour(datetime) BETWEEN 9 AND 11 OR hour(datetime) BETWEEN 18 AND 22 AS INTEGER)",
    "is_night_valley": "CAST(hour(datetime) BETWEEN 1 AND 5 AS INTEGER)",
    "day_of_week": _DOW,
    "day_of_month": "CAST(day(datetime) AS INTEGER)",
    "day_of_year": _DOY,
    "week_of_year": "CAST(weekofyear(datetime) AS INTEGER)",
    "month": "CAST(month(datetime) AS INTEGER)",
    "quarter": "CAST(quarter(datetime) AS INTEGER)",
    "year": "CAST(year(datetime) AS INTEGER)",
    "season": "CAST((month(datetime) % 12) // 3 + 1 AS INTEGER)",
    "annual_position": "dayofyear(datetime) / 365.25",
}
FOURIER_SQL = {
    f"{fn}_{name}": f"{fn}(2 * pi() * {part} / {period})"
    for name, part, period in (("hour", "hour(datetime)", "24.0"), ("week", f"{_DOW}", "7.0"), ("year", "dayofyear(datetime)", "365.25"))
    for fn in ("sin", "cos")
}
HOLIDAY_COLUMNS = ("is_weekend", "is_holiday", "is_pre_holiday", "is_post_holiday", "is_working_day", "days_until_holiday", "days_since_holiday")


def holiday_join_sql(source: str, name: str) -> str:
    """Holiday features of each row by looking at all holidays of its date."""
    return f"""{name}_days AS (
  SELECT d, min(CASE WHEN holiday_date >= d THEN holiday_date - d END) AS ahead, min(CASE WHEN holiday_date <= d THEN d - holiday_date END) AS behind,
         CAST(max(CASE WHEN holiday_date = d THEN 1 ELSE 0 END) AS INTEGER) AS is_holiday,
         CAST(max(CASE WHEN holiday_date = d + 1 THEN 1 ELSE 0 END) AS INTEGER) AS is_pre_holiday,
         CAST(max(CASE WHEN holiday_date = d - 1 THEN 1 ELSE 0 END) AS INTEGER) AS is_post_holiday
  FROM (SELECT DISTINCT CAST(datetime AS DATE) AS d FROM {source}), holidays GROUP BY d),
{name} AS (
  SELECT s.*, CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend, is_holiday, is_pre_holiday, is_post_holiday,
         CAST(isodow(datetime) < 6 AND is_holiday = 0 AS INTEGER) AS is_working_day,
         CAST(least(coalesce(ahead, 30), 30) AS DOUBLE) AS days_until_holiday, CAST(least(coalesce(behind, 30), 30) AS DOUBLE) AS days_since_holiday
  FROM {source} s JOIN {name}_days x ON CAST(s.datetime AS DATE) = x.d)"""


_ORDERS = V.with_(V.ORDERS_SQL, V.grid_sql("day"))
_HOURS = V.with_(V.readings_sql(), V.grid_sql())


def _orders_grid(spark, sf_dir):
    return resample_mean(V.order_readings(spark, sf_dir), freq="day").select("series_id", "datetime")


def _hours_grid(spark, sf_dir):
    return V.hourly(spark, sf_dir).select("series_id", "datetime")


def _calendar(name: str, columns: list[str], freq: str):
    """Register calendar columns: hourly ones on events, the others on seven years of orders."""
    source = _HOURS if freq == "hour" else _ORDERS
    texts = TEMPORAL_SQL | FOURIER_SQL
    sql = source + "SELECT series_id, datetime, " + ", ".join(f"{texts[c]} AS {c}" for c in columns) + " FROM grid"
    doubles = " ".join(c for c in columns if c in FOURIER_SQL or c == "annual_position")

    @query(name, sql, doubles)
    def run(spark, sf_dir):
        grid = _hours_grid(spark, sf_dir) if freq == "hour" else _orders_grid(spark, sf_dir)
        made = temporal_columns("hour") | fourier_columns("hour")
        return grid.select("series_id", "datetime", *[made[c].alias(c) for c in columns])


_calendar("feat_hour", ["hour"], "hour")
_calendar("feat_peak_hour", ["is_peak_hour"], "hour")
_calendar("feat_night_valley", ["is_night_valley"], "hour")
_calendar("feat_day_parts", ["day_of_week", "day_of_month", "day_of_year", "week_of_year"], "day")
_calendar("feat_month_parts", ["month", "quarter", "year"], "day")
_calendar("feat_season", ["season"], "day")
_calendar("feat_annual_position", ["annual_position"], "day")
_calendar("feat_fourier_hour", ["sin_hour", "cos_hour"], "hour")
_calendar("feat_fourier_week", ["sin_week", "cos_week"], "day")
_calendar("feat_fourier_year", ["sin_year", "cos_year"], "day")


def _holiday(name: str, columns: list[str]):
    sql = _ORDERS + ", " + V.holidays_sql() + ", " + holiday_join_sql("grid", "marked")
    sql += " SELECT series_id, datetime, " + ", ".join(columns) + " FROM marked"

    @query(name, sql)
    def run(spark, sf_dir):
        out = add_holiday_features(_orders_grid(spark, sf_dir), V.holidays(spark), country="IN")
        return out.select("series_id", "datetime", *columns)


_holiday("feat_weekend", ["is_weekend"])
_holiday("feat_holiday", ["is_holiday"])
_holiday("feat_pre_post_holiday", ["is_pre_holiday", "is_post_holiday"])
_holiday("feat_working_day", ["is_working_day"])
_holiday("feat_holiday_distance", ["days_until_holiday", "days_since_holiday"])

_ALL_CALENDAR = [*TEMPORAL_SQL, *FOURIER_SQL]


@query(
    "feat_temporal_all",
    _HOURS + ", " + V.holidays_sql() + ", " + holiday_join_sql("grid", "marked")
    + " SELECT series_id, datetime, " + ", ".join(f"{c} AS {n}" for n, c in (TEMPORAL_SQL | FOURIER_SQL).items())
    + ", " + ", ".join(HOLIDAY_COLUMNS) + " FROM marked",
    " ".join([*FOURIER_SQL, "annual_position"]),
)
def feat_temporal_all(spark, sf_dir):
    return X.add_calendar_features(_hours_grid(spark, sf_dir), V.holidays(spark), freq="hour", country="IN")


# --- lags and rolling frames -------------------------------------------------------

_HOURLY = V.with_(V.clean_sql())
_DAILY = V.with_(V.clean_sql(V.ORDERS_SQL, "day"))


def lag_sql(column: str, k: int) -> str:
    return f"lag({column}, {k}) OVER (PARTITION BY series_id ORDER BY i)"


def roll_sql(column: str, stat: str, width: int) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    over = f"OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({column}) {over} = {width} THEN {fn}({column}) {over} END"


def _select(columns: dict[str, str], source: str = "cleaned") -> str:
    return "SELECT series_id, datetime, " + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + f" FROM {source}"


def _lags(name: str, prefix: str, lags: dict[str, int], freq: str, value: str = "demand_mw"):
    sql = prefix + _select({n: lag_sql(value, k) for n, k in lags.items()})

    @query(name, sql, " ".join(lags))
    def run(spark, sf_dir):
        grid = V.mixed(spark, sf_dir) if freq == "hour" else V.daily(spark, sf_dir)
        return X.add_lags(grid, lags, value=value, freq=freq).select("series_id", "datetime", *lags)


def _rolls(name: str, prefix: str, frames: list[tuple[str, str, int]], freq: str, value: str = "demand_mw"):
    sql = prefix + _select({n: roll_sql(value, s, w) for n, s, w in frames})

    @query(name, sql, " ".join(n for n, _, _ in frames))
    def run(spark, sf_dir):
        grid = {"hour": V.cleaned, "day": V.daily, "mixed": V.mixed}[freq](spark, sf_dir)
        out = X.add_rolling(grid, frames, value=value, freq="day" if freq == "day" else "hour")
        return out.select("series_id", "datetime", *[n for n, _, _ in frames])


_lags("lag_hourly", V.with_(V.clean_sql(V.MIXED_SQL)), {f"lag_{k}h": k for k in X.HOURLY.lags}, "hour")
_lags("lag_daily", _DAILY, {f"lag_{k}d": k for k in X.DAILY.lags}, "day")
_rolls("roll_24h", _HOURLY, [(f"rolling_{s}_24h", s, 24) for s in X.STATS], "hour")
_rolls("roll_168h", _HOURLY, [(f"rolling_{s}_168h", s, 168) for s in X.STATS], "hour")
# The events cover 720 hours, so the 720-hour frame runs over the line items.
_rolls("roll_720h", V.with_(V.clean_sql(V.MIXED_SQL)), [(f"rolling_{s}_720h", s, 720) for s in X.STATS], "mixed")
_rolls("roll_7d", _DAILY, [(f"rolling_{s}_7d", s, 7) for s in X.STATS], "day")
_rolls("roll_14d", _DAILY, [(f"rolling_{s}_14d", s, 14) for s in ("mean", "std")], "day")
_rolls("roll_30d", _DAILY, [(f"rolling_{s}_30d", s, 30) for s in X.STATS], "day")


@query(
    "lag_hourly_annual",
    V.with_(V.SHIP_SQL, V.grid_sql(values=["demand_mw"]))
    + """SELECT series_id, datetime, CASE WHEN count(*) OVER (PARTITION BY series_id) >= 8860 THEN """
    + lag_sql("demand_mw", 8760)
    + " END AS lag_8760h FROM grid",
    "lag_8760h",
)
def lag_hourly_annual(spark, sf_dir):
    """Ship dates on an hourly grid of seven years."""
    grid = resample_mean(V.ship_readings(spark, sf_dir), ["demand_mw"])
    spec = X.replace(X.HOURLY, lags=())
    return X.demand_lag_features(grid, freq="hour", spec=spec).select("series_id", "datetime", "lag_8760h")


@query(
    "lag_daily_annual",
    _DAILY + "SELECT series_id, datetime, CASE WHEN count(*) OVER (PARTITION BY series_id) >= 395 THEN " + lag_sql("demand_mw", 365) + " END AS lag_365d FROM cleaned",
    "lag_365d",
)
def lag_daily_annual(spark, sf_dir):
    spec = X.replace(X.DAILY, lags=())
    return X.demand_lag_features(V.daily(spark, sf_dir), freq="day", spec=spec).select("series_id", "datetime", "lag_365d")


def _ratio(name: str, prefix: str, freq: str):
    spec = X.SPECS[freq]
    column = f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean"
    sql = prefix + _select({column: f"{lag_sql('demand_mw', 1)} / ({roll_sql('demand_mw', 'mean', spec.ratio_window)} + 1e-5)"})

    @query(name, sql, column)
    def run(spark, sf_dir):
        grid = V.cleaned(spark, sf_dir) if freq == "hour" else V.daily(spark, sf_dir)
        out = X.demand_rolling_features(grid, freq=freq, spec=X.replace(spec, rolling=((spec.ratio_window, ("mean",)),)))
        return out.select("series_id", "datetime", column)


_ratio("roll_ratio_24h", _HOURLY, "hour")
_ratio("roll_ratio_7d", _DAILY, "day")


def weather_window_sql(spec: X.FeatureSpec) -> dict[str, str]:
    out = {n: lag_sql("temp_c", k) for n, k in spec.temp_lags}
    out |= {n: roll_sql("temp_c", "mean", w) for n, w in spec.temp_means}
    return out | {"humidity_rolling_mean": roll_sql("relative_humidity", "mean", spec.humidity_window)}


def _weather_windows(name: str, pick, freq: str):
    prefix, spec = (_HOURLY, X.HOURLY) if freq == "hour" else (_DAILY, X.DAILY)
    columns = {n: c for n, c in weather_window_sql(spec).items() if pick(n)}

    @query(name, prefix + _select(columns), " ".join(columns))
    def run(spark, sf_dir):
        grid = V.cleaned(spark, sf_dir) if freq == "hour" else V.daily(spark, sf_dir)
        return X.add_weather_features(grid, freq=freq).select("series_id", "datetime", *columns)


_weather_windows("temp_lag", lambda n: n.startswith("temp_lag"), "hour")
_weather_windows("temp_lag_daily", lambda n: n.startswith("temp_lag"), "day")
_weather_windows("temp_roll", lambda n: n.startswith("temp_roll"), "hour")
_weather_windows("temp_roll_daily", lambda n: n.startswith("temp_roll"), "day")
_weather_windows("humidity_roll", lambda n: n.startswith("humidity"), "hour")
_weather_windows("humidity_roll_daily", lambda n: n.startswith("humidity"), "day")


@query("diff_ramp", _HOURLY + _select({"ramp_mw_hr": f"coalesce(demand_mw - {lag_sql('demand_mw', 1)}, 0.0)"}), "ramp_mw_hr")
def diff_ramp(spark, sf_dir):
    return ramp(V.cleaned(spark, sf_dir)).select("series_id", "datetime", "ramp_mw_hr")


@query("diff_day_over_day", _DAILY + _select({"change": f"coalesce(demand_mw - {lag_sql('demand_mw', 1)}, 0.0)"}), "change")
def diff_day_over_day(spark, sf_dir):
    return ramp(V.daily(spark, sf_dir), name="change", freq="day").select("series_id", "datetime", "change")


# --- matrices ----------------------------------------------------------------------

DERIVED_SQL = {
    "cdd": "greatest(temp_c - 18.33, 0.0)",
    "hdd": "greatest(18.33 - temp_c, 0.0)",
    "cdd_sq": "greatest(temp_c - 18.33, 0.0) * greatest(temp_c - 18.33, 0.0)",
    "heat_index_c": """CASE WHEN temp_c * 1.8 + 32 >= 80 THEN (-42.379 + 2.04901523 * (temp_c * 1.8 + 32) + 10.14333127 * relative_humidity
      - 0.22475541 * (temp_c * 1.8 + 32) * relative_humidity - 0.00683783 * (temp_c * 1.8 + 32) ** 2 - 0.05481717 * relative_humidity ** 2
      + 0.00122874 * (temp_c * 1.8 + 32) ** 2 * relative_humidity + 0.00085282 * (temp_c * 1.8 + 32) * relative_humidity ** 2
      - 0.00000199 * (temp_c * 1.8 + 32) ** 2 * relative_humidity ** 2 - 32) / 1.8 ELSE temp_c END""",
    "temp_humidity_interaction": "temp_c * relative_humidity / 100",
}


def matrix_sql(spec: X.FeatureSpec, source: str = "cleaned", drop_na: bool = True) -> str:
    """CTEs ending in ``matrix``: all features of ``spec``."""
    windows = {spec.lag_name(k): lag_sql("demand_mw", k) for k in spec.lags}
    if spec.with_annual:
        n, lag = "count(*) OVER (PARTITION BY series_id)", lag_sql("demand_mw", spec.annual_lag)
        used = f"{n} >= {spec.annual_min_rows} AND {n} >= 2 * {spec.annual_lag}" if drop_na else f"{n} >= {spec.annual_min_rows}"
        windows[spec.lag_name(spec.annual_lag)] = f"CASE WHEN {used} THEN {lag} {'ELSE 0.0' if drop_na else ''} END"
    windows |= {n: roll_sql("demand_mw", s, w) for n, s, w in X.rolling_names(spec)}
    windows[f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean"] = (
        f"{lag_sql('demand_mw', 1)} / ({roll_sql('demand_mw', 'mean', spec.ratio_window)} + 1e-5)"
    )
    windows |= weather_window_sql(spec)
    calendar = {n: c for n, c in (TEMPORAL_SQL | FOURIER_SQL).items() if n in X.feature_columns(spec)}
    plain = calendar | DERIVED_SQL
    known = " AND ".join(f"{n} IS NOT NULL" for n in ["demand_mw", *windows]) if drop_na else "true"
    return (
        V.holidays_sql()
        + f""", windowed AS (SELECT *, {", ".join(f"{c} AS {n}" for n, c in windows.items())} FROM {source}),
known AS (SELECT * FROM windowed WHERE {known}),
{holiday_join_sql("known", "marked")},
matrix AS (SELECT *, {", ".join(f"{c} AS {n}" for n, c in plain.items())} FROM marked)"""
    )


def matrix_columns(spec: X.FeatureSpec) -> list[str]:
    return ["demand_mw", *X.feature_columns(spec)]


def matrix_doubles(spec: X.FeatureSpec) -> str:
    whole = {*TEMPORAL_SQL, *HOLIDAY_COLUMNS} - {"annual_position"}
    return " ".join(c for c in matrix_columns(spec) if c not in whole)


_MIXED = V.with_(V.clean_sql(V.MIXED_SQL))


def hourly_matrix(spark, sf_dir, drop_na=True):
    return X.feature_matrix(V.mixed(spark, sf_dir), V.holidays(spark), freq="hour", country="IN", drop_na=drop_na)


def daily_matrix(spark, sf_dir, drop_na=True, spec=X.DAILY):
    return X.feature_matrix(V.daily(spark, sf_dir), V.holidays(spark), freq="day", spec=spec, country="IN", drop_na=drop_na)


def _columns(spec):
    return "series_id, datetime, " + ", ".join(matrix_columns(spec))


@query("features_hourly", _MIXED + ", " + matrix_sql(X.HOURLY) + f" SELECT {_columns(X.HOURLY)} FROM matrix", matrix_doubles(X.HOURLY))
def features_hourly(spark, sf_dir):
    """All 61 features of a series of seven years and of one too short for the annual lag."""
    return hourly_matrix(spark, sf_dir)


@query("features_daily", _DAILY + ", " + matrix_sql(X.DAILY) + f" SELECT {_columns(X.DAILY)} FROM matrix", matrix_doubles(X.DAILY))
def features_daily(spark, sf_dir):
    return daily_matrix(spark, sf_dir)


@query("drop_sparse_annual_lag", _DAILY + ", " + matrix_sql(X.DAILY, drop_na=False) + """
SELECT count(*) AS n_rows, avg(CASE WHEN lag_365d IS NULL THEN 1.0 ELSE 0.0 END) AS null_share,
  avg(CASE WHEN lag_365d IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 AS kept FROM matrix""", "null_share")
def drop_sparse_annual_lag(spark, sf_dir):
    """Share of missing annual lags, and whether the column stays."""
    matrix = daily_matrix(spark, sf_dir, drop_na=False)
    kept = "lag_365d" in X.drop_sparse(matrix, "lag_365d").columns
    return X.null_share(matrix, "lag_365d").withColumn("kept", F.lit(kept))


_AT = "2001-06-20 07:00:00"


@query("features_at_step", _MIXED + ", " + matrix_sql(X.HOURLY, drop_na=False) + f" SELECT {_columns(X.HOURLY)} FROM matrix WHERE datetime = TIMESTAMP '{_AT}'", matrix_doubles(X.HOURLY))
def features_at_step(spark, sf_dir):
    return X.features_at(V.mixed(spark, sf_dir), V.holidays(spark), F.lit(_AT), freq="hour", country="IN")


# Rows left of each series: all but the reach of its longest lag.
_BUILD_SQL = V.with_(V.MIXED_SQL) + """, spans AS (
  SELECT date_diff('hour', min(datetime), max(datetime)) + 1 AS hours,
         date_diff('day', date_trunc('day', min(datetime)), date_trunc('day', max(datetime))) + 1 AS days FROM readings GROUP BY series_id)
SELECT 'hourly' AS matrix, CAST(sum(hours - CASE WHEN hours >= 17520 THEN 8760 ELSE 720 END) AS BIGINT) AS n_rows, 64 AS n_columns FROM spans
UNION ALL SELECT 'daily', CAST(sum(days - CASE WHEN days >= 730 THEN 365 ELSE 30 END) AS BIGINT), 53 FROM spans"""


@query("build_features", _BUILD_SQL)
def build(spark, sf_dir):
    """Stored grid to two stored matrices; rows and columns of each."""
    path = scratch(spark)
    write_table(V.mixed(spark, sf_dir), f"{path}/hourly_demand")
    tables = zip(("hourly", "daily"), build_features(spark, path, V.holidays(spark), country="IN"), strict=True)
    counts = [
        df.agg(F.lit(name).alias("matrix"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        for name, df in tables
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


_FEATURES = X.feature_columns(X.HOURLY)


@query("select_features", _MIXED + ", " + matrix_sql(X.HOURLY) + f" SELECT {', '.join(_FEATURES)} FROM matrix", " ".join(c for c in matrix_doubles(X.HOURLY).split() if c != "demand_mw"))
def select_features(spark, sf_dir):
    return X.select_features(hourly_matrix(spark, sf_dir))


@query("missing_feature_default", _HOURLY + "SELECT series_id, datetime, demand_mw, CAST(0.0 AS DOUBLE) AS lag_8760h FROM cleaned", "demand_mw")
def missing_feature_default(spark, sf_dir):
    out = X.require_features(V.cleaned(spark, sf_dir), ["demand_mw", "lag_8760h"], missing=0.0)
    return out.select("series_id", "datetime", "demand_mw", "lag_8760h")
