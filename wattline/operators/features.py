"""Leakage-safe lags, rolling statistics, weather features and the feature matrices.

All functions take a dense grid (one row per step and series) and look only at rows
before the current one. Everything that needs a window runs over one shared shuffle
and one sort, however many lags and frames there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattline.functions import weather as W
from wattline.functions.calendar import fourier_columns, fourier_names, temporal_columns, temporal_names
from wattline.names import BY, DEMAND, HUMIDITY, TEMP, TIME
from wattline.operators.chunks import CHUNK_STEPS, attach, windowed
from wattline.operators.holidays import add_holiday_features

STATS = ("mean", "std", "min", "max")


@dataclass(frozen=True)
class FeatureSpec:
    """Which lags and rolling frames a feature matrix has, in grid steps."""

    freq: str
    suffix: str
    lags: tuple[int, ...]
    annual_lag: int
    annual_min_rows: int
    rolling: tuple[tuple[int, tuple[str, ...]], ...]
    ratio_window: int
    temp_lags: tuple[tuple[str, int], ...]
    temp_means: tuple[tuple[str, int], ...]
    humidity_window: int
    with_annual: bool = True

    def lag_name(self, k: int) -> str:
        return f"lag_{k}{self.suffix}"

    def reach(self) -> int:
        widest = [*self.lags, *(w for w, _ in self.rolling), *(k for _, k in self.temp_lags), self.humidity_window]
        widest += [w for _, w in self.temp_means]
        if self.with_annual:
            widest.append(self.annual_lag)
        return max(widest)

    def limited(self, longest: int) -> FeatureSpec:
        """The same spec without lags and frames longer than ``longest`` steps."""
        return replace(
            self,
            lags=tuple(k for k in self.lags if k <= longest),
            rolling=tuple((w, s) for w, s in self.rolling if w <= longest),
            temp_lags=tuple((n, k) for n, k in self.temp_lags if k <= longest),
            temp_means=tuple((n, w) for n, w in self.temp_means if w <= longest),
            with_annual=self.with_annual and self.annual_lag <= longest,
        )


# Lags, frames and their names in the hourly and daily matrices.
HOURLY = FeatureSpec(
    freq="hour",
    suffix="h",
    lags=(1, 2, 3, 6, 12, 24, 48, 72, 168, 336, 720),
    annual_lag=8760,
    annual_min_rows=8760 + 100,
    rolling=((24, STATS), (168, STATS), (720, STATS)),
    ratio_window=24,
    temp_lags=(("temp_lag_24h", 24),),
    temp_means=(("temp_rolling_mean_24h", 24), ("temp_rolling_mean_7d", 168)),
    humidity_window=24,
)
DAILY = FeatureSpec(
    freq="day",
    suffix="d",
    lags=(1, 2, 3, 7, 14, 30),
    annual_lag=365,
    annual_min_rows=365 + 30,
    rolling=((7, STATS), (14, ("mean", "std")), (30, STATS)),
    ratio_window=7,
    temp_lags=(("temp_lag_1d", 1), ("temp_lag_7d", 7)),
    temp_means=(("temp_rolling_mean_7d", 7), ("temp_rolling_mean_30d", 30)),
    humidity_window=7,
)
SPECS = {"hour": HOURLY, "day": DAILY}


def add_temporal_features(df: DataFrame, *, freq: str, time: str = TIME) -> DataFrame:
    return df.withColumns(temporal_columns(freq, time))


def add_fourier_features(df: DataFrame, *, freq: str, time: str = TIME) -> DataFrame:
    return df.withColumns(fourier_columns(freq, time))


def add_calendar_features(
    df: DataFrame, holidays: DataFrame, *, freq: str, country: str | None = None, time: str = TIME
) -> DataFrame:
    """Temporal, holiday and cyclical features together."""
    out = add_temporal_features(df, freq=freq, time=time)
    out = add_holiday_features(out, holidays, country=country, time=time)
    return add_fourier_features(out, freq=freq, time=time)


def _lag_stage(value: str, names: dict[str, int]):
    def stage(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({name: F.lag(value, k).over(w) for name, k in names.items()})

    return stage


# (value column, result name, one of STATS, width in rows)
Frame = tuple[str, str, str, int]

_PAIRWISE = {"min": F.least, "max": F.greatest}


# Rows of one size that make up the next one.
RADIX = 4


def _blocks(width: int) -> list[int]:
    """Powers of ``RADIX`` that add up to ``width``, largest first."""
    power = 1
    while power * RADIX <= width:
        power *= RADIX
    out = []
    while width:
        while power > width:
            power //= RADIX
        out.append(power)
        width -= power
    return out


def _block_stage(frames: Sequence[Frame]):
    """The same statistics at a cost per row that hardly grows with the width.

    Sums and extremes over 4, 16, 64, ... rows are each made of four of the size before. A
    sum over any width is put together from such blocks side by side, a minimum or maximum
    from the largest ones, the last of which may overlap. Everything uses the one order the rows are already in, and sums
    are taken around the first reading, so that the deviation keeps its precision.
    """

    def stage(df: DataFrame, w: WindowSpec) -> DataFrame:
        keep = df.columns
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        values = list(dict.fromkeys(f[0] for f in frames))
        # Aggregates each column needs: sum, sum of squares, and the extremes. A constant
        # frame must have deviation 0, which sums only give approximately.
        needs = {
            "mean": {"sum"},
            "std": {"sum", "square", "min", "max"},
            "min": {"min"},
            "max": {"max"},
        }
        widest: dict[tuple[str, str], int] = {}
        for v, _, stat, width in frames:
            for part in needs[stat]:
                widest[v, part] = max(width, widest.get((v, part), 0))

        def level(v: str, part: str, size: int) -> str:
            return f"_{v}_{part}_{size}"

        def joined(part: str, left: Column, right: Column) -> Column:
            if part in _PAIRWISE:
                return _PAIRWISE[part](left, right)
            return left + F.coalesce(right, F.lit(0.0))

        first = {}
        for v in values:
            first |= {f"_{v}_pivot": F.first(v, True).over(so_far), f"_{v}_n": F.count(v).over(so_far)}
        out = df.withColumns(first)
        ones = {}
        for v, part in widest:
            centred = F.coalesce(F.col(v) - F.col(f"_{v}_pivot"), F.lit(0.0))
            ones[level(v, part, 1)] = {"sum": centred, "square": centred * centred}.get(part, F.col(v))
        out = out.withColumns(ones)
        size = 1
        while RADIX * size <= max(widest.values()):
            larger = {}
            for (v, part), width in widest.items():
                if RADIX * size <= width:
                    total = F.col(level(v, part, size))
                    for j in range(1, RADIX):
                        total = joined(part, total, F.lag(level(v, part, size), j * size).over(w))
                    larger[level(v, part, RADIX * size)] = total
            out = out.withColumns(larger)
            size *= RADIX

        pieces = {}
        for v, _, stat, width in frames:
            before = F.coalesce(F.lag(f"_{v}_n", width + 1).over(w), F.lit(0))
            pieces[f"_{v}_count_of_{width}"] = F.lag(f"_{v}_n", 1).over(w) - before
            for part in needs[stat]:
                if part in _PAIRWISE:
                    power = _blocks(width)[0]
                    offsets = [(power, 1 + at) for at in (*range(0, width - power, power), width - power)]
                else:
                    offsets, at = [], 1
                    for power in _blocks(width):
                        offsets.append((power, at))
                        at += power
                lagged = [F.lag(level(v, part, power), at).over(w) for power, at in offsets]
                total = lagged[0]
                for other in lagged[1:]:
                    total = joined(part, total, other)
                pieces[f"_{v}_{part}_of_{width}"] = total
        out = out.withColumns(pieces)

        results = {}
        for v, name, stat, width in frames:
            n, total, square, low, high = (
                F.col(f"_{v}_{part}_of_{width}") for part in ("count", "sum", "square", "min", "max")
            )
            if stat == "mean":
                result = F.col(f"_{v}_pivot") + total / width
            elif stat == "std":
                variance = (square - total * total / width) / (width - 1)
                result = F.when(low == high, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))
            else:
                result = low if stat == "min" else high
            results[name] = F.when(n == width, result)
        return out.select(*keep, *[c.alias(name) for name, c in results.items()])

    return stage


def rolling_stages(frames: Sequence[Frame]) -> list:
    """One algorithm at every width, so a frame's last bits don't depend on its companions."""
    return [_block_stage(frames)] if frames else []


def add_lags(df: DataFrame, names: dict[str, int], *, value: str = DEMAND, freq: str, **grid) -> DataFrame:
    """Add ``lag`` columns: name -> number of grid steps back."""
    return windowed(df, max(names.values()), _lag_stage(value, names), freq=freq, **grid)


def add_rolling(
    df: DataFrame, frames: Sequence[tuple[str, str, int]], *, value: str = DEMAND, freq: str, **grid
) -> DataFrame:
    """Statistics of the previous ``width`` rows, null unless all of them have a value.

    ``frames`` holds (column name, one of mean/std/min/max, width).
    """
    widest = max(width for _, _, width in frames)
    # One row more than the frame: the running count is lagged past its far end.
    return windowed(df, widest + 1, *rolling_stages([(value, *f) for f in frames]), freq=freq, **grid)


def rolling_names(spec: FeatureSpec) -> list[tuple[str, str, int]]:
    return [(f"rolling_{stat}_{w}{spec.suffix}", stat, w) for w, stats in spec.rolling for stat in stats]


def _ratio_stage(value: str, spec: FeatureSpec):
    mean = f"rolling_mean_{spec.ratio_window}{spec.suffix}"

    def stage(df: DataFrame, w: WindowSpec) -> DataFrame:
        ratio = F.lag(value, 1).over(w) / (F.col(mean) + F.lit(1e-5))
        return df.withColumn(f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean", ratio)

    return stage


def demand_lag_features(df: DataFrame, *, freq: str, spec: FeatureSpec | None = None, value: str = DEMAND, **grid) -> DataFrame:
    """The lags of the spec; the annual one is null in series that are too short for it."""
    spec = spec or SPECS[freq]
    names = {spec.lag_name(k): k for k in spec.lags}
    if spec.with_annual:
        names[spec.lag_name(spec.annual_lag)] = spec.annual_lag
    out = add_lags(df, names, value=value, freq=freq, **grid)
    return _only_long_series(out, spec, **grid)


def _only_long_series(df: DataFrame, spec: FeatureSpec, **grid) -> DataFrame:
    if not spec.with_annual:
        return df
    name = spec.lag_name(spec.annual_lag)
    counted = attach(df, [F.count(F.lit(1)).alias("_rows")], freq=spec.freq, **grid)
    return counted.withColumn(name, F.when(F.col("_rows") >= spec.annual_min_rows, F.col(name))).drop("_rows")


def _annual_where_used(df: DataFrame, spec: FeatureSpec, **grid) -> DataFrame:
    """Rows that know their annual lag, and all rows of series that don't use it, with 0 there.

    A series uses it if it has ``annual_min_rows`` rows and the lag reaches back over at
    most half of them. Elsewhere the column is constant, which leaves a linear model of that series as it is
    without the column (its coefficient is 0), and trees nothing to split on.
    """
    name = F.col(spec.lag_name(spec.annual_lag))
    counted = attach(df, [F.count(F.lit(1)).alias("_rows")], freq=spec.freq, **grid)
    used = (F.col("_rows") >= spec.annual_min_rows) & (F.col("_rows") >= 2 * spec.annual_lag)
    lag = F.when(used, name).otherwise(0.0)
    return counted.withColumn(spec.lag_name(spec.annual_lag), lag).drop("_rows")


def demand_rolling_features(
    df: DataFrame, *, freq: str, spec: FeatureSpec | None = None, value: str = DEMAND, **grid
) -> DataFrame:
    spec = spec or SPECS[freq]
    frames = rolling_names(spec)
    widest = max(w for _, _, w in frames) + 1
    stages = [*rolling_stages([(value, *f) for f in frames]), _ratio_stage(value, spec)]
    return windowed(df, widest, *stages, freq=freq, **grid)


def derived_weather_names(columns: Sequence[str]) -> list[str]:
    names = ["cdd", "hdd", "cdd_sq"] if TEMP in columns else []
    return names + (["heat_index_c", "temp_humidity_interaction"] if names and HUMIDITY in columns else [])


def derived_weather_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Degree days, heat index and temperature-humidity product, as far as inputs exist."""
    out: dict[str, Column] = {}
    t, rh = F.col(TEMP), F.col(HUMIDITY)
    if TEMP in columns:
        cdd = W.cooling_degrees(t)
        out |= {"cdd": cdd, "hdd": W.heating_degrees(t), "cdd_sq": cdd * cdd}
    if TEMP in columns and HUMIDITY in columns:
        out |= {"heat_index_c": W.heat_index(t, rh), "temp_humidity_interaction": W.temp_humidity(t, rh)}
    return out


def add_derived_weather(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_weather_columns(df.columns))


def _weather_windows(columns: Sequence[str], spec: FeatureSpec) -> tuple[list, list[Frame]]:
    """Lag stages and rolling frames of the weather columns that exist."""
    lags, frames = [], []
    if TEMP in columns:
        if spec.temp_lags:
            lags.append(_lag_stage(TEMP, dict(spec.temp_lags)))
        frames += [(TEMP, n, "mean", w) for n, w in spec.temp_means]
    if HUMIDITY in columns:
        frames.append((HUMIDITY, "humidity_rolling_mean", "mean", spec.humidity_window))
    return lags, frames


def add_weather_features(
    df: DataFrame, *, freq: str, spec: FeatureSpec | None = None, **grid
) -> DataFrame:
    """Derived weather, temperature lags, and rolling temperature and humidity means."""
    spec = spec or SPECS[freq]
    out = add_derived_weather(df)
    lags, frames = _weather_windows(df.columns, spec)
    stages = [*rolling_stages(frames), *lags]
    reach = max([k for _, k in spec.temp_lags] + [w for *_, w in frames], default=0)
    return windowed(out, reach + 1, *stages, freq=freq, **grid) if stages else out


def feature_matrix(
    df: DataFrame,
    holidays: DataFrame,
    *,
    freq: str,
    spec: FeatureSpec | None = None,
    country: str | None = None,
    drop_na: bool = True,
    by: Sequence[str] = BY,
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Temporal, holiday, cyclical, lag, rolling and weather features of a dense grid.

    The columns follow from ``spec`` and never from the data. With ``drop_na`` the rows
    without a complete history are dropped. Each series decides for itself whether it has
    an annual lag: many series in one table equal the union of single runs. In a series too
    short for it the column is 0 (with ``drop_na``) or null.
    """
    spec = spec or SPECS[freq]
    grid = dict(by=by, time=time, chunk_steps=chunk_steps)
    lags = {spec.lag_name(k): k for k in spec.lags}
    if spec.with_annual:
        lags[spec.lag_name(spec.annual_lag)] = spec.annual_lag
    weather_lags, frames = _weather_windows(df.columns, spec)
    frames = [(DEMAND, *f) for f in rolling_names(spec)] + frames
    stages = [*rolling_stages(frames), _lag_stage(DEMAND, lags), _ratio_stage(DEMAND, spec), *weather_lags]
    base = windowed(df, spec.reach() + 1, *stages, freq=freq, **grid)
    if not drop_na:
        base = _only_long_series(base, spec, **grid)
    elif spec.with_annual:
        base = _annual_where_used(base, spec, **grid)
    if drop_na:
        # Calendar columns are never null, and derived weather only where its inputs are.
        base = complete_rows(base)
    out = add_calendar_features(base, holidays, freq=freq, country=country, time=time)
    out = add_derived_weather(out)
    first = [*by, time, *[c for c in df.columns if c not in by and c != time]]
    out = out.select(*first, *[c for c in feature_columns(spec, df.columns) if c not in first])
    return out


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns``.

    One plain condition per column: ``dropna`` states a single condition over all of
    them, which the optimizer rewrites once per subset of computed columns.
    """
    for c in columns or df.columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def feature_columns(spec: FeatureSpec, inputs: Sequence[str] = (DEMAND, TEMP, HUMIDITY)) -> list[str]:
    """Feature names in matrix order; the target is not among them."""
    names = [c for c in (TEMP, HUMIDITY) if c in inputs]
    names += temporal_names(spec.freq)
    names += ["is_weekend", "is_holiday", "is_pre_holiday", "is_post_holiday", "is_working_day"]
    names += ["days_until_holiday", "days_since_holiday"]
    names += fourier_names(spec.freq)
    names += [spec.lag_name(k) for k in spec.lags]
    if spec.with_annual:
        names.append(spec.lag_name(spec.annual_lag))
    names += [name for name, _, _ in rolling_names(spec)]
    names.append(f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean")
    names += derived_weather_names(inputs)
    if TEMP in inputs:
        names += [n for n, _ in spec.temp_lags] + [n for n, _ in spec.temp_means]
    if HUMIDITY in inputs:
        names.append("humidity_rolling_mean")
    return names


def without_annual_gaps(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """0 for an annual lag that lies before the series, as models of short series expect."""
    name = spec.lag_name(spec.annual_lag)
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(0.0))) if spec.with_annual else df


def any_length(spec: FeatureSpec) -> FeatureSpec:
    """The spec for a piece of a series, whose length says nothing about the whole."""
    return replace(spec, annual_min_rows=0)


def null_share(df: DataFrame, column: str) -> DataFrame:
    """One row: number of rows and share of nulls in ``column``."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(column).isNull().cast("double")).alias("null_share"),
    )


def drop_sparse(df: DataFrame, column: str, most: float = 0.5) -> DataFrame:
    """Drop ``column`` if more than ``most`` of its rows are null.

    The schema depends on the answer, so this one scalar is computed eagerly; run it
    on a stored table.
    """
    if column not in df.columns:
        return df
    share = null_share(df, column).first()["null_share"]
    return df.drop(column) if share is not None and share > most else df


def select_features(df: DataFrame, *, target: str = DEMAND, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """All feature columns: neither the target nor the row keys."""
    return df.select(*[c for c in df.columns if c not in (*by, time, target)])


def require_features(df: DataFrame, names: Sequence[str], missing: float | None = None) -> DataFrame:
    """Raise if a feature is absent; with ``missing`` add it with that value instead."""
    absent = [c for c in names if c not in df.columns]
    if absent and missing is None:
        raise ValueError(f"feature columns missing: {absent}")
    return df.withColumns({c: F.lit(float(missing)) for c in absent}) if absent else df


def features_at(
    df: DataFrame,
    holidays: DataFrame,
    at: Column,
    *,
    freq: str,
    spec: FeatureSpec | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    **kwargs,
) -> DataFrame:
    """Feature row of the step that ``at`` names, from a bounded piece of history.

    Only rows within reach of the spec are read, so the time filter prunes the scan.
    """
    spec = spec or SPECS[freq]
    at = at.cast("timestamp_ntz")
    width = F.make_dt_interval(
        **({"days": F.lit(spec.reach() + 1)} if freq == "day" else {"hours": F.lit(spec.reach() + 1)})
    )
    recent = df.filter(F.col(time).between(at - width, at))
    rows = feature_matrix(
        recent, holidays, freq=freq, spec=any_length(spec), drop_na=False, by=by, time=time, **kwargs
    )
    return rows.filter(F.col(time) == at)
