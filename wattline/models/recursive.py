"""Multi-step forecasts that feed predictions back as history.

Series and scenarios are independent, so the recursion runs in parallel over them. For
the linear model and for forests only the terms that depend on earlier predictions (short lags and
rolling frames) are evaluated step by step, on arrays of a fixed length; everything else is
computed by the ordinary feature operators beforehand, so a forecast is one job whatever its horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.grid import step_of, time_of
from wattline.models.boosting import Forest, fresh
from wattline.models.ridge import ALL_ROWS
from wattline.names import BY, DEMAND, SCENARIO, STEP, TIME
from wattline.operators.chunks import CHUNK_STEPS
from wattline.operators.features import (
    FeatureSpec,
    any_length,
    feature_matrix,
    require_features,
    rolling_names,
    without_annual_gaps,
)
from wattline.operators.horizon import append_future, history_tail
from wattline.sources.files import checkpoint_folder

FORECAST = "forecast_mw"


def seasonal_naive_forecast(
    history: DataFrame,
    future: DataFrame,
    season: int,
    *,
    freq: str = "hour",
    by: Sequence[str] = BY,
    time: str = TIME,
    value: str = DEMAND,
) -> DataFrame:
    """Repeat the last season; equal to feeding naive predictions back step by step."""
    seasons = F.ceil(F.col(STEP) / season)
    source = step_of(F.col(time), freq) - seasons * season
    # No series looks back further than a season before the earliest first step, so the scan stops there.
    earliest = future.agg(time_of(F.min(step_of(F.col(time), freq)) - season, freq)).scalar()
    recent = history.filter(F.col(time) >= earliest)
    past = recent.select(*by, step_of(F.col(time), freq).alias("_source"), F.col(value).alias("_value"))
    joined = future.withColumn("_source", source).join(past, [*by, "_source"], "left")
    floored = F.when(F.col("_value").isNotNull(), F.greatest(F.col("_value"), F.lit(0.0)))
    return joined.select(*future.columns, floored.alias(FORECAST))


def _context(
    history: DataFrame, future: DataFrame, spec: FeatureSpec, by: Sequence[str], time: str, chunk_steps: int
) -> DataFrame:
    """Recent history, once per scenario, followed by the future rows."""
    keys = [*by, SCENARIO]
    recent = history_tail(history, spec.reach() + 1, freq=spec.freq, by=by, time=time, chunk_steps=chunk_steps)
    scenarios = future.select(*keys).distinct()
    return append_future(recent.join(scenarios, list(by)), future)


def autoregressive_terms(spec: FeatureSpec, horizon: int) -> dict[str, tuple[str, int]]:
    """Features that change with earlier predictions: name -> (kind, lag or width)."""
    terms = {spec.lag_name(k): ("lag", k) for k in spec.lags if k < horizon}
    terms |= {name: (stat, w) for name, stat, w in rolling_names(spec)}
    terms[f"demand_ratio_to_{spec.ratio_window}{spec.suffix}_mean"] = ("ratio", spec.ratio_window)
    return terms


def _term(values: np.ndarray, now: int, kind: str, k: int) -> np.ndarray:
    """One autoregressive feature of the step at ``now``, for many series or scenarios."""
    if kind == "lag":
        return values[:, now - k]
    frame = values[:, now - k : now]
    if kind == "std":
        return frame.std(axis=1, ddof=1)
    if kind in ("min", "max"):
        return getattr(frame, kind)(axis=1)
    mean = frame.mean(axis=1)
    return values[:, now - 1] / (mean + 1e-5) if kind == "ratio" else mean


def _roll_forest(past: np.ndarray, known: np.ndarray, forest: Forest, places: Sequence[int], terms: Sequence[tuple[str, int]]) -> np.ndarray:
    """Predictions of all scenarios of a series; ``known`` is scenarios by steps by features."""
    width, horizon = len(past), known.shape[1]
    values = np.concatenate([np.broadcast_to(past, (len(known), width)), np.empty(known.shape[:2])], axis=1)
    for h in range(horizon):
        x = known[:, h]
        for place, (kind, k) in zip(places, terms, strict=True):
            x[:, place] = _term(values, width + h, kind, k)
        score = np.maximum(forest.score(x), 0.0)
        values[:, width + h] = np.where(np.isnan(x).any(axis=1), np.nan, score)
    return values[:, width:]


def _roll_forward(past: np.ndarray, known: np.ndarray, weights: np.ndarray, terms: Sequence[tuple[str, int]]) -> np.ndarray:
    """Predictions for a batch of series: rows are series, columns are steps."""
    width, horizon = past.shape[1], known.shape[1]
    values = np.concatenate([past, np.empty_like(known)], axis=1)
    for h in range(horizon):
        now = width + h
        total = known[:, h].copy()
        for j, (kind, k) in enumerate(terms):
            if kind == "lag":
                x = values[:, now - k]
            else:
                frame = values[:, now - k : now]
                if kind == "std":
                    x = frame.std(axis=1, ddof=1)
                elif kind == "min":
                    x = frame.min(axis=1)
                elif kind == "max":
                    x = frame.max(axis=1)
                else:
                    x = frame.mean(axis=1)
                    if kind == "ratio":
                        x = values[:, now - 1] / (x + 1e-5)
            total += weights[:, j] * x
        values[:, now] = np.maximum(total, 0.0)
    return values[:, width:]


def recursive_ridge_forecast(
    history: DataFrame,
    future: DataFrame,
    fitted: DataFrame,
    features: Sequence[str],
    holidays: DataFrame,
    *,
    spec: FeatureSpec,
    horizon: int,
    country: str | None = None,
    missing: float | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Forecast every future row with the ridge model of its series, floored at zero.

    ``history`` is a dense cleaned grid, ``future`` has weather, ``step`` and scenario,
    ``fitted`` comes from ``fit_ridge`` on ``features``. A feature that can't be computed raises, or
    is taken as ``missing`` if that is given. A series whose history is shorter than the
    longest frame has no forecast (null); ``unserved`` names such series and the reason.
    """
    keys = [*by, SCENARIO]
    rows = feature_matrix(
        _context(history, future, spec, by, time, chunk_steps),
        holidays,
        freq=spec.freq,
        spec=any_length(spec),
        country=country,
        drop_na=False,
        by=keys,
        time=time,
        chunk_steps=chunk_steps,
    )
    rows = require_features(without_annual_gaps(rows, spec), features, missing)
    terms = {n: t for n, t in autoregressive_terms(spec, horizon).items() if n in features}
    fixed = [c for c in features if c not in terms]
    longest = max([k for _, k in terms.values()], default=1)

    # One row per series, used in two joins: stored, so that the fit runs once.
    model = _checkpointed(fitted.filter(F.col("fold") == ALL_ROWS).select(*by, "intercept", "coefficients"))
    position = {c: i for i, c in enumerate(features)}
    by_name = [F.col("coefficients")[position[c]].alias(f"_w_{c}") for c in fixed]
    ahead = rows.filter(F.col(STEP).isNotNull()).join(model.select(*by, "intercept", *by_name), list(by))
    score = F.col("intercept")
    for c in fixed:
        score = score + F.col(c).cast("double") * F.col(f"_w_{c}")
    # Both arrays have a fixed length: the horizon, and the longest autoregressive term.
    known = ahead.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(STEP, score.alias("s")))), lambda x: x["s"]).alias("_known")
    )
    recent = history_tail(history, longest, freq=spec.freq, by=by, time=time, chunk_steps=chunk_steps)
    past = recent.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(time, DEMAND))), lambda x: x[DEMAND]).alias("_past")
    )
    weights = F.array(*[F.col("coefficients")[position[c]] for c in terms]) if terms else F.array(F.lit(0.0))
    packed = known.join(past, list(by)).join(model.select(*by, weights.alias("_weights")), list(by))
    kinds = list(terms.values())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(known: pd.Series, past: pd.Series, weights: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(known), dtype=object)
        usable = [
            i
            for i, (a, b) in enumerate(zip(known, past, strict=True))
            if len(a) == horizon and len(b) == longest and not any(x is None for x in b)
        ]
        if usable:
            stacked = [np.stack([np.asarray(s.iloc[i], float) for i in usable]) for s in (past, known, weights)]
            for i, values in zip(usable, _roll_forward(*stacked, kinds), strict=True):
                out.iloc[i] = values
        return out

    predicted = packed.withColumn("_out", roll("_known", "_past", "_weights")).select(
        *keys, F.posexplode("_out").alias("_at", "_value")
    )
    predicted = predicted.select(*keys, (F.col("_at") + 1).cast("int").alias(STEP), F.col("_value").alias(FORECAST))
    value = F.when(~F.isnan(FORECAST), F.col(FORECAST))
    return future.join(predicted, [*keys, STEP], "left").select(*future.columns, value.alias(FORECAST))


def recursive_forest_forecast(
    history: DataFrame,
    future: DataFrame,
    forests: DataFrame,
    features: Sequence[str],
    holidays: DataFrame,
    *,
    spec: FeatureSpec,
    horizon: int,
    country: str | None = None,
    missing: float | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Forecast every future row with the forest of its series (``fit_forests``), floored at zero.

    The fixed features of the whole horizon come from one feature matrix. A task holds the horizon of one
    series, all scenarios together, and its forest. Gaps are treated as by ``recursive_ridge_forecast``.
    """
    keys = [*by, SCENARIO]
    rows = feature_matrix(
        _context(history, future, spec, by, time, chunk_steps),
        holidays,
        freq=spec.freq,
        spec=any_length(spec),
        country=country,
        drop_na=False,
        by=keys,
        time=time,
        chunk_steps=chunk_steps,
    )
    rows = require_features(without_annual_gaps(rows, spec), features, missing)
    terms = {n: t for n, t in autoregressive_terms(spec, horizon).items() if n in features}
    places, kinds = [list(features).index(n) for n in terms], list(terms.values())
    longest = max([k for _, k in kinds], default=1)
    names, on = list(features), list(by)
    blank = [F.lit(0.0).alias(c) if c in terms else F.col(c).cast("double").alias(c) for c in names]
    ahead = rows.filter(F.col(STEP).isNotNull()).select(*keys, F.col(STEP).cast("int").alias(STEP), *blank)
    recent = history_tail(history, longest, freq=spec.freq, by=by, time=time, chunk_steps=chunk_steps)
    past = recent.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(time, DEMAND))), lambda x: x[DEMAND]).alias("_past")
    )
    model = fresh(forests.drop("n_rows").join(past, on))

    def roll(ahead: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = ahead[[*keys, STEP]].sort_values([SCENARIO, STEP])
        past = np.asarray(model["_past"].iloc[0], float) if len(model) else np.zeros(0)
        if len(past) != longest or np.isnan(past).any() or len(out) % horizon or not len(out):
            return out.iloc[:0].assign(**{FORECAST: np.zeros(0)})
        known = ahead.sort_values([SCENARIO, STEP])[names].to_numpy(float).reshape(-1, horizon, len(names))
        return out.assign(**{FORECAST: _roll_forest(past, known, Forest.of(model.iloc[0]), places, kinds).ravel()})

    schema = T.StructType([*[f for f in ahead.schema if f.name in (*keys, STEP)], T.StructField(FORECAST, T.DoubleType())])
    predicted = ahead.groupBy(*on).cogroup(model.groupBy(*on)).applyInPandas(roll, schema)
    value = F.when(~F.isnan(FORECAST), F.col(FORECAST))
    return future.join(predicted, [*keys, STEP], "left").select(*future.columns, value.alias(FORECAST))


def unserved(history: DataFrame, spec: FeatureSpec, horizon: int, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Series that a recursive model can't forecast: ``n_rows`` and the ``reason``."""
    longest = max(k for _, k in autoregressive_terms(spec, horizon).values())
    sizes = history.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < longest)
    return sizes.withColumn("reason", F.format_string("%d rows of history, the longest frame has " + str(longest), "n_rows"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def recursive_model_forecast(
    history: DataFrame,
    future: DataFrame,
    model: PipelineModel,
    holidays: DataFrame,
    *,
    spec: FeatureSpec,
    horizon: int,
    country: str | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    output: str = "pred",
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """The same recursion for any Spark ML model: one job per step over all series.

    The rows predicted so far are checkpointed after each step, which cuts the growing
    lineage and survives the loss of executors.
    """
    keys = [*by, SCENARIO]
    context = _checkpointed(_context(history, future, spec, by, time, chunk_steps))
    done = None
    for h in range(1, horizon + 1):
        rows = context
        if done is not None:
            rows = context.join(done.withColumnRenamed(FORECAST, "_fed"), [*keys, STEP], "left")
            rows = rows.withColumn(DEMAND, F.coalesce(DEMAND, "_fed")).drop("_fed")
        rows = rows.filter(F.col(STEP).isNull() | (F.col(STEP) <= h))
        matrix = feature_matrix(
            rows, holidays, freq=spec.freq, spec=any_length(spec), country=country, drop_na=False, by=keys, time=time,
            chunk_steps=chunk_steps,
        ).filter(F.col(STEP) == h)
        matrix = without_annual_gaps(matrix, spec)
        step = model.transform(matrix).select(*keys, STEP, F.greatest(F.col(output), F.lit(0.0)).alias(FORECAST))
        done = _checkpointed(step if done is None else done.unionByName(step))
    return future.join(done, [*keys, STEP], "left").select(*future.columns, FORECAST)

