"""Ridge regression for many series and folds in one job.

A fold's training rows are the blocks before it, and the normal equations of a union
are the sum of the parts. So each row is read once: every task adds up the products of
its rows per series and block, Spark sums these small matrices, and one small solve per
series yields the coefficients of all folds and of the fit on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.grid import step_of
from wattline.names import BY, DEMAND, TIME
from wattline.operators.chunks import CHUNK_COL, CHUNK_STEPS, chunk_of

# Penalty of the hourly and the daily candidate.
ALPHA = {"hour": 10.0, "day": 5.0}
ALL_ROWS = 0  # fold number of the fit on all rows

_HELD_GROUPS = 64  # matrices a task keeps before it hands them on


def _key_fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def cross_products(
    df: DataFrame, features: Sequence[str], *, target: str = DEMAND, by: Sequence[str] = BY, block: str = "block"
) -> DataFrame:
    """Upper triangle of ``[1, x, y]' [1, x, y]`` summed per series and block.

    Rows with a missing feature or target are left out.
    """
    keys = [*by, block]
    numbers = [F.col(c).cast("double").alias(c) for c in (*features, target)]
    rows = df.select(*keys, *numbers)
    width = len(features) + 2
    upper = np.triu_indices(width)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=keys)
            out["sums"] = [m[upper] for m in held.values()]
            return out

        for pdf in batches:
            pdf = pdf.dropna()
            matrix = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, len(keys) :].to_numpy(float)])
            for key, at in pdf.groupby(keys, sort=False).indices.items():
                part = matrix[at]
                held[key] = held.get(key, 0.0) + part.T @ part
            if len(held) > _HELD_GROUPS:
                yield hand_on()
                held.clear()
        if held:
            yield hand_on()

    schema = T.StructType([*_key_fields(rows, keys), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    parts = rows.mapInPandas(add_up, schema)
    total = Summarizer.sum(F.col("_vector")).alias("_total")
    return (
        parts.withColumn("_vector", array_to_vector("sums"))
        .groupBy(*keys)
        .agg(total)
        .select(*keys, vector_to_array("_total").alias("sums"))
    )


def _solve(sums: np.ndarray, width: int, alpha: float) -> tuple[float, np.ndarray, int]:
    """Coefficients around the means, with an unpenalised intercept."""
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = sums
    full = full + np.triu(full, 1).T
    n = full[0, 0]
    means = full[0, 1:] / n
    centred = full[1:, 1:] - n * np.outer(means, means)
    p = width - 2
    coefficients = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])
    return float(means[p] - means[:p] @ coefficients), coefficients, int(n)


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    alpha: float,
    *,
    target: str = DEMAND,
    by: Sequence[str] = BY,
    block: str | None = None,
) -> DataFrame:
    """Coefficients per series: fold 0 uses all rows, fold ``k`` the blocks below ``k``.

    Without ``block`` only fold 0 is fitted. The result has one row per series and fold:
    ``intercept``, ``coefficients`` in the order of ``features``, and ``n_rows``.
    """
    if block is None:
        df, block = df.withColumn("_block", F.lit(0)), "_block"
    sums = cross_products(df, features, target=target, by=by, block=block)
    width = len(features) + 2
    keys = list(by)
    schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("fold", T.IntegerType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("n_rows", T.LongType()),
        ]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per block
        parts = dict(zip(pdf[block], pdf["sums"].map(np.asarray), strict=True))
        head = [pdf[k].iloc[0] for k in keys]
        fits = []
        for fold in [ALL_ROWS, *sorted(b for b in parts if b > 0)]:
            used = [m for b, m in parts.items() if fold == ALL_ROWS or b < fold]
            if used:
                intercept, coefficients, n = _solve(np.sum(used, axis=0), width, alpha)
                fits.append([*head, fold, intercept, coefficients, n])
        return pd.DataFrame(fits, columns=schema.names)

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def linear_score(features: Sequence[str], coefficients: str = "coefficients", start: str | Column = "intercept") -> Column:
    """``start + sum(feature * coefficient)`` as one expression."""
    total = F.col(start) if isinstance(start, str) else start
    for i, name in enumerate(features):
        total = total + F.col(name).cast("double") * F.col(coefficients)[i]
    return total


def predict_ridge(
    df: DataFrame,
    fitted: DataFrame,
    features: Sequence[str],
    *,
    by: Sequence[str] = BY,
    time: str = TIME,
    output: str = "pred",
) -> DataFrame:
    """Predictions of each row's own series; with a ``fold`` column also of its fold.

    Coefficients are repeated once per chunk of a series and joined on the series and the chunk, so
    that a task joins the rows of a chunk at most, however long a series is.
    """
    if "fold" in df.columns:
        model = fitted.filter(F.col("fold") != ALL_ROWS)
        on = [*by, "fold"]
    else:
        model, on = fitted.filter(F.col("fold") == ALL_ROWS).drop("fold"), list(by)
    chunk = chunk_of(step_of(F.col(time), "hour"), CHUNK_STEPS)
    spans = df.groupBy(*by).agg(F.min(chunk).alias("_lo"), F.max(chunk).alias("_hi"))
    spread = model.join(spans, list(by)).select(
        *on, "intercept", "coefficients", F.explode(F.sequence(F.col("_lo"), F.col("_hi"))).alias(CHUNK_COL)
    )
    joined = df.withColumn(CHUNK_COL, chunk).join(spread, [*on, CHUNK_COL])
    return joined.select(*df.columns, linear_score(features).alias(output))
