"""Expanding-window folds, cross-validation results, champion and leaderboard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.names import BY, DEMAND, TIME
from wattline.operators.chunks import row_positions
from wattline.operators.metrics import METRICS, metrics

# Number of folds and rows per validation block (30 days, 60 days).
N_SPLITS = 5
TEST_SIZE = {"hour": 24 * 30, "day": 60}
CV_METRICS = ("mape", "mae", "rmse", "r2", "wape")


def time_blocks(
    df: DataFrame,
    *,
    freq: str,
    n_splits: int = N_SPLITS,
    test_size: int | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    **grid,
) -> DataFrame:
    """Add ``block``: 0 for the rows every fold trains on, then 1 .. ``n_splits``.

    Fold ``k`` trains on blocks below ``k`` and validates on block ``k``. Series without
    a row left for block 0 cannot be split and are dropped; ``unserved`` lists them.
    """
    size = test_size or TEST_SIZE[freq]
    numbered = row_positions(df, by=by, freq=freq, time=time, position="_pos", total="_total", **grid)
    first = F.col("_total") - n_splits * size
    block = F.when(F.col("_pos") < first, 0).otherwise(F.floor((F.col("_pos") - first) / size) + 1)
    return numbered.filter(first > 0).withColumn("block", block.cast("int")).drop("_pos", "_total")


def unserved(
    df: DataFrame, *, freq: str, n_splits: int = N_SPLITS, test_size: int | None = None, by: Sequence[str] = BY
) -> DataFrame:
    """Series that are too short for the folds: ``n_rows`` and the ``reason``."""
    size = test_size or TEST_SIZE[freq]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") <= n_splits * size)
    return sizes.withColumn("reason", F.format_string(f"%d rows, {n_splits} folds of {size} need more than {n_splits * size}", "n_rows"))


def time_folds(df: DataFrame, *, freq: str, n_splits: int = N_SPLITS, **kwargs) -> DataFrame:
    """One row per fold a row takes part in, with ``fold`` and ``role`` (train or valid)."""
    blocks = time_blocks(df, freq=freq, n_splits=n_splits, **kwargs)
    folds = F.sequence(F.greatest("block", F.lit(1)), F.lit(n_splits))
    role = F.when(F.col("block") == F.col("fold"), "valid").otherwise("train")
    return blocks.withColumn("fold", F.explode(folds)).withColumn("role", role).drop("block")


def validation_rows(df: DataFrame, **kwargs) -> DataFrame:
    """Only the validation rows, with their ``fold``."""
    return time_blocks(df, **kwargs).filter(F.col("block") > 0).withColumnRenamed("block", "fold")


def fold_metrics(
    predictions: DataFrame, *, by: Sequence[str] = BY, actual: str = DEMAND, predicted: str = "pred"
) -> DataFrame:
    """All metrics per series, model and fold."""
    return metrics(predictions, [*by, "model", "fold"], actual, predicted)


def cv_mean(folds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean over folds of the five compared metrics."""
    return folds.groupBy(*by, "model").agg(
        *[F.avg(m).alias(m) for m in CV_METRICS], F.count(F.lit(1)).alias("n_folds")
    )


def leaderboard(*results: DataFrame) -> DataFrame:
    """All candidates of all products in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def select_champion(results: DataFrame, order: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Model with the lowest error per series; the first candidate wins ties."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    key = F.when(F.col("mape").isNotNull(), F.struct("mape", rank))
    return results.groupBy(*by).agg(F.min_by("model", key).alias("model"), F.min("mape").alias("mape"))


__all__ = [
    "METRICS",
    "cv_mean",
    "fold_metrics",
    "leaderboard",
    "select_champion",
    "time_blocks",
    "time_folds",
    "unserved",
    "validation_rows",
]
