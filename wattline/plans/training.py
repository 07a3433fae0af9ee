"""Cross-validation of all candidates, champion, refit and leaderboard."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.models import folds as folding
from wattline.models.naive import SEASONAL_COLUMN, predict_naive
from wattline.models.boosting import FOREST, binned_blocks, cv_forests, fit_forests, predict_forests
from wattline.models.registry import publish_models, published_models, save_model
from wattline.models.ridge import ALL_ROWS, ALPHA, fit_ridge, predict_ridge
from wattline.models.trees import CANDIDATES, Trees
from wattline.names import BY, DEMAND, SERIES, TIME
from wattline.sources.files import checkpoint_folder, read_table, write_table

# Names of the baseline candidates, in the order they are compared.
NAIVE = {"hour": "Hourly Naive (Lag 168h)", "day": "Daily Naive (Lag 7d)"}
RIDGE = {"hour": "Hourly Ridge Regression", "day": "Daily Ridge Regression"}
POOLED = "all series"


@dataclass(frozen=True)
class Training:
    """Outcome of one product line.

    ``champions`` has the best candidate of each series, and for series too short for
    the folds no candidate but the ``reason``. ``models`` has each series' own champion, refitted; ``best_model``
    gives the candidate that is best over all, refitted for every series.
    """

    freq: str
    features: list[str]
    results: DataFrame
    champion: str
    champions: DataFrame
    models: DataFrame
    best_model: Callable[[DataFrame | None], DataFrame | None]


def candidate_order(freq: str, trees: Mapping[str, Trees] | None = None) -> list[str]:
    return [NAIVE[freq], RIDGE[freq], *(CANDIDATES[freq] if trees is None else trees)]


def cv_predictions(
    matrix: DataFrame,
    features: Sequence[str],
    *,
    freq: str,
    n_splits: int = folding.N_SPLITS,
    test_size: int | None = None,
    alpha: float | None = None,
    trees: Mapping[str, Trees] | None = None,
    rounds: int | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """Validation predictions of all candidates: keys, fold, model, target and ``pred``.

    ``matrix`` should be a stored table, since every candidate reads it.
    """
    blocks = folding.time_blocks(matrix, freq=freq, n_splits=n_splits, test_size=test_size, by=by, time=time)
    # Numbered and stored once: every candidate and fold reads them.
    checkpoint_folder(matrix.sparkSession)
    blocks = blocks.checkpoint()
    valid = blocks.filter(F.col("block") > 0).withColumnRenamed("block", "fold")
    fitted = fit_ridge(blocks, features, alpha or ALPHA[freq], by=by, block="block")
    scored = {
        NAIVE[freq]: predict_naive(valid, SEASONAL_COLUMN[freq]),
        RIDGE[freq]: predict_ridge(valid, fitted, features, by=by),
    }
    candidates = CANDIDATES[freq] if trees is None else trees
    if candidates:
        # One job for all candidates and folds.
        binned = binned_blocks(blocks, features, freq=freq, by=by, time=time, block="block")
        forests = cv_forests(binned, candidates, range(1, n_splits + 1), freq=freq, rounds=rounds, by=by, time=time)
    out = forests.select(*by, time, "fold", "model", DEMAND, "pred") if candidates else None
    for name, df in scored.items():
        part = df.select(*by, time, "fold", F.lit(name).alias("model"), DEMAND, "pred")
        out = part if out is None else out.unionByName(part)
    return out


def cross_validate(matrix: DataFrame, features: Sequence[str], *, by: Sequence[str] = BY, **kwargs) -> DataFrame:
    """Mean fold metrics per series and candidate."""
    predictions = cv_predictions(matrix, features, by=by, **kwargs)
    return folding.cv_mean(folding.fold_metrics(predictions, by=by), by)


def pooled_results(results: DataFrame) -> DataFrame:
    """Mean metrics over all series, one row per model."""
    averages = [F.avg(m).alias(m) for m in folding.CV_METRICS]
    return results.groupBy("model").agg(*averages).withColumn(SERIES, F.lit(POOLED))


def refit(
    matrix: DataFrame,
    champion: str,
    features: Sequence[str],
    *,
    freq: str,
    alpha: float | None = None,
    trees: Mapping[str, Trees] | None = None,
    rounds: int | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    known: DataFrame | None = None,
) -> DataFrame | None:
    """Fit the named candidate on all rows, one model per series; the naive model has nothing to fit.

    Series that have a forest of this candidate in ``known`` (``refit_each``, stored) keep it.
    """
    if champion == NAIVE[freq]:
        return None
    if champion == RIDGE[freq]:
        return fit_ridge(matrix, features, alpha or ALPHA[freq], by=by)
    settings = (CANDIDATES[freq] if trees is None else trees)[champion]
    kept = None
    if known is not None:
        kept = known.filter((F.col("kind") == "forest") & (F.col("model") == champion)).select(*by, "forest.*", "n_rows")
        matrix = matrix.join(kept.select(*by), list(by), "left_anti")
        if matrix.isEmpty():
            return kept
    binned = binned_blocks(matrix, features, freq=freq, by=by, time=time)
    fitted = fit_forests(binned, {champion: settings}, rounds=rounds, by=by).drop("model")
    return fitted if kept is None else kept.unionByName(fitted)


def refit_each(
    matrix: DataFrame,
    champions: DataFrame,
    features: Sequence[str],
    *,
    freq: str,
    alpha: float | None = None,
    trees: Mapping[str, Trees] | None = None,
    rounds: int | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """Every series' own champion (``champions``: keys, ``model``), fitted on all its rows.

    One row per series: ``model``, ``kind`` (naive, ridge or forest), and what that kind needs to predict.
    """
    candidates = CANDIDATES[freq] if trees is None else trees
    own = champions.filter(F.col("model").isNotNull()).select(*by, "model")
    used = {r["model"] for r in own.select("model").distinct().collect()}  # names of candidates
    strange = used - {NAIVE[freq], RIDGE[freq], *candidates}
    if strange:
        raise ValueError(f"unknown candidates: {sorted(strange)}")
    empty = {"intercept": "double", "coefficients": "array<double>", "forest": f"struct<{FOREST.replace(' ', ':').replace(',:', ',')}>", "n_rows": "long"}

    def packed(df: DataFrame, kind: str, **filled) -> DataFrame:
        columns = [filled.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()]
        return df.select(*by, "model", F.lit(kind).alias("kind"), *columns)

    parts = [packed(own.filter(F.col("model") == NAIVE[freq]), "naive")]
    if RIDGE[freq] in used:
        mine = own.filter(F.col("model") == RIDGE[freq])
        fitted = fit_ridge(matrix.join(mine, list(by), "left_semi"), features, alpha or ALPHA[freq], by=by)
        fitted = fitted.filter(F.col("fold") == ALL_ROWS).withColumn("model", F.lit(RIDGE[freq]))
        parts.append(packed(fitted, "ridge", **{c: F.col(c) for c in ("intercept", "coefficients", "n_rows")}))
    chosen = {m: t for m, t in candidates.items() if m in used}
    if chosen:
        mine = own.filter(F.col("model").isin(list(chosen)))
        binned = binned_blocks(matrix.join(mine, list(by), "left_semi"), features, freq=freq, by=by, time=time)
        forests = fit_forests(binned, chosen, which=mine, rounds=rounds, by=by)
        whole = F.struct(*[c.split()[0] for c in FOREST.split(", ")])
        parts.append(packed(forests, "forest", forest=whole, n_rows=F.col("n_rows")))
    return folding.leaderboard(*parts)


def predict_each(
    matrix: DataFrame, models: DataFrame, features: Sequence[str], *, freq: str, by: Sequence[str] = BY, time: str = TIME
) -> DataFrame:
    """Predictions of the rows of every series that has a model, by that model."""
    ridge = models.filter(F.col("kind") == "ridge").withColumn("fold", F.lit(ALL_ROWS))
    forests = models.filter(F.col("kind") == "forest").select(*by, "forest.*")
    naive = matrix.join(models.filter(F.col("kind") == "naive"), list(by), "left_semi")
    parts = [
        predict_naive(naive, SEASONAL_COLUMN[freq]),
        predict_ridge(matrix, ridge, features, by=by, time=time),
        predict_forests(matrix, forests, features, freq=freq, by=by, time=time),
    ]
    return folding.leaderboard(*(p.select(*matrix.columns, "pred") for p in parts))


def train(matrix: DataFrame, *, freq: str, by: Sequence[str] = BY, time: str = TIME, **kwargs) -> Training:
    """Cross-validate, choose the champion over all series and refit it."""
    features = [c for c in matrix.columns if c not in (*by, time, DEMAND)]
    # Stored: the pooled results, the champions and the board all read them.
    checkpoint_folder(matrix.sparkSession)
    results = cross_validate(matrix, features, freq=freq, by=by, time=time, **kwargs).checkpoint()
    overall = pooled_results(results)
    order = candidate_order(freq, kwargs.get("trees"))
    best = folding.select_champion(overall, order, by=(SERIES,)).first()
    if best is None:
        raise ValueError("no series is long enough for the folds")
    options = {k: v for k, v in kwargs.items() if k in ("alpha", "trees", "rounds")}
    sizes = {k: v for k, v in kwargs.items() if k in ("n_splits", "test_size")}
    short = folding.unserved(matrix, freq=freq, by=by, **sizes).drop("n_rows")
    champions = folding.leaderboard(folding.select_champion(results, order, by=by), short)
    best_model = partial(_refit_known, matrix, best["model"], features, dict(freq=freq, by=by, time=time, **options))
    models = refit_each(matrix, champions, features, freq=freq, by=by, time=time, **options)
    scores = results.select(*by, "model", F.struct(*folding.CV_METRICS).alias("scores"))
    models = models.join(scores, [*by, "model"], "left")
    return Training(freq, features, overall, best["model"], champions, models, best_model)


def _refit_known(matrix: DataFrame, champion: str, features: Sequence[str], options: dict, known: DataFrame | None = None):
    return refit(matrix, champion, features, known=known, **options)


def train_all(
    spark: SparkSession,
    path: str,
    *,
    by: Sequence[str] = BY,
    hourly: Mapping | None = None,
    daily: Mapping | None = None,
) -> DataFrame:
    """Train both product lines from the stored matrices, publish models, save the best ones and the leaderboard."""
    outcomes = [
        train(read_table(spark, f"{path}/features"), freq="hour", by=by, **(hourly or {})),
        train(read_table(spark, f"{path}/features_daily"), freq="day", by=by, **(daily or {})),
    ]
    for outcome in outcomes:
        write_table(outcome.champions, f"{path}/champions_{outcome.freq}")
        publish_models(outcome.models, f"{path}/models_{outcome.freq}", features=outcome.features, freq=outcome.freq)
        # What is published is stored, so its forests needn't be fitted again.
        model = outcome.best_model(published_models(spark, f"{path}/models_{outcome.freq}")[0])
        if model is not None:
            scores = {r["model"]: r.asDict() for r in outcome.results.collect()}  # one row per candidate
            save_model(
                model,
                f"{path}/best_model_{outcome.freq}",
                features=outcome.features,
                metrics=scores,
                model_name=outcome.champion,
                spark=spark,
            )
    board = folding.leaderboard(*(o.results for o in outcomes))
    write_table(board, f"{path}/metrics_summary")
    return read_table(spark, f"{path}/metrics_summary")
