"""Gradient-boosted tree candidates, and one model over all series on Spark ML.

The candidates are fitted per series by ``boosting``. The functions here fit one model over the rows of
all series; the work is spread over the cluster by row, so no series has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.names import DEMAND
from wattline.operators.features import complete_rows

SEED = 42


@dataclass(frozen=True)
class Trees:
    rounds: int
    learning_rate: float
    max_depth: int = 5
    min_rows: int = 1
    feature_share: str = "all"
    row_share: float = 1.0
    patience: int = 0
    #: Leaves of a tree that grows best first, without a limit to its depth; none: all leaves down to ``max_depth``.
    leaves: int | None = None
    l2: float = 0.0


# Rounds, learning rate, depth, smallest leaf, sampling, patience, leaves and penalty per candidate.
CANDIDATES = {
    "hour": {
        "Hourly Trees (Default)": Trees(300, 0.05, 5, 20, patience=30, leaves=31),
        "Hourly Trees (Tuned)": Trees(400, 0.04, 6, 15, "0.8", 0.8, patience=30, leaves=45),
        "Hourly Trees (Depth 5)": Trees(300, 0.04, 5, 1, "0.8", 0.8, l2=1.0),
    },
    "day": {"Daily Trees (Dedicated)": Trees(250, 0.03, 5, 10, "0.85", 0.85, patience=25, leaves=25)},
}


def trees_estimator(
    features: Sequence[str],
    trees: Trees,
    *,
    target: str = DEMAND,
    rounds: int | None = None,
    output: str = "pred",
) -> Pipeline:
    """Assembler and boosted trees; ``rounds`` overrides the number of trees."""
    booster = GBTRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol=output,
        maxIter=rounds or trees.rounds,
        stepSize=trees.learning_rate,
        maxDepth=trees.max_depth,
        minInstancesPerNode=trees.min_rows,
        featureSubsetStrategy=trees.feature_share,
        subsamplingRate=trees.row_share,
        seed=SEED,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, booster])


def best_round(errors: Sequence[float], patience: int) -> int:
    """Rounds up to the best one, where ``patience`` rounds without a better one end the search."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_trees(
    df: DataFrame, features: Sequence[str], trees: Trees, *, validation: str | None = None, patience: int | None = None, **kwargs
) -> PipelineModel:
    """Fit on the rows without a missing feature or target.

    With ``validation``, a boolean column, the marked rows aren't trained on: they decide the number of
    rounds, by the error after each round and the candidate's patience. Boosting is deterministic, so the
    fit with that number of rounds is the beginning of the full one.
    """
    target = kwargs.get("target", DEMAND)
    rows = complete_rows(df, [*features, target])
    if validation is None:
        return trees_estimator(features, trees, **kwargs).fit(rows)
    seen, held = rows.filter(~F.col(validation)), rows.filter(F.col(validation))
    full = trees_estimator(features, trees, **kwargs).fit(seen)
    assembler, booster = full.stages
    errors = booster.evaluateEachIteration(assembler.transform(held), "squared")
    rounds = best_round(errors, trees.patience if patience is None else patience)
    if rounds == len(errors):
        return full
    return trees_estimator(features, trees, **(kwargs | {"rounds": rounds})).fit(seen)


def predict_trees(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions of the rows without a missing feature."""
    return model.transform(complete_rows(df, model.stages[0].getInputCols())).drop("_features")


def cv_trees(
    blocks: DataFrame,
    features: Sequence[str],
    trees: Trees,
    n_splits: int,
    *,
    rounds: int | None = None,
    target: str = DEMAND,
    early_stopping: bool = True,
) -> DataFrame:
    """Predictions of all validation blocks: one fit per fold.

    ``blocks`` comes from ``time_blocks`` and should be a stored table or persisted,
    since every fold reads it. As in the candidates' own cross-validation, the
    validation block also decides when boosting stops.
    """
    out = None
    for fold in range(1, n_splits + 1):
        known = blocks.filter(F.col("block") <= fold).withColumn("_valid", F.col("block") == fold)
        model = fit_trees(
            known if early_stopping else known.filter(~F.col("_valid")),
            features,
            trees,
            rounds=rounds,
            target=target,
            validation="_valid" if early_stopping else None,
        )
        scored = predict_trees(known.filter(F.col("_valid")), model).drop("_valid")
        scored = scored.withColumnRenamed("block", "fold")
        out = scored if out is None else out.unionByName(scored)
    return out


def importance_table(df: DataFrame, model: PipelineModel, top: int = 15) -> DataFrame:
    """The ``top`` features by importance, one row each."""
    assembler, booster = model.stages[0], model.stages[-1]
    names = assembler.getInputCols()
    values = booster.featureImportances.toArray().tolist()
    rows = df.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)
