"""Saving and loading a model together with its metadata, and published tables of models by series."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wattline.names import PROVENANCE

METADATA_SCHEMA = (
    "model_name string, model_class string, data_provenance string, feature_columns array<string>, "
    "n_features int, metrics map<string, struct<mape: double, mae: double, rmse: double, r2: double, wape: double>>"
)


def save_model(
    model: PipelineModel | DataFrame,
    path: str,
    *,
    features: Sequence[str],
    metrics: Mapping[str, Mapping[str, float]],
    model_name: str,
    provenance: str = PROVENANCE[0],
    spark: SparkSession | None = None,
) -> str:
    """Write a Spark ML model, or a table of ridge coefficients or forests by series, and one metadata row."""
    if isinstance(model, DataFrame):
        spark, kind = model.sparkSession, "Forests" if "roots" in model.columns else "RidgeCoefficients"
        model.write.mode("overwrite").parquet(f"{path}/model")
    else:
        spark, kind = spark or SparkSession.getActiveSession(), type(model.stages[-1]).__name__
        model.write().overwrite().save(f"{path}/model")
    keys = ("mape", "mae", "rmse", "r2", "wape")
    scores = {m: tuple(v.get(k) for k in keys) for m, v in metrics.items()}
    row = (model_name, kind, provenance, list(features), len(features), scores)
    (
        spark.createDataFrame([row], METADATA_SCHEMA)
        .withColumn("timestamp", F.current_timestamp())
        .coalesce(1)
        .write.mode("overwrite")
        .json(f"{path}/metadata")
    )
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | DataFrame, Row]:
    """Model and metadata row; raises FileNotFoundError if nothing was saved there."""
    try:
        metadata = spark.read.schema(METADATA_SCHEMA + ", timestamp timestamp").json(f"{path}/metadata").first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"no model at {path}") from error
    if metadata["model_class"] in ("RidgeCoefficients", "Forests"):
        return spark.read.parquet(f"{path}/model"), metadata
    return PipelineModel.load(f"{path}/model"), metadata


PUBLISHED_SCHEMA = "version long, folder string, freq string, feature_columns array<string>, data_provenance string, n_series long"


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(PUBLISHED_SCHEMA + ", published timestamp").parquet(f"{path}/published")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def publish_models(
    models: DataFrame, path: str, *, features: Sequence[str], freq: str, provenance: str = PROVENANCE[0]
) -> int:
    """Store a model per series (``refit_each``) as the newest version; returns its number.

    The models go to a folder of their own, which nobody knows until one row in ``published`` names it. Adding
    that row is a single file, so a reader sees either the former version or the whole new one. Versions are numbered
    by one publisher at a time; earlier ones stay readable.
    """
    spark = models.sparkSession
    folder = f"{path}/models-{uuid.uuid4().hex}"
    models.write.partitionBy("kind").parquet(folder)
    stored = spark.read.parquet(folder)
    before = _published(spark, path)
    last = before.agg(F.max("version")).first()[0] if before is not None else None
    version = (last or 0) + 1
    row = (version, folder.rsplit("/", 1)[1], freq, list(features), provenance, stored.count())
    added = spark.createDataFrame([row], PUBLISHED_SCHEMA).withColumn("published", F.current_timestamp())
    added.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def published_models(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, Row]:
    """The models of a version, the newest by default, and its row; raises FileNotFoundError if there is none."""
    known = _published(spark, path)
    row = None
    if known is not None:
        wanted = known if version is None else known.filter(F.col("version") == version)
        row = wanted.orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"no published models at {path}")
    return spark.read.parquet(f"{path}/{row['folder']}"), row
