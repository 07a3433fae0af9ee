"""Stored intermediate results, and tables read by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share.

    The folder is ``spark.checkpoint.dir``; a session without that setting gets a folder
    below its warehouse. A lost executor loses nothing of it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
