"""Metric tables as JSON, Markdown and display strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: header of the leaderboard table.
MARKDOWN_HEADER = (
    "| Model Architecture | CV MAPE | CV MAE (MW) | RMSE (MW) | R² Score | WAPE |",
    "| :--- | :--- | :--- | :--- | :--- | :--- |",
)
JSON_METRICS = ("mape", "mae", "rmse", "r2", "wape")


def percent(name: str) -> Column:
    return F.format_string("%.2f%%", F.col(name) * 100)


def megawatts(name: str) -> Column:
    return F.format_string("%.1f MW", F.col(name))


def display_metrics(df: DataFrame) -> DataFrame:
    """Metrics as display strings."""
    return df.withColumns(
        {
            "mape": percent("mape"),
            "mae": megawatts("mae"),
            "rmse": megawatts("rmse"),
            "r2": F.format_string("%.4f", F.col("r2")),
            "wape": percent("wape"),
        }
    )


def markdown_rows(df: DataFrame) -> DataFrame:
    """One table line per model."""
    cells = [percent("mape"), megawatts("mae"), megawatts("rmse"), F.format_string("%.4f", F.col("r2")), percent("wape")]
    line = F.concat(F.lit("| **"), F.col("model"), F.lit("** | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    keys = [c for c in df.columns if c not in (*JSON_METRICS, "max_err", "n_folds", "model")]
    return df.select(*keys, line.alias("value"))


def write_markdown(df: DataFrame, path: str) -> str:
    """The leaderboard of one product line as a Markdown text file.

    A leaderboard has one row per model, so one output file is fine.
    """
    header = df.sparkSession.createDataFrame(
        [(i - len(MARKDOWN_HEADER), line) for i, line in enumerate(MARKDOWN_HEADER)], "_row long, value string"
    )
    body = markdown_rows(df).select(F.monotonically_increasing_id().alias("_row"), "value")
    text = header.unionByName(body).orderBy("_row").coalesce(1).select("value")
    text.write.mode("overwrite").text(path)
    return path


def metrics_json(df: DataFrame) -> DataFrame:
    """One row: a JSON object of metrics per model. Models are a short list."""
    scores = F.struct(*[F.col(m) for m in JSON_METRICS])
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("model"), scores))))
    return df.agg(F.to_json(entries).alias("value"))


def write_metrics_json(df: DataFrame, path: str) -> str:
    metrics_json(df).write.mode("overwrite").text(path)
    return path
