"""Score arriving users with a saved model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ebbtide.models.scoring import predict_proba
from ebbtide.models.storage import load_model
from ebbtide.schema import USER_SCHEMA


def arriving_users(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of per-user rows from new Parquet files of a folder."""
    reader = spark.readStream.schema(USER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(
    users: DataFrame,
    model: PipelineModel | str,
    out: str,
    checkpoint: str,
    version: str = "v0.1.0",
    available_now: bool = True,
    interval: str = "1 minute",
):
    """Start the query that scores a stream of users into Parquet.

    Scoring keeps no state, so the checkpoint holds file offsets only; a restart with the
    same checkpoint goes on with the first unscored file.
    """
    fitted = load_model(model) if isinstance(model, str) else model
    scored = predict_proba(fitted, users).selectExpr("*", f"'{version}' AS model_version")
    writer = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=interval
    )
    return writer.start()
