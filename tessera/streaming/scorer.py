"""Structured Streaming over arriving records. An extension: batch tables are the engine's subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scaling import clip_predictions


def read_records(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deliveries_once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each record once, however often it is delivered within the watermark; state is dropped beyond it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def score(stream: DataFrame, prediction: Column) -> DataFrame:
    """Records with a fitted model's prediction: a stateless projection."""
    return stream.withColumn("pred", clip_predictions(prediction))


def error_windows(scored: DataFrame, y: str, time: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean absolute error per tumbling window; late rows count until the watermark passes."""
    e = F.abs(F.col("pred") - F.col(y))
    return scored.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(e).alias("mae"))
