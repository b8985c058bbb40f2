"""Incremental forms: new files only, event-time windows, frozen layers on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import Layer


def new_files(spark: SparkSession, path: str, schema, file_format: str = "parquet", per_batch: int = 100) -> DataFrame:
    """A stream of the rows of files that appear in a folder; the sink's checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(file_format).load(path)


def windowed_stats(events: DataFrame, time: str, value: str, width: str = "1 day", late: str = "2 days", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and population SD per tumbling event-time window; rows later than the watermark are left out."""
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    got = stamped.groupBy(F.window("_ts", width).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    return got.select(F.col("w.start").alias("window_start"), *by, "n", "mean", "sd")


def replay(events: DataFrame, layer: Layer, suffix: str = "_z") -> DataFrame:
    """A frozen layer on a stream: a stateless projection."""
    return layer.apply(events, suffix)
