"""Signal, train and clip views of the driver's tables, which stand in for recordings in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The clip view: an embedding of 64 values is read as four channels of 16 samples.
CHANNELS, WIDTH = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, sample, v): an event type is a channel, its events in order are samples."""
    order = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("sample"), F.col("value").alias("v"))


def train(spark: SparkSession, sf_dir: str, unit: str = "event_type") -> DataFrame:
    """(unit, idx): an event type or user is a unit, seconds since 2024-01-01 are samples at 1 Hz."""
    return table(spark, sf_dir, "events").select(F.col(unit).alias("unit"), (F.unix_timestamp(F.date_trunc("second", "ts")) - 1704067200).alias("idx"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, unit, clip): embeddings and their labels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event"), F.col("label").cast("long").alias("unit"), F.transform("embedding", lambda x: x.cast("double")).alias("clip"))
