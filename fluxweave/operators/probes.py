"""Electrode geometries as neighbor tables (channel, neighbor, pos); pos is the neighbor's place in its list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ranked(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("channel").orderBy("neighbor")
    return pairs.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def _channels(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("channel"))


def single(spark: SparkSession) -> DataFrame:
    return all_to_all(spark, 1)


def tetrode(spark: SparkSession) -> DataFrame:
    return all_to_all(spark, 4)


def all_to_all(spark: SparkSession, n: int) -> DataFrame:
    near = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return _ranked(_channels(spark, n).withColumn("neighbor", near))


def stereo(spark: SparkSession, n: int, radius: int = 1) -> DataFrame:
    """Two columns of electrodes: neighbors are the pairs at most ``radius`` pairs away."""
    pair = F.floor(F.col("channel") / 2)
    lo, hi = F.greatest(F.lit(0), 2 * (pair - radius)), F.least(F.lit(n - 1), 2 * (pair + radius) + 1)
    return _ranked(_channels(spark, n).withColumn("neighbor", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))))


def linear(spark: SparkSession, n: int, reach: int = 1) -> DataFrame:
    """One column of electrodes: neighbors are at most ``reach`` away."""
    lo, hi = F.greatest(F.lit(0), F.col("channel") - reach), F.least(F.lit(n - 1), F.col("channel") + reach)
    return _ranked(_channels(spark, n).withColumn("neighbor", F.explode(F.sequence(lo, hi))))


def by_distance(layout: DataFrame, radius: float) -> DataFrame:
    """Electrodes (channel, x, y) closer than ``radius``; cells of that width meet their eight neighbors only."""
    cell = layout.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cell.select("channel", "x", "y", F.explode(around).alias("c")).select("channel", "x", "y", "c.cx", "c.cy")
    right = cell.select(F.col("channel").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"), "cx", "cy")
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    return _ranked(left.join(right, ["cx", "cy"]).where(dx * dx + dy * dy < radius * radius).select("channel", "neighbor"))


#: Named layouts.
PROBES = {"single": single, "tetrode": tetrode, "8x2": lambda s: stereo(s, 16), "16x2": lambda s: stereo(s, 32), "24x1": lambda s: linear(s, 24)}
