"""Finished neurons: pairwise confusion, merged units, summaries across segments and channels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions.nummath import norm_sf
from fluxweave.operators import trains, units
from fluxweave.operators.vectors import best_shift


def equal_variance_boundary(mu1: float, mu2: float, var: float, p1: float = 0.5) -> float:
    """Where two normal densities of one variance, weighted by p1 and 1 - p1, are equal."""
    return (mu1 + mu2) / 2 + var * math.log((1 - p1) / p1) / (mu1 - mu2)


def boundary(mu1: float, mu2: float, var1: float, var2: float) -> float:
    """Where two normal densities are equal: of the two roots that of the higher density."""
    if var1 == var2:
        return (mu1 + mu2) / 2
    a, b = 1 / var1 - 1 / var2, -2 * (mu1 / var1 - mu2 / var2)
    c = mu1 * mu1 / var1 - mu2 * mu2 / var2 + math.log(var1 / var2)
    roots = [(-b + s * math.sqrt(max(0.0, b * b - 4 * a * c))) / (2 * a) for s in (1, -1)]
    return max(roots, key=lambda x: math.exp(-((x - mu1) ** 2) / (2 * var1)) / math.sqrt(var1))


def pairwise_confusion(stats: DataFrame, templates: DataFrame, channels: int, width: int, unit: str = "unit") -> DataFrame:
    """(unit_1, unit_2, p): chance that an event of unit_2, at the best shift, passes the threshold of unit_1; the pair
    of a unit with itself gives the chance that its own events do. ``stats`` comes from ``vectors.separability``."""
    a = stats.join(templates.select(unit, "template"), unit).select(F.col(unit).alias("unit_1"), F.col("template").alias("t1"), F.col("ss").alias("s1"), F.col("sd").alias("d1"), F.col("pursuit_threshold").alias("thr"))
    b = templates.select(F.col(unit).alias("unit_2"), F.col("template").alias("t2"))
    reach = max(1, width // 4 - 1)
    score = best_shift(F.col("t1"), F.col("t2"), channels, width, reach)["score"]

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(norm_sf(x.to_numpy(dtype=np.float64)))

    x = (F.col("thr") - (score - 0.5 * F.col("s1"))) / F.greatest("d1", F.lit(1e-300))
    return a.crossJoin(F.broadcast(b)).select("unit_1", "unit_2", tail(x).alias("p"))  # rows are units, not events


def separability_matrix(confusion: DataFrame) -> DataFrame:
    """(unit, misses, contamination): a unit's own events below its threshold, and the highest chance of another's above."""
    own = confusion.where("unit_1 = unit_2").select(F.col("unit_1").alias("unit"), (1 - F.col("p")).alias("misses"))
    other = confusion.where("unit_1 <> unit_2").groupBy(F.col("unit_1").alias("unit")).agg(F.max("p").alias("contamination"))
    return own.join(other, "unit", "left").withColumn("contamination", F.coalesce("contamination", F.lit(0.0)))


def merge_units(events: DataFrame, keep: int, gone: int, tolerance: int, unit: str = "unit") -> DataFrame:
    """``events`` (unit, idx, sse) with unit ``gone`` joined to ``keep``; of repeated events that of lower error stays."""
    both = events.withColumn(unit, F.when(F.col(unit) == gone, F.lit(keep).cast(events.schema[unit].dataType)).otherwise(F.col(unit)))
    merged = trains.drop_duplicates_by_error(both.where(F.col(unit) == keep), tolerance, [unit])
    return both.where(F.col(unit) != keep).unionByName(merged)


def join_neurons(events: DataFrame, fs: float, tolerance: int, refractory: int, key: str = "id") -> DataFrame:
    """One row a neuron from events (id, seg, channel, idx, sse, snr): repeated events dropped across channels, SNR as the
    mean over events, duration, rate and interval metrics from what is left."""
    kept = trains.drop_duplicates_by_error(events, tolerance, [key])
    each = kept.groupBy(key).agg(
        F.array_sort(F.collect_set("channel")).alias("channel"),
        F.avg("snr").alias("snr"),
        ((F.max("idx") - F.min("idx")) / fs).alias("duration_s"),
        F.count("*").alias("n_spikes"),
    )
    by_channel = kept.groupBy(key, "channel").agg(F.avg("snr").alias("s")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "s")))).alias("snr_by_channel"))
    report = trains.isi_report(kept, fs, tolerance, refractory, key).select(key, "firing_rate", "violation_rate", "fraction_mua")
    return each.join(by_channel, key).join(report, key)


def keep_seen_often(chains: DataFrame, least_segments: int) -> DataFrame:
    """Chains (seg, unit, root_seg, root_unit) that stand in at least so many segments."""
    root = Window.partitionBy("root_seg", "root_unit")
    return chains.withColumn("__n", F.count("*").over(root)).where(F.col("__n") >= least_segments).drop("__n")


def link_by_label(units_by_segment: DataFrame) -> DataFrame:
    """(seg, unit_1, unit_2): units of neighboring segments with one label on one channel."""
    later = units_by_segment.select((F.col("seg") - 1).alias("seg"), "channel", "label", F.col("unit").alias("unit_2"))
    return units_by_segment.join(later, ["seg", "channel", "label"]).select("seg", F.col("unit").alias("unit_1"), "unit_2")


def redundant_within_channel(neurons: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neurons (id, mua, snr, n) left when redundant ones of each pair (unit_1, unit_2, ...) are deleted."""
    left = neurons.select(F.lit(0).alias("seg"), F.col("id").alias("unit"), "mua", "snr", "n")
    gone = units.drop_redundant(left, pairs.withColumn("seg", F.lit(0))).select(F.col("unit").alias("id"))
    return neurons.join(gone, "id", "left_anti")
