"""Units of a segment from all channels: summaries, consolidation, and what is kept of them for matching.

Clips are (seg, channel, unit, sample, clip on all channels). A unit's events in a segment, or all units of one segment,
are one group: the segment's duration bounds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions import consolidation, covariance
from fluxweave.functions.consolidation import Unit
from fluxweave.operators import signal

UNITS = "seg int, channel int, unit long, n long, template array<double>, snr array<double>, high array<int>, neighbors array<int>, samples array<long>"


def _units(pdf: pd.DataFrame, thresholds: dict, neighbors: dict[int, list[int]], channels: int, sigma: float, tolerance: int, least: float) -> list[Unit]:
    seg = int(pdf["seg"].iloc[0])
    noise = np.array([thresholds[seg, c] for c in range(channels)])
    found = []
    for (channel, label), rows in pdf.groupby(["channel", "unit"], sort=True):
        unit = Unit(int(channel), np.array(neighbors.get(int(channel), range(channels))), rows["sample"].to_numpy(), np.stack(rows["clip"].to_list()), int(label), noise)
        if unit.clips.shape[1] % channels:
            raise ValueError("clips must hold all channels")
        if consolidation.summarise(unit, sigma, tolerance, least) is not None:
            found.append(unit)
    return found


def _rows(seg: int, units: list[Unit]) -> pd.DataFrame:
    rows = [(seg, u.channel, u.label, len(u.events), u.template, u.snr, u.high, u.neighbors, u.events) for u in units]
    return pd.DataFrame(rows, columns=["seg", "channel", "unit", "n", "template", "snr", "high", "neighbors", "samples"])


def threshold_table(thresholds: DataFrame) -> dict[tuple[int, int], float]:
    """{(seg, channel): threshold}: one number a segment and channel."""
    return {(int(r.seg), int(r.channel)): float(r.threshold) for r in thresholds.select("seg", "channel", "threshold").collect()}


def summaries(clustered: DataFrame, thresholds: DataFrame, channels: int, sigma: float, tolerance: int, neighbors: dict[int, list[int]] | None = None, least: float = consolidation.LEAST_SNR) -> DataFrame:
    """One row a unit and segment: repeated events dropped, median template, SNR of each channel, channels that stand out.
    Units whose own channel's SNR is below ``least`` are left out."""
    table = threshold_table(thresholds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(int(pdf["seg"].iloc[0]), _units(pdf, table, neighbors or {}, channels, sigma, tolerance, least))

    return clustered.groupBy("seg", "channel", "unit").applyInPandas(run, UNITS)


def sharpen_across_channels(clustered: DataFrame, thresholds: DataFrame, channels: int, sigma: float, tolerance: int, most: int, p_cut: float = 0.01, neighbors: dict[int, list[int]] | None = None, noise: DataFrame | None = None, seed: int = 0, **options) -> DataFrame:
    """The units of each segment with those merged that are one source, by the cut test and, where ``noise`` (channel, cov)
    is given, then by confusion of their templates. Labels are numbered anew within a segment."""
    table = threshold_table(thresholds)
    cov = None if noise is None else [np.array(r.cov, dtype=np.float64) for r in sorted(noise.select("channel", "cov").collect(), key=lambda r: r.channel)]  # channels * width**2 numbers

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        units = _units(pdf, table, neighbors or {}, channels, sigma, tolerance, consolidation.LEAST_SNR)
        units = consolidation.sharpen(units, channels, most, p_cut, seed=seed, **options)
        if cov is not None:
            units = consolidation.sharpen(units, channels, most, p_cut, cov, seed=seed, **options)
        for k, unit in enumerate(units):
            unit.label = k
        return _rows(int(pdf["seg"].iloc[0]), units)

    return clustered.groupBy("seg").applyInPandas(run, UNITS)


def check_alignment(clips: DataFrame, p_cut: float = 0.01, keys: tuple[str, ...] = ("seg", "channel"), seed: int = 0) -> DataFrame:
    """(keys, unit, event, sample): events of one channel's clusters, moved where clusters are the same once shifted.
    ``clips`` (keys, unit, event, clip) are the channel's own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event").reset_index(drop=True)
        moved, _ = consolidation.check_alignment(np.stack(pdf["clip"].to_list()), pdf["event"].to_numpy(), pdf["unit"].to_numpy(), p_cut, seed=seed)
        return pdf[[*keys, "unit", "event"]].assign(sample=moved)

    kinds = ", ".join(f"{k} {clips.schema[k].dataType.simpleString()}" for k in (*keys, "unit"))
    return clips.groupBy(*keys).applyInPandas(run, f"{kinds}, event long, sample long")


def zero_weak_channels(units: DataFrame, least: float | None, template: str = "template", snr: str = "snr") -> DataFrame:
    """``units`` whose templates are zero on the channels whose SNR is below ``least``."""
    if not least or least <= 0:
        return units
    width = F.size(template) / F.size(snr)
    return units.withColumn(template, F.transform(template, lambda x, i: F.when(F.get(F.col(snr), F.floor(i / width).cast("int")) < least, F.lit(0.0)).otherwise(x)))


def with_templates(units: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ("seg", "unit"), least: float | None = None) -> DataFrame:
    """``units`` with the templates of another table (keys, template), weak channels zeroed."""
    return zero_weak_channels(units.drop("template").join(templates.select(*keys, "template"), list(keys)), least).select(*units.columns)


def delete_noise_units(stats: DataFrame, unit: str = "unit") -> DataFrame:
    """``stats`` without the units flagged ``noisy``, with ``label`` 0..n-1 in the order of the old ones. One row a unit."""
    kept = stats.where(~F.col("noisy"))
    return kept.withColumn("label", (F.row_number().over(Window.orderBy(unit)) - 1).cast("long"))


def add_counts(stats: DataFrame, events: DataFrame, unit: str = "unit") -> DataFrame:
    """``stats`` with ``n_spikes``, the events found for each unit; 0 where there are none."""
    counts = events.groupBy(unit).agg(F.count("*").alias("n_spikes"))
    return stats.join(counts, unit, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)).cast("long"))


def adjusted_clips(clips: DataFrame, templates: DataFrame, unit: str = "unit") -> DataFrame:
    """Clips of the residual (unit, .., clip) with their own unit's template added back, so without all other events."""
    rows = clips.join(templates.select(unit, "template"), unit)
    return rows.withColumn("clip", F.zip_with("clip", "template", lambda x, t: x + t)).select(*clips.columns)


def noise_covariance(voltage: DataFrame, before: int, after: int, n_samples: int = 100_000, seed: int = 0) -> DataFrame:
    """(channel, cov array<array<double>>): covariance over time of ``n_samples`` random windows of each channel, with the
    correction and re-weighting of the robust estimate over all of them, about a mean of zero."""
    ends = voltage.groupBy("channel").agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    draws = voltage.sparkSession.range(n_samples).crossJoin(F.broadcast(ends))  # one row a channel
    at = F.col("lo") + before + F.floor(F.rand(seed) * (F.col("hi") - F.col("lo") - before - after))
    events = draws.where(F.col("hi") - F.col("lo") > before + after).select("channel", at.cast("long").alias("sample"))
    rows = signal.clips(voltage, events, before, after)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, cov, _ = covariance.min_cov_det(np.stack(pdf.sort_values("event")["clip"].to_list()), support=1.0, centred=True)
        return pd.DataFrame({"channel": pdf["channel"].iloc[:1], "cov": [[list(map(float, r)) for r in cov]]})

    return rows.groupBy("channel").applyInPandas(run, f"channel {voltage.schema['channel'].dataType.simpleString()}, cov array<array<double>>")
