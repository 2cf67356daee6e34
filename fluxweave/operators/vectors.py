"""Templates and separability on waveform vectors.

A clip table has a unit, an event id and an array of values: channels one after the other, ``width`` samples each.
Statistics by position explode the arrays once and aggregate by (unit, position), which combines before the shuffle;
what needs single vectors uses higher-order functions and stays in the row.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.operators import signal

MAD = 0.6745


def doubles(c: str | Column) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def positions(clips: DataFrame, unit: str = "unit", clip: str = "clip") -> DataFrame:
    """(unit, pos, v) of every value."""
    return clips.select(unit, F.posexplode(doubles(clip)).alias("pos", "v"))


def gather(rows: DataFrame, unit: str = "unit", value: str = "v", name: str = "template") -> DataFrame:
    """(unit, name): values put back into an array in the order of their positions."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy(unit).agg(F.transform(ordered, lambda x: x[value]).alias(name))


def mean_template(clips: DataFrame, unit: str = "unit", clip: str = "clip") -> DataFrame:
    return gather(positions(clips, unit, clip).where(~F.isnan("v")).groupBy(unit, "pos").agg(F.avg("v").alias("v")), unit)


def median_template(clips: DataFrame, unit: str = "unit", clip: str = "clip") -> DataFrame:
    return gather(positions(clips, unit, clip).where(~F.isnan("v")).groupBy(unit, "pos").agg(F.median("v").alias("v")), unit)


def robust_template(clips: DataFrame, unit: str = "unit", clip: str = "clip") -> DataFrame:
    """By position: the median of the values strictly within the scaled MAD of the median; the median if none is."""
    rows = positions(clips, unit, clip)
    mid = rows.groupBy(unit, "pos").agg(F.median("v").alias("mid"))
    spread = rows.join(mid, [unit, "pos"]).withColumn("d", F.abs(F.col("v") - F.col("mid")))
    mad = spread.groupBy(unit, "pos").agg((F.median("d") / MAD).alias("mad"))
    inner = spread.join(mad, [unit, "pos"]).groupBy(unit, "pos").agg(F.median(F.when(F.col("d") < F.col("mad"), F.col("v"))).alias("m"), F.max("mid").alias("mid"))
    return gather(inner.select(unit, "pos", F.coalesce("m", "mid").alias("v")), unit)


def sum_squares(c: str | Column) -> Column:
    return F.aggregate(doubles(c), F.lit(0.0), lambda a, x: a + x * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def first_argmax(c: Column) -> Column:
    """Place (from 0) of the first highest value."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def peak_position(clip: str = "clip") -> Column:
    return first_argmax(F.transform(F.col(clip), lambda x: F.abs(x)))


def keep_peak_on_channel(clips: DataFrame, channel: int, width: int, clip: str = "clip") -> DataFrame:
    """Clips whose largest |value| lies on the given channel."""
    return clips.where(F.floor(peak_position(clip) / width) == channel)


def half_width(template: str = "template") -> Column:
    t = F.col(template)
    return F.abs(F.array_position(t, F.array_max(t)) - F.array_position(t, F.array_min(t))).cast("int")


def channel_slice(c: Column, channel: Column | int, width: int) -> Column:
    return F.slice(c, channel * width + 1, width)


def channel_snr(templates: DataFrame, width: int, channels: int, noise: Column | float, template: str = "template") -> DataFrame:
    """One row a unit and channel: (max - min) / (3 * noise)."""
    rows = templates.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    part = channel_slice(F.col(template), F.col("channel"), width)
    return rows.withColumn("snr", (F.array_max(part) - F.array_min(part)) / (3 * noise))


def peak_channel(template: str, width: int) -> Column:
    return F.floor(peak_position(template) / width).cast("int")


def cleanup(clips: DataFrame, unit: str = "unit", key: str = "event", clip: str = "clip", total_sd: float = 5.0, unit_sd: float = 2.0) -> DataFrame:
    """(unit, key) of clips that stay: energy within five deviations of all clips' mean, then squared error to the
    unit's mean clip within two deviations of the unit's mean; population deviations."""
    energy = clips.withColumn("ss", sum_squares(clip))
    ends = energy.agg(F.avg("ss").alias("m"), F.stddev_pop("ss").alias("s"))  # one row
    kept = energy.crossJoin(F.broadcast(ends)).where((F.col("ss") >= F.col("m") - total_sd * F.col("s")) & (F.col("ss") <= F.col("m") + total_sd * F.col("s")))
    error = kept.join(mean_template(kept, unit, clip), unit).withColumn("sse", F.aggregate(F.zip_with(F.col(clip), "template", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    by_unit = Window.partitionBy(unit)
    stats = error.withColumn("m", F.avg("sse").over(by_unit)).withColumn("s", F.stddev_pop("sse").over(by_unit))
    return stats.where((F.col("sse") >= F.col("m") - unit_sd * F.col("s")) & (F.col("sse") <= F.col("m") + unit_sd * F.col("s"))).select(unit, key)


def nearest_to_centroid(clips: DataFrame, n: int, unit: str = "unit", key: str = "event", clip: str = "clip") -> DataFrame:
    """(unit, key, rank): the n clips of each unit that are closest to its mean; ties go to the smaller key."""
    rows = clips.join(mean_template(clips, unit, clip), unit)
    far = F.aggregate(F.zip_with(F.col(clip), "template", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy(unit).orderBy(F.round(far, 9), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(unit, key, "rank")


def mutual_nearest(centroids: DataFrame, unit: str = "unit", template: str = "template", excluded: DataFrame | None = None) -> DataFrame:
    """(unit_1, unit_2, distance): pairs that are each other's nearest; ties go to the smaller label.

    ``excluded`` (unit_1, unit_2) are pairs not to be compared again. Centroids are one row a cluster; the pairs are
    those of labels, never of events.
    """
    a = centroids.select(F.col(unit).alias("unit_1"), F.col(template).alias("t1"))
    b = centroids.select(F.col(unit).alias("unit_2"), F.col(template).alias("t2"))
    pairs = a.join(b, F.col("unit_1") != F.col("unit_2"))
    if excluded is not None:
        both = excluded.select("unit_1", "unit_2").union(excluded.select("unit_2", "unit_1"))
        pairs = pairs.join(both, ["unit_1", "unit_2"], "left_anti")
    far = F.aggregate(F.zip_with("t1", "t2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("unit_1").orderBy("distance", "unit_2")
    near = pairs.withColumn("distance", far).withColumn("r", F.row_number().over(order)).where("r = 1").select("unit_1", "unit_2", "distance")
    back = near.select(F.col("unit_2").alias("unit_1"), F.col("unit_1").alias("unit_2"))
    return near.join(back, ["unit_1", "unit_2"]).where("unit_1 < unit_2")


def best_shift(a: Column, b: Column, channels: int, width: int, reach: int) -> Column:
    """struct(score, shift) of the highest cross-correlation of two templates, shifted alike on every channel by at
    most ``reach`` samples; ties go to the smallest shift."""

    def at(shift: int) -> Column:
        parts = []
        for c in range(channels):
            x, y = F.slice(a, c * width + 1 + max(0, -shift), width - abs(shift)), F.slice(b, c * width + 1 + max(0, shift), width - abs(shift))
            parts.append(dot(x, y))
        return F.struct(functools.reduce(lambda p, q: p + q, parts).alias("score"), F.lit(-shift).alias("order"))

    best = F.array_max(F.array(*[at(s) for s in range(-reach, reach + 1)]))
    return F.struct(best["score"].alias("score"), (-best["order"]).alias("shift"))


def merge_templates(a: Column, n_a: Column, b: Column, n_b: Column, channels: int, width: int, shift: int = 0) -> Column:
    """Mean of two templates weighted by their events; the second is shifted on each channel, gaps keep the first."""
    moved = []
    for c in range(channels):
        for i in range(width):
            j = i + shift
            x = F.element_at(a, c * width + i + 1)
            moved.append((x * n_a + F.element_at(b, c * width + j + 1) * n_b) / (n_a + n_b) if 0 <= j < width else x)
    return F.array(*moved)


def residual_covariance(clips: DataFrame, channels: int, width: int, unit: str = "unit", clip: str = "clip", key: str = "event") -> DataFrame:
    """(channel, i, j, cov): population covariance of clips less their unit's mean, by channel; i <= j.

    Pairs of positions are made inside the row, so the shuffle carries sums by (channel, i, j) only.
    """
    rows = clips.join(mean_template(clips, unit, clip), unit).select(F.zip_with(F.col(clip), "template", lambda x, y: x.cast("double") - y).alias("r"))
    rows = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("x", channel_slice(F.col("r"), F.col("channel"), width))
    rows = rows.select("channel", "x", F.posexplode("x").alias("i", "vi"))
    rows = rows.select("channel", "i", "vi", F.posexplode("x").alias("j", "vj")).where("i <= j")
    return rows.groupBy("channel", "i", "j").agg(F.covar_pop("vi", "vj").alias("cov"))


def covariance_matrices(cov: DataFrame) -> DataFrame:
    """(channel, cov): full matrices as rows of arrays, from the upper halves."""
    full = cov.union(cov.where("i < j").select("channel", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    rows = full.groupBy("channel", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"]).alias("row"))
    return rows.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("cov"))


def template_variance(templates: DataFrame, cov: DataFrame, width: int, unit: str = "unit", template: str = "template") -> DataFrame:
    """(unit, ss, variance): energy and the sum over channels of t' C t."""
    rows = templates.select(unit, template, sum_squares(template).alias("ss"), F.posexplode(template).alias("at", "ti"))
    left = rows.select(unit, "ss", F.floor(F.col("at") / width).cast("int").alias("channel"), (F.col("at") % width).alias("i"), "ti", template)
    joined = left.join(F.broadcast(cov), ["channel", "i"])  # channels * width**2 rows, fixed by the probe and the clip
    tj = F.element_at(F.col(template), (F.col("channel") * width + F.col("j") + 1).cast("int"))
    term = F.when(F.col("i") == F.col("j"), F.col("ti") * tj * F.col("cov")).otherwise(2 * F.col("ti") * tj * F.col("cov"))
    return joined.groupBy(unit, "ss").agg(F.sum(term).alias("variance"))


def separability(stats: DataFrame, k_noise: float, k_ci: float | None) -> DataFrame:
    """``stats`` (unit, ss, variance) with sd, lower_ci, threshold, noisy and the clamped pursuit_threshold."""
    sd = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    low = F.lit(float("-inf")) if k_ci is None else 0.5 * F.col("ss") - k_ci * sd
    out = stats.withColumn("sd", sd).withColumn("lower_ci", low).withColumn("threshold", -0.5 * F.col("ss") + k_noise * sd)
    return out.withColumn("noisy", 2 * F.col("threshold") > 0.5 * F.col("ss")).withColumn("pursuit_threshold", F.greatest("threshold", F.lit(0.0), "lower_ci"))


def contamination(stats: DataFrame) -> DataFrame:
    """``stats`` of ``separability`` with contamination: chance that noise alone passes the threshold."""
    from fluxweave.functions.nummath import norm_sf

    @F.pandas_udf("double")
    def tail(threshold: pd.Series, ss: pd.Series, sd: pd.Series) -> pd.Series:
        return pd.Series(norm_sf((threshold.to_numpy() + 0.5 * ss.to_numpy()) / np.maximum(sd.to_numpy(), 1e-300)))

    return stats.withColumn("contamination", tail("pursuit_threshold", "ss", "sd"))


def keep_useful_noise(stats: DataFrame, templates: DataFrame, k_noise: float, channels: int, width: int, unit: str = "unit") -> DataFrame:
    """``stats`` whose noisy units stay flagged only if no good unit could be helped by them: the chance that good unit
    and noisy one together pass the good one's threshold does not exceed that of noise."""
    from fluxweave.functions.nummath import norm_sf

    limit = float(norm_sf(np.array([k_noise]))[0])
    t = templates.select(unit, "template")
    good = stats.where("not noisy").join(t, unit).select(F.col("template").alias("g"), F.col("ss").alias("gs"), F.col("sd").alias("gd"), F.col("pursuit_threshold").alias("gt"))
    bad = stats.where("noisy").join(t, unit).select(unit, F.col("template").alias("b"))
    score = best_shift(F.col("g"), F.col("b"), channels, width, width // 4)["score"]

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(norm_sf(x.to_numpy()))

    helped = good.crossJoin(bad).withColumn("p", tail((F.col("gt") - (score - 0.5 * F.col("gs"))) / F.col("gd"))).where(F.col("p") > limit).select(unit).distinct().withColumn("__kept", F.lit(True))
    return stats.join(helped, unit, "left").withColumn("noisy", F.col("noisy") & F.col("__kept").isNull()).drop("__kept")


def projection_scores(clips: DataFrame, templates: DataFrame, unit: str = "unit", key: str = "event", clip: str = "clip") -> DataFrame:
    """(key, template_unit, score): clips on each template; templates are one row a unit."""
    t = templates.select(F.col(unit).alias("template_unit"), "template")
    return clips.crossJoin(F.broadcast(t)).select(key, "template_unit", dot(F.col(clip), F.col("template")).alias("score"))


def likelihood(templates: DataFrame, voltage: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, sample, value): -ss / 2 + sum of template * voltage over the window that starts at each sample.

    ``voltage`` (channel, sample, v), ``templates`` (unit, channel, pos, t): as many rows as units, channels and a window
    make, so they go with the task. Blocks of voltage with a halo of a window are correlated with them channel by
    channel. Windows not whole are left out, missing samples count as zero.
    """
    shapes: dict = {}
    for r in templates.select(unit, "channel", "pos", "t").collect():
        shapes.setdefault(r[0], {}).setdefault(r["channel"], {})[r["pos"]] = r["t"]
    width = 1 + max((p for by in shapes.values() for at in by.values() for p in at), default=-1)
    last = voltage.agg(F.max("sample")).first()[0]
    kind, size = templates.schema[unit].dataType.simpleString(), signal.SCAN
    named = {u: {c: np.array([at.get(p, 0.0) for p in range(width)]) for c, at in by.items()} for u, by in shapes.items()}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * size
        starts = np.arange(max(first, 0), min(first + size, last - width + 1))
        names = sorted(pdf["channel"].unique())
        grid, at = signal._grid(pdf, names)
        if not len(starts) or not width:
            return pd.DataFrame({unit: [], "sample": [], "value": []})
        wide = np.zeros((len(names), len(starts) + width - 1))
        lo, hi = max(at, starts[0]), min(at + grid.shape[1], starts[0] + wide.shape[1])
        if hi > lo:
            wide[:, lo - starts[0] : hi - starts[0]] = np.nan_to_num(grid[:, lo - at : hi - at])
        out = []
        for u, by in named.items():
            value = -0.5 * sum(float((t * t).sum()) for t in by.values()) + np.zeros(len(starts))
            for c, t in by.items():
                if c in names:
                    value += np.correlate(wide[names.index(c)], t, mode="valid")
            out.append(pd.DataFrame({unit: u, "sample": starts, "value": value}))
        return pd.concat(out) if out else pd.DataFrame({unit: [], "sample": [], "value": []})

    rows = signal.halo(voltage.select("channel", "sample", F.col("v").cast("double").alias("v")), 0, max(0, width - 1)).drop("own")
    return rows.groupBy("block").applyInPandas(run, f"{unit} {kind}, sample long, value double")


def subtract(voltage: DataFrame, spikes: DataFrame, templates: DataFrame, unit: str = "unit") -> DataFrame:
    """Voltage less the templates of found events (unit, sample)."""
    taken = spikes.join(F.broadcast(templates), unit).groupBy("channel", (F.col("sample") + F.col("pos")).alias("sample")).agg(F.sum("t").alias("__t"))
    return voltage.join(taken, ["channel", "sample"], "left").withColumn("v", F.col("v") - F.coalesce("__t", F.lit(0.0))).select(*voltage.columns)
