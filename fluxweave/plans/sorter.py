"""The sort as a chain of tables: voltage -> segments -> events -> clusters -> templates -> matched events -> neurons.

Every stage is DataFrame -> DataFrame and keyed by segment and channel (clustering), segment and block (matching) or
segment (consolidation); tables between stages are written to the shared folder. Only templates, N x N whitening sums,
thresholds and segment bounds are small enough for the driver: their sizes follow from the probe, the clip and the number
of units and segments, not from the recording. With ``wiener`` the events of a first pass make a filter of each segment,
and the second pass starts from the filtered voltage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.functions import clustering, pursuit
from fluxweave.operators import consolidate as consolidation
from fluxweave.operators import filters, postprocess, signal, trains, vectors
from fluxweave.operators.settings import SortSettings
from fluxweave.sources.stages import staged

#: Samples of a matching block without its halo.
BLOCK = 1 << 17


@dataclass
class Sorted:
    """What a sort leaves: events (seg, channel, unit, sample, sse, clip), templates (seg, channel, unit, template), units
    (seg, channel, unit, metrics) of all segments, redundant ones included."""

    events: DataFrame
    templates: DataFrame
    units: DataFrame
    segments: list[tuple[int, int]]
    fs: int
    channels: int
    width: int
    before: int
    settings: SortSettings
    neighbors: dict[int, list[int]]


def prepare(voltage: DataFrame, fs: int, settings: SortSettings, n_samples: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(seg, channel, sample, v) filtered, cleaned, whitened and dealt to segments."""
    v = voltage.select(F.col("channel").cast("int"), F.col("sample").cast("long"), F.col("v").cast("double").alias("v"))
    if settings.do_filter:
        v = filters.bandpass(v, settings.filter_band[0], min(settings.filter_band[1], 0.45 * fs), fs)
    if settings.remove_artifacts:
        thr = signal.thresholds(v, settings.sigma)
        cushion = tuple(round(c * fs) for c in settings.artifact_cushion)
        v = signal.blank_artifacts(v, thr, cushion, round(settings.artifact_tolerance * fs), settings.artifact_channels)
    if settings.do_zca:
        thr = signal.thresholds(v, settings.sigma)
        lo, hi = signal.time_window_samples(settings.clip_width, fs)
        weights = filters.zca_weights(signal.noise_products(signal.noise_mask(v, thr, max(-lo, hi))))
        v = signal.apply_mixing(v, F.broadcast(weights))
    duration = n_samples if settings.segment_duration is None else int(settings.segment_duration * fs)
    overlap = 3 * round(2 * settings.clip_width[1] * fs) if settings.segment_overlap is None else int(np.ceil(settings.segment_overlap * fs))
    segments = signal.plan_segments(n_samples, duration, overlap)
    step = segments[1][0] - segments[0][0] if len(segments) > 1 else n_samples
    return signal.assign_segments(v, segments[0][1] - segments[0][0], step, len(segments)), segments


def detect(voltage: DataFrame, fs: int, settings: SortSettings) -> DataFrame:
    """(seg, channel, sample) of aligned events that keep their dead time."""
    keys = ("seg", "channel")
    reach = round(settings.clip_width[1] * fs)
    up = signal.crossings(voltage, signal.thresholds(voltage, settings.sigma, keys), keys)
    peaks = signal.align_to_peak(voltage, up, reach, reach, keys).select(*keys, F.col("peak").alias("sample")).distinct()
    return trains.dead_time(staged(peaks, "peaks"), max(1, reach - 1), list(keys))


def gather_clips(voltage: DataFrame, events: DataFrame, before: int, after: int, channels: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(seg, extra.., event, clip): each event's window on all channels, joined in channel order."""
    shared = events.select("seg", F.lit(0).alias("channel"), "sample").distinct()
    every = events.sparkSession.range(channels).select(F.lit(0).alias("channel"), F.col("id").cast("int").alias("neighbor"), F.col("id").cast("int").alias("pos"))
    found = signal.neighborhood_clips(voltage, shared, every, before, after, ("seg",)).select("seg", "event", "clip")
    return events.select("seg", *extra, F.col("sample").alias("event")).join(found, ["seg", "event"]).select("seg", *extra, "event", "clip")


def cluster(clips: DataFrame, channels: int, settings: SortSettings) -> DataFrame:
    """(seg, channel, unit, sample, clip) of clustered events whose peak lies on their own channel."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event").reset_index(drop=True)
        x = np.stack(pdf["clip"].to_list()) if len(pdf) else np.empty((0, 1))
        channel = int(key[1])
        width = x.shape[1] // channels
        if len(pdf):
            main = np.abs(x).argmax(axis=1) // width == channel
            pdf, x = pdf[main].reset_index(drop=True), x[main]
        if len(pdf) < 2:
            return pd.DataFrame(columns=["seg", "channel", "unit", "sample", "clip"], dtype=object)
        seed = settings.seed + 1009 * int(key[0]) + channel
        features = lambda c: clustering.pca_features(c, settings.check_components, settings.max_components, seed=seed)
        own = x[:, channel * width : (channel + 1) * width]
        scores = features(own)
        n = len(x)
        labels = clustering.seed_farthest(scores, max(2, min(100, round(n / 40))), n_random=max(2, min(100, round(n / 100))), seed=seed)
        options = {"match_size": settings.match_cluster_size, "check_splits": settings.check_splits, "seed": seed}
        labels = clustering.merge_clusters(scores, labels, settings.p_cut, **options)
        if settings.do_branch_pca:
            for _ in range(2):
                template = clustering.template_features(x, labels, settings.max_components)
                if template is not None:
                    labels = clustering.merge_clusters(template, labels, settings.p_cut, merge_only=True, **options)
            labels = clustering.merge_clusters(features(x), labels, settings.p_cut, **options)
            by_channel = lambda c: clustering.pca_by_channel(c, channel, channels, settings.check_components, settings.max_components, seed)
            labels = clustering.branch(x, labels, by_channel, settings.p_cut, seed, settings.match_cluster_size, settings.check_splits)
        return pd.DataFrame({"seg": int(key[0]), "channel": channel, "unit": clustering.dense(labels), "sample": pdf["event"], "clip": list(x)})

    return clips.groupBy("seg", "channel").applyInPandas(run, "seg int, channel int, unit long, sample long, clip array<double>")


def without_sums(units: pd.DataFrame, channels: int) -> pd.DataFrame:
    """Units (template, n) of one segment that are not the sum, at any shifts, of two with four times their events."""
    units = units.sort_values(["n", "channel", "unit"], ascending=[False, True, True])
    kept: list[tuple[np.ndarray, int]] = []
    rows = []
    for row, (t, n) in enumerate(zip(units["template"], units["n"], strict=True)):
        t = np.asarray(t).reshape(channels, -1)
        width, energy = t.shape[1], float((t * t).sum())
        moves = []
        for other, m in kept:
            if m >= 4 * n:
                wide = np.pad(other, ((0, 0), (width, width)))
                moves.append(np.stack([wide[:, s : s + width].ravel() for s in range(width // 2, 2 * width - width // 2 + 1)]))
        f, least = t.ravel(), np.inf
        for i, a in enumerate(moves):
            for b in moves[i + 1 :]:
                rest = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] + energy + 2 * a @ b.T - 2 * (a @ f)[:, None] - 2 * (b @ f)[None, :]
                least = min(least, float(rest.min()))
        if energy > 0 and least >= 0.25 * energy:
            kept.append((t, int(n)))
            rows.append(row)
    return units.iloc[rows]


def consolidate(clustered: DataFrame, thresholds: DataFrame, noise: DataFrame | None, channels: int, width: int, settings: SortSettings, neighbors: dict[int, list[int]], least_events: int = 10) -> DataFrame:
    """(seg, channel, unit, template, n, snr, samples): one template for each source in a segment, from all channels'
    clusters; units are numbered through the segment. Sums of two other templates are no source of their own."""
    found = consolidation.sharpen_across_channels(
        clustered, thresholds, channels, settings.sigma, width, width // 2, settings.p_cut, neighbors, noise, settings.seed,
        check=settings.check_components, components=settings.max_components, match_size=settings.match_cluster_size, check_splits=settings.check_splits,
    )
    found = found.where(F.col("n") >= least_events).select("seg", "channel", "unit", "template", "n", "snr", "samples")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return without_sums(pdf, channels)

    return found.groupBy("seg").applyInPandas(run, found.schema)


def explained(clustered: DataFrame, units: DataFrame, before: int) -> DataFrame:
    """(seg, channel, sample, signal): what the units' events explain of the voltage, each by its robust template."""
    events = units.select("seg", "unit", F.explode("samples").alias("sample"))
    clips = events.join(clustered.select("seg", "sample", "clip").dropDuplicates(["seg", "sample"]), ["seg", "sample"]).withColumn("key", F.struct("seg", "unit"))
    shapes = vectors.robust_template(clips, "key").select("key.seg", "key.unit", "template")
    width = F.floor(F.size("template") / F.col("channels"))
    channels = units.select(F.size("snr").alias("channels")).limit(1)
    shapes = shapes.crossJoin(F.broadcast(channels)).select("seg", "unit", width.alias("width"), F.posexplode("template").alias("at", "t"))
    taken = events.join(shapes, ["seg", "unit"]).select("seg", F.floor(F.col("at") / F.col("width")).cast("int").alias("channel"), (F.col("sample") - before + F.col("at") % F.col("width")).alias("sample"), "t")
    return taken.groupBy("seg", "channel", "sample").agg(F.sum("t").alias("signal"))


def wiener_pass(voltage: DataFrame, clustered: DataFrame, thresholds: DataFrame, channels: int, width: int, before: int, fs: int, settings: SortSettings, neighbors: dict[int, list[int]]) -> DataFrame:
    """``voltage`` (seg, channel, sample, v) filtered by what the units of a first pass explain of it, segment by segment."""
    units = staged(consolidate(clustered, thresholds, None, channels, width, settings, neighbors, 2), "units")
    rows = voltage.join(explained(clustered, units, before), ["seg", "channel", "sample"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    sure = rows.join(units.select("seg").distinct(), "seg", "left_semi")  # a segment without units stays as it is
    filtered = filters.wiener_segments(sure, settings.wiener_smoothing, fs, settings.same_wiener)
    bare = voltage.join(units.select("seg").distinct(), "seg", "left_anti")
    return filtered.unionByName(bare.select(*filtered.columns))


def match(voltage: DataFrame, templates: DataFrame, segments: list[tuple[int, int]], channels: int, width: int, settings: SortSettings) -> DataFrame:
    """(seg, unit, sample): onsets found by matching templates to the residual, block by block with a halo of three widths.

    A block keeps the events that start in its own region. Thresholds follow from the noise left beside events."""
    halo = 3 * width
    first = F.col("sample") - F.element_at(F.array(*[F.lit(a) for a, _ in segments]), F.col("seg") + 1)
    near = F.array_distinct(F.array(F.floor((first - halo) / BLOCK), F.floor(first / BLOCK), F.floor((first + halo) / BLOCK)))
    blocks = voltage.withColumn("block", F.explode(near)).where("block >= 0")
    sets = templates.join(blocks.select(F.col("seg").alias("seg"), F.col("block").alias("b")).distinct(), "seg").withColumn("block", F.col("b") + 0).drop("b")

    def run(key, v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(t):
            return pd.DataFrame(columns=["seg", "unit", "sample"], dtype=object)
        t = t.sort_values("unit")
        shapes = np.stack([np.asarray(x).reshape(channels, width) for x in t["template"]])
        grid = v.pivot(index="channel", columns="sample", values="v").sort_index()
        start = int(grid.columns[0])
        data = np.nan_to_num(grid.to_numpy())
        sd = np.median(np.abs(data), axis=1) / 0.6745
        ss = (shapes**2).sum(axis=(1, 2))
        spread = np.sqrt(((shapes**2).sum(axis=2) * sd[None, :] ** 2).sum(axis=1))
        thresholds = np.maximum(0, -0.5 * ss + settings.sigma_noise * spread)
        if settings.sigma_ci is not None:
            thresholds = np.maximum(thresholds, 0.5 * ss - settings.sigma_ci * spread)
        found, at, _ = pursuit.pursue(data, shapes, thresholds, settings.overlap_reach)
        at = at + start
        own = segments[int(key[0])][0] + int(key[1]) * BLOCK
        keep = (at >= own) & (at < own + BLOCK)
        return pd.DataFrame({"seg": int(key[0]), "unit": t["unit"].to_numpy()[found[keep]], "sample": at[keep]})

    return blocks.groupBy("seg", "block").cogroup(sets.groupBy("seg", "block")).applyInPandas(run, "seg int, unit long, sample long")


def matched_clips(voltage: DataFrame, found: DataFrame, templates: DataFrame, channels: int, before: int, after: int) -> DataFrame:
    """(seg, channel, unit, sample, sse, clip): found events with their windows less all other events, and how far those
    are from the unit's template."""
    named = found.join(templates.select("seg", "channel", "unit", "template"), ["seg", "unit"])
    shape = templates.select("seg", F.col("unit").alias("u"), F.posexplode("template").alias("at", "t"), F.size("template").alias("size"))
    width = F.floor(F.col("size") / channels)
    taken = found.join(shape.withColumnRenamed("u", "unit"), ["seg", "unit"]).select("seg", F.floor(F.col("at") / width).cast("int").alias("channel"), (F.col("sample") - before + F.col("at") % width).alias("sample"), "t")
    taken = taken.groupBy("seg", "channel", "sample").agg(F.sum("t").alias("t"))
    residual = voltage.join(taken, ["seg", "channel", "sample"], "left").withColumn("v", F.col("v") - F.coalesce("t", F.lit(0.0))).select("seg", "channel", "sample", "v")
    clips = gather_clips(residual, found.select("seg", "unit", "sample"), before, after, channels, ("unit",)).withColumnRenamed("event", "sample")
    rows = clips.join(named, ["seg", "unit", "sample"]).withColumn("sse", vectors.sum_squares("clip"))
    return rows.select("seg", "channel", "unit", "sample", "sse", F.zip_with("clip", "template", lambda x, t: x + t).alias("clip"))


def sort(voltage: DataFrame, fs: int, settings: SortSettings | None = None, neighbors: dict[int, list[int]] | None = None) -> Sorted:
    """Sort a recording (channel 0..C-1, sample, v). ``neighbors`` of each channel come from the probe; all by default."""
    settings = settings or SortSettings()
    n_samples, channels = (int(x) for x in voltage.agg(F.max("sample") + 1, F.max("channel") + 1).first())
    neighbors = neighbors or {c: list(range(channels)) for c in range(channels)}
    lo, hi = signal.time_window_samples(settings.clip_width, fs)
    before, after = -lo, hi
    width = before + after
    v, segments = prepare(voltage, fs, settings, n_samples)
    v = staged(v.withColumn("seg", F.col("seg").cast("int")), "voltage")
    keys = ("seg", "channel")

    def clusters(v):
        thresholds = staged(signal.thresholds(v, settings.sigma, keys), "thresholds")
        events = staged(detect(v, fs, settings), "events")
        return staged(cluster(gather_clips(v, events, before, after, channels, ("channel",)), channels, settings), "clusters"), thresholds

    clustered, thresholds = clusters(v)
    if settings.wiener and not clustered.isEmpty():
        v = staged(wiener_pass(v, clustered, thresholds, channels, width, before, fs, settings, neighbors), "voltage")
        clustered, thresholds = clusters(v)
    noise = staged(consolidation.noise_covariance(v.where("seg = 0").drop("seg"), before, after, settings.n_cov_samples, settings.seed), "noise")
    templates = staged(consolidate(clustered, thresholds, noise, channels, width, settings, neighbors), "templates")
    found = match(v, templates, segments, channels, width, settings).withColumn("sample", F.col("sample") + before)
    events = staged(matched_clips(v, staged(found, "found"), templates, channels, before, after), "events")
    return Sorted(events, templates, summarise(events, templates, width, fs, settings), segments, fs, channels, width, before, settings, neighbors)


def summarise(events: DataFrame, templates: DataFrame, width: int, fs: int, settings: SortSettings) -> DataFrame:
    """(seg, channel, unit, n, firing_rate, violation_rate, mua, snr) of each unit and segment; SNR is the range of the
    template on the unit's channel over three deviations of the noise there."""
    keyed = events.select(F.struct("seg", "channel", "unit").alias("key"), F.col("sample").alias("idx"))
    report = trains.isi_report(keyed, fs, 1, max(2, round(settings.refractory * fs)), "key")
    t = templates.select("seg", "channel", "unit", F.get("snr", F.col("channel")).alias("snr"))
    out = report.select("key.seg", "key.channel", "key.unit", "n", "firing_rate", "violation_rate", F.col("fraction_mua").alias("mua"))
    return out.join(t, ["seg", "channel", "unit"]).where(F.col("firing_rate") >= settings.min_firing_rate)


def stitch(result: Sorted, least: float = 0.5, limit: float = 5.0, least_segments: int = 1) -> tuple[DataFrame, DataFrame]:
    """(neurons, events (id, seg, channel, idx, ..)) over all segments: units too poor are deleted, units of neighboring
    segments linked by the cut test on their clips, redundant units of a segment dropped, the others linked by coincident
    events, chains followed and repeated events dropped."""
    s, half = result.settings, result.width // 2
    quality = staged(result.units, "units")
    events, _ = postprocess.delete_bad_units(result.events, quality, s.max_mua, s.min_snr)
    events = staged(events, "events")
    links = staged(postprocess.segment_links(events, result.segments, result.channels, half, s.p_cut, components=s.max_components, seed=s.seed), "links")
    events = events.join(quality.select("seg", "channel", "unit", "snr"), ["seg", "channel", "unit"]).drop("clip")
    near = events.sparkSession.createDataFrame([(c, n) for c, ns in result.neighbors.items() for n in ns], "channel int, neighbor int")
    kept = quality.join(events.select("seg", "channel", "unit").distinct(), ["seg", "channel", "unit"], "left_semi")
    return postprocess.across_channels(events, kept, links, result.segments, result.fs, half, max(2, round(s.refractory * result.fs)), near, limit, least_segments, least)
