"""Event alignment: to a unit's template, to the template's own peak, and by wavelets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxweave.functions import nummath
from fluxweave.operators.vectors import dot, first_argmax


def template_shift(wide: Column, template: Column) -> Column:
    """Place (from 0) in a wider clip at which the template correlates best; ties go to the first place."""
    width = F.size(template)
    scores = F.transform(F.sequence(F.lit(0), F.size(wide) - width), lambda s: F.struct(dot(F.slice(wide, s + 1, width), template).alias("score"), (-s).alias("order")))
    return (-F.array_max(scores)["order"]).cast("int")


def align_to_template(clips: DataFrame, templates: DataFrame, unit: str = "unit", wide: str = "wide", at: str = "sample") -> DataFrame:
    """``clips`` (unit, sample, wide) with the sample moved to where the unit's template (unit, template) fits best.

    ``wide`` has the same margin on both sides of the template's window."""
    rows = clips.join(F.broadcast(templates.select(unit, "template")), unit)
    margin = F.floor((F.size(wide) - F.size("template")) / 2)
    return rows.withColumn(at, F.col(at) + template_shift(F.col(wide), F.col("template")) - margin).drop("template")


def centre_templates(templates: DataFrame, before: int, unit: str = "unit", template: str = "template") -> DataFrame:
    """(unit, shift): what to add to a unit's samples so that its largest |value| lies ``before`` samples into the clip."""
    peak = first_argmax(F.transform(F.col(template), lambda x: F.abs(x)))
    return templates.select(unit, (peak - before).alias("shift"))


def apply_shifts(events: DataFrame, shifts: DataFrame, unit: str = "unit", at: str = "sample") -> DataFrame:
    return events.join(F.broadcast(shifts), unit, "left").withColumn(at, F.col(at) + F.coalesce("shift", F.lit(0))).drop("shift")


def wavelet_scales(fs: float, band: tuple[float, float], before: int, after: int) -> list[float]:
    """Scales an octave apart, from the band's upper end down to its lower one or to one cycle a window."""
    centre = max(before, after)
    spectrum = np.abs(np.fft.fft(nummath.ricker(2 * centre + 1, 1.0))[1:])
    peak = int(spectrum.argmax()) + 1  # cycles in the window at scale one
    cycles = min(peak, 2 * centre + 1 - peak) / (2 * centre + 1)
    low, scale, found = max(band[0], fs / (before + after)), cycles * fs / band[1], []
    while cycles * fs / scale >= low:
        found.append(scale)
        scale *= 2
    return found or [cycles * fs / band[1]]


def _slide(y: np.ndarray, at: int, step: int, sign: int) -> int:
    """The place where going on from ``at`` no longer strictly rises (sign 1) or falls (-1)."""
    while 0 <= at + step < len(y) and sign * (y[at + step] - y[at]) > 0:
        at += step
    return at


def wavelet_centre(clip: np.ndarray, scales: list[float], before: int, after: int) -> int | None:
    """Shift of an event to the mean place of the response of the scale that answers most, weighted by its size, from one
    cycle before its extremum to one after; None if that leads out of the window."""
    centre, top, best = max(before, after), -np.inf, None
    for scale in scales:
        response = np.convolve(clip, nummath.ricker(2 * centre + 1, scale), mode="full")
        peak = response.max() if response.max() > top else -response.min()
        if peak > top:
            top, best = peak, response
    if -best.min() > best.max():
        best = -best
    at = int(best.argmax())
    lo, hi = (_slide(best, _slide(best, at, step, -1), step, 1) for step in (-1, 1))
    size = np.abs(best[lo : hi + 1])
    shift = int(np.around(np.average(np.arange(lo, hi + 1), weights=size) if size.any() else at)) - centre - before
    return shift if -before < shift < after else None


def wavelet_align(clips: DataFrame, fs: float, band: tuple[float, float], before: int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, event, sample): events (clip: ``before`` samples and the rest after) moved to their wavelet centres; those
    that would leave their window are dropped."""

    def run(batches):
        scales: dict[int, list[float]] = {}
        for pdf in batches:
            shift = []
            for c in pdf["clip"]:
                after = len(c) - before
                if after not in scales:
                    scales[after] = wavelet_scales(fs, band, before, after)
                shift.append(wavelet_centre(np.asarray(c, dtype=np.float64), scales[after], before, after))
            out = pdf[[*keys, "event"]].assign(sample=[e if s is None else e + s for e, s in zip(pdf["event"], shift, strict=True)])
            yield out[[s is not None for s in shift]]

    schema = ", ".join([*(f"{k} {clips.schema[k].dataType.simpleString()}" for k in keys), "event long", "sample long"])
    return clips.select(*keys, "event", "clip").mapInPandas(run, schema)


def pursuit_clip_width(clips: DataFrame, noise: float, before: int, after: int, most: float = 2.0, share: float = 0.05) -> tuple[int, int]:
    """Window (before, after) for matching: widened until the mean clip's edges sink under ``share`` of the noise.

    ``clips`` (clip) have ``most`` times the window on each side; one mean clip goes to the driver."""
    rows = clips.select(F.posexplode("clip").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v")).collect()
    mean = np.abs(np.array([r.v for r in sorted(rows, key=lambda r: r.pos)]))
    centre = int(before * most)
    for factor in np.arange(1.0, most + 1e-9, 0.1):
        b, a = int(before * factor), int(after * factor)
        lo, hi = max(0, centre - b), min(len(mean) - 1, centre + a - 1)
        if max(mean[lo], mean[hi]) < share * noise:
            return b, a
    return int(before * most), int(after * most)
