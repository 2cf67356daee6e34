"""Filters on voltage: a band-pass over blocks of a channel with a halo, Wiener filters over segments, whitening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.functions import nummath
from fluxweave.operators.signal import SCAN, halo


def bandpass(rows: DataFrame, low: float, high: float, fs: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, sample, v) filtered forward and backward, channel by channel.

    A block comes with a halo in which the filter's memory fades below rounding, so blocks give what the whole channel
    would; a channel's true ends are extended as filters do."""
    b, a = nummath.bandpass_coefficients(low, high, fs)
    response = nummath.impulse_response(b, a)
    warm = 2 * len(response)
    size = max(SCAN, 4 * warm)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        filtered = nummath.filtfilt(b, a, pdf["v"].to_numpy(dtype=np.float64), response)
        return pdf.assign(v=filtered)[pdf["own"]][[*keys, "sample", "v"]]

    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "sample long", "v double"])
    return halo(rows.select(*keys, "sample", F.col("v").cast("double").alias("v")), warm, warm, size).groupBy(*keys, "block").applyInPandas(run, schema)


def wiener_gain(signal: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Weight of each frequency from the powers of signal and noise."""
    return signal / (signal + noise + 1e-9)


def running_power(power: np.ndarray, points: int) -> np.ndarray:
    """Mean over a running window of about ``points`` frequencies: those from half a window before (exclusive) to half
    after (inclusive), as far as there are; the first frequency never leaves the window."""
    n, half = len(power), int(points) // 2
    if int(points) <= 1:
        return power
    at = np.arange(n)
    sums = np.concatenate([[0.0], np.cumsum(power)])
    lo, hi = np.maximum(1, at - half + 1), np.maximum(np.minimum(n, at + half + 1), min(half, n))
    return (power[0] + sums[hi] - sums[lo]) / (1 + hi - lo)


def wiener_array(v: np.ndarray, signal: np.ndarray, noise: np.ndarray, points: float = 1) -> np.ndarray:
    """Rows (channels) of v with each frequency weighted by signal power over signal and noise power."""
    rows = [np.atleast_2d(x) for x in (v, signal, noise)]
    out = []
    for x, s, n in zip(*rows, strict=True):
        power = [running_power(np.abs(np.fft.rfft(y)) ** 2, points) for y in (s, n)]
        out.append(np.fft.irfft(np.fft.rfft(x) * wiener_gain(*power), len(x)))
    return np.stack(out).reshape(np.shape(v))


def wiener_all(v: np.ndarray, signal: np.ndarray, noise: np.ndarray, points: float = 1) -> np.ndarray:
    """All channels, one after the other, filtered as one row, so that a channel without events is not filtered by its
    own noise alone."""
    return wiener_array(v.ravel(), signal.ravel(), noise.ravel(), points).reshape(v.shape)


def wiener_segment(v: np.ndarray, signal: np.ndarray, smoothing: float | None, fs: float, same: bool = False) -> np.ndarray:
    """One segment (channels x samples) filtered by what templates explain of it (``signal``; noise is the rest), its
    channels scaled back to their deviations. ``smoothing`` is in Hz; ``same`` takes one filter for all channels."""
    hz = 0 if smoothing is None or smoothing < 1 else smoothing
    points = hz * (v.size if same else v.shape[1]) / (fs // 2)
    out = (wiener_all if same else wiener_array)(v, signal, v - signal, points)
    spread = out.std(axis=1, keepdims=True)
    return np.where(spread > 0, out * v.std(axis=1, keepdims=True) / np.where(spread > 0, spread, 1), out)


def wiener_segments(rows: DataFrame, smoothing: float | None, fs: float, same: bool = False) -> DataFrame:
    """(seg, channel, sample, v) from rows with v and ``signal``. A group is a channel of a segment, or with ``same`` a
    whole segment: the segment's duration bounds it."""
    keys = ["seg"] if same else ["seg", "channel"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["channel", "sample"]).reset_index(drop=True)
        channels = pdf["channel"].nunique()
        v, s = (pdf[c].to_numpy(dtype=np.float64).reshape(channels, -1) for c in ("v", "signal"))
        return pdf[["seg", "channel", "sample"]].assign(v=wiener_segment(v, s, smoothing, fs, same).ravel())

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("seg", "channel", "sample"))
    return rows.select("seg", "channel", "sample", F.col("v").cast("double").alias("v"), F.col("signal").cast("double").alias("signal")).groupBy(*keys).applyInPandas(run, f"{kinds}, v double")


def wiener(rows: DataFrame, points: float = 1, keys: tuple[str, ...] = ("seg", "channel")) -> DataFrame:
    """(keys, sample, v) from rows with v and ``signal``, what templates explain of v; noise is the rest. The spectra are
    smoothed over ``points`` frequencies, nothing is scaled back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        v, s = pdf["v"].to_numpy(dtype=np.float64), pdf["signal"].to_numpy(dtype=np.float64)
        return pdf.drop(columns="signal").assign(v=wiener_array(v, s, v - s, points))

    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "sample long", "v double"])
    return rows.select(*keys, "sample", F.col("v").cast("double").alias("v"), F.col("signal").cast("double").alias("signal")).groupBy(*keys).applyInPandas(run, schema)


def zca_matrix(cov: np.ndarray, epsilon: float = 1e-9) -> np.ndarray:
    """Symmetric whitening with rows scaled so that the diagonal is one."""
    u, s, _ = np.linalg.svd(cov)
    z = u @ np.diag(1 / np.sqrt(s + epsilon)) @ u.T
    return z / np.diag(z)[:, None]


def zca_weights(products: DataFrame) -> DataFrame:
    """(channel, source, w) from ``signal.noise_products``: one small matrix, made on the driver from C * (C + 1) / 2 rows."""
    rows = products.select("c1", "c2", "value").collect()
    names = sorted({r.c1 for r in rows} | {r.c2 for r in rows})
    place = {c: i for i, c in enumerate(names)}
    cov = np.eye(len(names))
    for r in rows:
        cov[place[r.c1], place[r.c2]] = cov[place[r.c2], place[r.c1]] = r.value if r.value is not None else float(r.c1 == r.c2)
    z = zca_matrix(cov)
    spark = products.sparkSession
    kind = products.schema["c1"].dataType.simpleString()
    return spark.createDataFrame([(a, b, float(z[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], f"channel {kind}, source {kind}, w double")
