"""Numerics in NumPy alone: normal and chi-square distributions, DCT, band-pass filter, Ricker wavelet."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
lgamma = np.frompyfunc(math.lgamma, 1, 1)


def norm_sf(x) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(np.asarray(x, dtype=np.float64) / math.sqrt(2)), dtype=np.float64)


def norm_cdf(x) -> np.ndarray:
    return norm_sf(-np.asarray(x, dtype=np.float64))


def norm_pdf(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function, by series or fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_isf(q: float, k: float) -> float:
    """The value whose upper tail is q, by bisection."""
    lo, hi = 0.0, k + 10.0
    while chi2_sf(hi, k) > q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, k) > q else (lo, mid)
    return (lo + hi) / 2


def dct2(x: np.ndarray) -> np.ndarray:
    """Unnormalised type-II cosine transform, by one FFT of the even extension."""
    n = len(x)
    spectrum = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
    return (spectrum * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real


def idct2(a: np.ndarray) -> np.ndarray:
    """Inverse of ``dct2``."""
    n = len(a)
    half = a * np.exp(1j * np.pi * np.arange(n) / (2 * n))
    full = np.concatenate([half, [0], np.conj(half[1:][::-1])])
    return np.fft.ifft(full).real[:n]


def bandpass_coefficients(low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """First-order Butterworth band-pass (b, a), by the bilinear transform of s B / (s^2 + s B + w0^2)."""
    w1, w2 = 2 * fs * math.tan(math.pi * low / fs), 2 * fs * math.tan(math.pi * high / fs)
    band, centre, k = w2 - w1, w1 * w2, 2 * fs
    a0 = k * k + band * k + centre
    b = np.array([band * k, 0.0, -band * k]) / a0
    a = np.array([1.0, (2 * centre - 2 * k * k) / a0, (k * k - band * k + centre) / a0])
    return b, a


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    z0, z1 = state
    b0, b1, b2 = b.tolist()
    _, a1, a2 = a.tolist()
    for i, v in enumerate(x.tolist()):
        y = b0 * v + z0
        z0 = b1 * v - a1 * y + z1
        z1 = b2 * v - a2 * y
        out[i] = y
    return out


def impulse_response(b: np.ndarray, a: np.ndarray, least: float = 1e-18) -> np.ndarray:
    """The filter's response to one impulse, until it has faded below ``least``."""
    radius = float(np.abs(np.roots(a)).max())
    n = int(np.ceil(np.log(least) / np.log(radius))) + len(b)
    return _section(b, a, np.concatenate([[1.0], np.zeros(n)]), np.zeros(2))


def _filtered(x: np.ndarray, response: np.ndarray, start: float) -> np.ndarray:
    """x filtered as if it had always been ``start`` before, by overlapping FFT blocks."""
    m = len(response)
    wide = np.concatenate([np.full(m - 1, start), x])
    size = 1 << int(np.ceil(np.log2(max(2, min(len(wide) + m, 8 * m)))))
    step, spectrum = size - m + 1, np.fft.rfft(response, size)
    out = np.empty(len(x))
    for at in range(0, len(x), step):
        part = np.fft.irfft(np.fft.rfft(wide[at : at + size], size) * spectrum, size)[m - 1 :]
        out[at : at + step] = part[: len(out) - at]
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray, response: np.ndarray | None = None) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends and steady starting states. With the filter's
    impulse response it is done by FFT, else step by step."""
    x = np.asarray(x, dtype=np.float64)
    pad = min(3 * len(a), len(x) - 1)
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    if response is not None:
        forward = _filtered(wide, response, wide[0])
        back = _filtered(forward[::-1], response, forward[-1])[::-1]
        return back[pad : len(back) - pad]
    # Steady state for a unit step in the transposed direct form.
    gain = b.sum() / a.sum()
    steady = np.array([gain - b[0], b[2] - a[2] * gain])
    forward = _section(b, a, wide, steady * wide[0])
    back = _section(b, a, forward[::-1], steady * forward[-1])[::-1]
    return back[pad : len(back) - pad]


def ricker(points: int, width: float) -> np.ndarray:
    """Mexican-hat wavelet of unit energy."""
    t = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)
