"""Template matching on the residual of one block of voltage. NumPy; blocks are bounded by their caller."""

from __future__ import annotations

import numpy as np


def likelihoods(v: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """L[u, t] = -|T_u|^2 / 2 + <T_u, V[:, t : t + W]>, for v (channels, samples) and templates (units, channels, W)."""
    units, channels, width = templates.shape
    n = v.shape[1]
    out = np.zeros((units, n))
    if n <= width:
        return out
    size = 1 << int(np.ceil(np.log2(n + width)))
    spectrum = np.fft.rfft(v, size, axis=1)
    for u in range(units):
        kernel = np.conj(np.fft.rfft(templates[u], size, axis=1))
        out[u, : n - width] = np.fft.irfft((spectrum * kernel).sum(axis=0), size)[: n - width] - 0.5 * (templates[u] ** 2).sum()
    return out


def _best_pair(v: np.ndarray, templates: np.ndarray, unit: int, at: int, reach: int) -> tuple[float, tuple[int, int], tuple[int, int]]:
    """The best sum of two templates around a candidate: (gain, (unit, start), (unit, start))."""
    units, channels, width = templates.shape
    n = v.shape[1]
    shifts = [s for s in range(-reach, reach + 1) if 0 <= at + s and at + s + width <= n]
    best = (-np.inf, (unit, at), (unit, at))
    first = np.stack([np.einsum("cj,cj->", templates[unit], v[:, at + s : at + s + width]) for s in shifts])
    own = (templates[unit] ** 2).sum()
    for other in range(units):
        second = np.stack([np.einsum("cj,cj->", templates[other], v[:, at + s : at + s + width]) for s in shifts])
        energy = (templates[other] ** 2).sum()
        cross = np.zeros((len(shifts), len(shifts)))
        for lag in range(-2 * reach, 2 * reach + 1):
            a, b = templates[unit][:, max(0, lag) :], templates[other][:, max(0, -lag) :]
            k = min(a.shape[1], b.shape[1])
            value = float((a[:, :k] * b[:, :k]).sum()) if k > 0 else 0.0
            i = np.arange(len(shifts))
            j = i + lag
            ok = (j >= 0) & (j < len(shifts))
            cross[i[ok], j[ok]] = value
        gain = first[:, None] + second[None, :] - 0.5 * (own + energy) - cross
        single = np.maximum((first - 0.5 * own)[:, None], (second - 0.5 * energy)[None, :])
        gain = np.where((first - 0.5 * own > 0)[:, None] & (second - 0.5 * energy > 0)[None, :] & (gain > single), gain, -np.inf)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] > best[0]:
            best = (float(gain[i, j]), (unit, at + shifts[i]), (other, at + shifts[j]))
    return best


def cross_products(templates: np.ndarray) -> np.ndarray:
    """X[u, w, d + W - 1] = <T_w, T_u moved by -d>: what subtracting u at t takes from the inner product of w at t + d."""
    units, channels, width = templates.shape
    size = 1 << int(np.ceil(np.log2(2 * width)))
    spectrum = np.fft.rfft(templates, size, axis=2)
    out = np.empty((units, units, 2 * width - 1))
    for u in range(units):
        full = np.fft.irfft((spectrum[u][None] * np.conj(spectrum)).sum(axis=1), size, axis=1)
        out[u] = np.concatenate([full[:, -(width - 1) :], full[:, :width]], axis=1) if width > 1 else full[:, :1]
    return out


def yields(start: int, window: int, width: int, rechecked: set[int]) -> bool:
    """Whether a window gives up its event for this pass: it moved to the left of the window, and the window two to the
    left was rechecked too, so that both might move into the one between."""
    return start < window * width and window > 1 and window - 2 in rechecked


def pursue(v: np.ndarray, templates: np.ndarray, thresholds: np.ndarray, overlap_reach: int = 0, most_passes: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, starts, residual): events added window by window until none passes its threshold.

    A pass looks at windows as long as a template; the best event of a window is added if it starts inside it and beats
    those of the windows beside it that reach into it, and its template is subtracted. With ``overlap_reach`` the best
    event is first weighed against sums of two templates, of which the likelier one is added; of two that might move into
    the same window the left one goes first. Subtracting changes the
    likelihoods nearby by known inner products of templates, and only windows nearby are looked at again.
    """
    units, _, width = templates.shape
    residual = v.astype(np.float64).copy()
    n = residual.shape[1]
    found_units: list[int] = []
    found_starts: list[int] = []
    if n <= width or not units:
        return np.empty(0, np.int64), np.empty(0, np.int64), residual
    last = n - width
    windows = -(-last // width)
    value = np.zeros((units, windows * width))
    value[:, :last] = likelihoods(residual, templates)[:, :last]
    by_window = value.reshape(units, windows, width)
    bar = np.maximum(0, thresholds)[:, None, None]
    cross = cross_products(templates)
    top, place, best_unit = np.zeros(windows), np.zeros(windows, dtype=np.int64), np.zeros(windows, dtype=np.int64)
    active = np.arange(windows)
    for _ in range(most_passes):
        part = by_window[:, active, :]
        part = np.where(part > bar, part, 0.0)
        over = part.max(axis=0)
        place[active] = over.argmax(axis=1)
        top[active] = over.max(axis=1)
        best_unit[active] = part[:, np.arange(len(active)), place[active]].argmax(axis=0)
        beside = np.maximum(np.concatenate([[0], top[:-1]]), np.concatenate([top[1:], [0]]))
        chosen = active[(top[active] > 0) & (top[active] >= beside[active])]
        if len(chosen):
            chosen = chosen[np.concatenate([[True], np.diff(chosen) > 1])]
        if not len(chosen):
            break
        rechecked = set(chosen.tolist()) if overlap_reach else set()
        for w in chosen.tolist():
            start, unit = w * width + int(place[w]), int(best_unit[w])
            if overlap_reach:
                gain, one, two = _best_pair(residual, templates, unit, start, overlap_reach)
                if gain > value[unit, start]:
                    other, at = max((one, two), key=lambda x: value[x[0], x[1]] if x[1] < last else -np.inf)
                    if value[other, at] > thresholds[other]:
                        unit, start = other, int(at)
                if yields(start, w, width, rechecked):
                    continue  # it is looked at again in the next pass, with what is beside it
            residual[:, start : start + width] -= templates[unit]
            found_units.append(unit)
            found_starts.append(start)
            lo, hi = max(0, start - width + 1), min(last, start + width)
            value[:, lo:hi] -= cross[unit][:, lo - start + width - 1 : hi - start + width - 1]
        near = np.unique(chosen[:, None] + np.arange(-2, 3)[None, :])
        active = near[(near >= 0) & (near < windows)]
    order = np.lexsort((found_units, found_starts))
    return np.array(found_units, dtype=np.int64)[order], np.array(found_starts, dtype=np.int64)[order], residual
