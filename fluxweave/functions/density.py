"""One-dimensional density, unimodal fit and the cut test."""

from __future__ import annotations

import math

import numpy as np

from fluxweave.functions.nummath import dct2, idct2, lgamma


def _plug_in(t: float, n: int, k2: np.ndarray, a2: np.ndarray, order: int = 7) -> float:
    """Bandwidth by diffusion: t less the bandwidth that the derivatives estimated at t ask for."""
    f = 2 * math.pi ** (2 * order) * float(np.sum(k2**order * a2 * np.exp(-k2 * math.pi**2 * t)))
    for s in range(order - 1, 1, -1):
        if f < 1e-6:
            return -math.inf
        odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
        at = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (n * f)) ** (2 / (3 + 2 * s))
        f = 2 * math.pi ** (2 * s) * float(np.sum(k2**s * a2 * np.exp(-k2 * math.pi**2 * at)))
    return -math.inf if f < 1e-6 else t - (2 * n * math.sqrt(math.pi) * f) ** -0.4


def kde(x: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Diffusion kernel density (density, mesh, bandwidth) on a power of two of mesh points."""
    n = 1 << max(1, math.ceil(math.log2(max(2, points))))
    lo, hi = float(x.min()), float(x.max())
    if lo == hi:
        return np.ones(1), np.array([hi]), 0.0
    span = hi - lo
    mesh = np.linspace(lo, hi, n)
    counts = np.bincount(np.minimum(n - 1, ((x - lo) / (span / (n - 1))).astype(int)), minlength=n).astype(np.float64)
    a = dct2(counts / counts.sum())
    k2, a2 = np.arange(1, n, dtype=np.float64) ** 2, (a[1:] / 2) ** 2
    size = len(np.unique(x))
    tol, t = 1e-12 + 0.01 * (min(max(size, 50), 1050) - 50) / 1000, None
    while tol <= 1 and t is None:
        left, right = _plug_in(0.0, size, k2, a2), _plug_in(tol, size, k2, a2)
        if left < 0 < right:
            b0, b1 = 0.0, tol
            for _ in range(100):
                mid = (b0 + b1) / 2
                b0, b1 = (mid, b1) if _plug_in(mid, size, k2, a2) < 0 else (b0, mid)
            t = (b0 + b1) / 2
        tol *= 2
    if t is None:  # no root: the place where the two sides differ least
        grid = np.geomspace(1e-8, 0.1, 200)
        t = float(min(grid, key=lambda g: abs(_plug_in(g, size, k2, a2))))
    smooth = a * np.exp(-(np.arange(n) ** 2) * math.pi**2 * t / 2)
    return np.maximum(0, idct2(smooth) * (n - 1) / span), mesh, math.sqrt(t) * span


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ascending isotonic fit."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for v, u in zip(y.astype(np.float64).tolist(), w.astype(np.float64).tolist(), strict=True):
        means.append(v)
        weights.append(u)
        sizes.append(1)
        while len(means) > 1 and means[-1] <= means[-2]:
            v2, u2, s2 = means.pop(), weights.pop(), sizes.pop()
            total = weights[-1] + u2
            means[-1] = (means[-1] * weights[-1] + v2 * u2) / total if total else means[-1]
            weights[-1] = total
            sizes[-1] += s2
    return np.repeat(means, sizes)


def prefix_errors(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared error of the ascending fit of each prefix y[:i]; one pass of pooling.

    A pooled block's error is taken as sum((w y)^2) - (sum w y)^2 / sum w, the form that the cut rule is built on."""
    errors = np.zeros(len(y) + 1)
    stack: list[tuple[float, float, float, float]] = []  # mean, weight, sum of (w y)^2, error before this block
    for i, (v, u) in enumerate(zip(y.astype(np.float64).tolist(), w.astype(np.float64).tolist(), strict=True)):
        mean, weight, squares = v, u, (u * v) ** 2
        while stack and mean <= stack[-1][0]:
            m, g, s, _ = stack.pop()
            mean, weight, squares = (m * g + mean * weight) / (g + weight), g + weight, squares + s
        before = stack[-1][3] if stack else 0.0
        total = before + squares - (mean * weight) ** 2 / weight
        stack.append((mean, weight, squares, total))
        errors[i + 1] = total
    return errors


def up_down(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Best fit that rises and then falls: (fit, mode)."""
    n = len(y)
    up, down = prefix_errors(y, w), prefix_errors(y[::-1], w[::-1])
    at = int(np.argmin(up[:n] + down[::-1][:n]))
    fit = np.concatenate([pava(y[:at], w[:at]), pava(y[at:][::-1], w[at:][::-1])[::-1]])
    return fit, max(0, at - 1)


class MultinomialTest:
    """Goodness of fit of counts to proportions, exact or by seeded draws."""

    def __init__(self, observed: np.ndarray, proportions: np.ndarray, seed: int = 0):
        self.observed = np.asarray(observed, dtype=np.int64)
        p = np.asarray(proportions, dtype=np.float64)
        self.p = p / p.sum() if p.sum() > 0 else np.full(len(p), 1 / len(p))
        self.n = int(self.observed.sum())
        self.rng = np.random.default_rng(seed)

    def log_combinations(self) -> float:
        k = len(self.observed)
        return math.lgamma(self.n + k) - math.lgamma(k) - math.lgamma(self.n + 1)

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        counts = np.atleast_2d(counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(counts > 0, counts * np.log(self.p), 0.0)
        return math.lgamma(self.n + 1) - lgamma(counts + 1.0).astype(np.float64).sum(axis=1) + terms.sum(axis=1)

    def cases(self):
        """All ways to spread n over the categories."""

        def spread(left: int, k: int):
            if k == 1:
                yield (left,)
                return
            for x in range(left + 1):
                for rest in spread(left - x, k - 1):
                    yield (x, *rest)

        return spread(self.n, len(self.observed))

    def exact(self) -> float:
        """Chance of outcomes no likelier than the observed one."""
        seen = self.log_probability(self.observed)[0]
        p = self.log_probability(np.array(list(self.cases()), dtype=np.int64))
        return float(min(1.0, np.exp(p[p <= seen + 1e-9]).sum()))

    def drawn(self, draws: int, threshold: float = 1.0) -> float:
        """Share of ``draws`` that are no likelier than the observed outcome, counted no further than the threshold."""
        seen, hits, stop = self.log_probability(self.observed)[0], 0, math.ceil(threshold * draws)
        for done in range(0, draws, 2000):
            outcomes = self.rng.multinomial(self.n, self.p, min(2000, draws - done))
            hits += int((self.log_probability(outcomes) <= seen + 1e-9).sum())
            if hits >= stop:
                return stop / draws
        return hits / draws if draws else 1.0


def max_sse_window(observed: np.ndarray, expected: np.ndarray) -> tuple[float, int, int]:
    """(sum of squares, start, end) of the window [start, end) in which observed and expected differ most; of equal
    windows the last.

    A window opens where the next step of the one is not that of the other (at the first value also where the values
    differ) and closes after the next place whose steps agree and are not flat, or at the end; the search goes on behind
    it. Without any window it is the whole range, with a sum of zero.
    """
    n = len(observed)
    if n < 2:
        return 0.0, 0, n
    step, wanted = np.diff(observed), np.diff(expected)
    opens = step != wanted
    opens[0] |= observed[0] != expected[0]
    openings = np.flatnonzero(opens)
    closings = np.append(np.flatnonzero((step == wanted) & (step != 0)), n - 1)
    best, at = (0.0, 0, n), 0
    while (k := np.searchsorted(openings, at)) < len(openings):
        start = int(openings[k])
        end = int(closings[np.searchsorted(closings, start, side="right")]) + 1
        total = float(((observed[start:end] - expected[start:end]) ** 2).sum())
        if total >= best[0]:
            best = (total, start, end)
        at = end
    return best


def plateau_middle(values: np.ndarray, at: int, x: np.ndarray) -> float:
    """Middle of the run of equal values around a place."""
    lo = hi = at
    while lo > 0 and values[lo - 1] == values[at]:
        lo -= 1
    while hi + 1 < len(values) and values[hi + 1] == values[at]:
        hi += 1
    return float((x[lo] + x[hi]) / 2)


def iso_cut(x: np.ndarray, p_cut: float, seed: int = 0) -> tuple[float, float | None]:
    """(p, cut): chance that the values come from one unimodal density, and where to cut if it is below ``p_cut``.

    The density at mesh points, as counts, is held against its best fit that rises and then falls, on the side and in the
    window where they differ most. The cut lies where the counts fall shortest of the fit, smoothed by such a fit again;
    of equal places the one nearest to the mode. Where the window reaches the end of the mesh, a far second hump may have
    been missed by the fit: then it lies before the first place (from the mode's side) at which the fit has its least
    count and the counts exceed it.
    """
    n = len(x)
    if n <= 2:
        return 1.0, None
    density, mesh, _ = kde(np.asarray(x, dtype=np.float64), max(2, math.ceil(math.sqrt(n))))
    if len(mesh) < 2 or not density.sum() > 0:
        return 1.0, None
    density = np.maximum(0, density / density.sum())
    counts = np.around(density * n).astype(np.int64)
    stay = (counts > 0) | (density > 0)
    density, counts, mesh = density[stay], counts[stay], mesh[stay]
    k = len(counts)
    ramp = np.minimum(np.arange(1, k + 1), np.arange(k, 0, -1)).astype(np.float64)
    fit, mode = up_down(density, ramp)
    fit = fit / fit.sum()
    null = np.around(fit * n).astype(np.int64)
    if np.array_equal(counts, null):
        return 1.0, None
    if k <= 4:
        p = MultinomialTest(counts, np.maximum(fit, 1e-300), seed).exact()
        short = null - counts
        return p, plateau_middle(short, int(short.argmax()), mesh) if p < p_cut else None
    left, left_start, left_end = max_sse_window(counts[: mode + 1], null[: mode + 1])
    right, from_end, to_end = max_sse_window(counts[mode:][::-1], null[mode:][::-1])
    on_left = left > right
    start, end = (left_start, left_end) if on_left else (k - to_end, k - from_end)
    test = MultinomialTest(counts[start:end], np.maximum(fit[start:end], 1e-300), seed)
    draws = math.ceil(1 / p_cut) * 100
    p = test.exact() if test.log_combinations() <= math.log(draws) else test.drawn(draws, p_cut)
    if p >= p_cut:
        return p, None
    dip, _ = up_down((null - counts)[start:end].astype(np.float64), np.ones(end - start))
    at = int(dip.argmax()) if not on_left else len(dip) - 1 - int(dip[::-1].argmax())
    if end == k and 2 * mode != k:
        missed = np.flatnonzero((null[: len(dip)] == null.min()) & (dip < 0))
        if len(missed):
            at = max(0, int(missed[0]) - 1) if 2 * mode < k else min(len(dip) - 1, int(missed[-1]) + 1)
    return p, plateau_middle(dip, at, mesh[start:end])
