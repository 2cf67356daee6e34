"""Minimum covariance determinant of one group of rows."""

from __future__ import annotations

import numpy as np

from fluxweave.functions.nummath import chi2_isf, chi2_sf


def empirical(x: np.ndarray, centred: bool = False) -> np.ndarray:
    x = x if centred else x - x.mean(axis=0)
    return x.T @ x / len(x)


def log_det(a: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(a)
    return float(value) if sign > 0 else -np.inf


def distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov, hermitian=True), d)


def concentrate(x: np.ndarray, rows: np.ndarray, keep: int, centred: bool, steps: int = 30):
    """Refit on the ``keep`` nearest rows until the determinant stops falling."""
    best = np.inf
    for _ in range(steps):
        centre = np.zeros(x.shape[1]) if centred else x[rows].mean(axis=0)
        cov = empirical(x[rows] - centre, True)
        det = log_det(cov)
        if det >= best - 1e-12 or det == -np.inf:
            break
        best = det
        rows = np.argsort(distances(x, centre, cov), kind="stable")[:keep]
    centre = np.zeros(x.shape[1]) if centred else x[rows].mean(axis=0)
    return centre, empirical(x[rows] - centre, True), rows


def min_cov_det(x: np.ndarray, support: float | None = None, centred: bool = False, starts: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, covariance, support mask): robust estimate, made consistent for normal data and re-weighted once."""
    n, p = x.shape
    keep = min(n, int(np.ceil(0.5 * (n + p + 1))) if support is None else max(1, int(support * n)))
    if keep >= n:
        centre = np.zeros(p) if centred else x.mean(axis=0)
        cov = empirical(x - centre, True)
    else:
        rng, found = np.random.default_rng(seed), []
        for _ in range(starts):
            rows = rng.choice(n, min(n, p + 1), replace=False)
            centre, cov, rows = concentrate(x, rows, keep, centred, 2)
            found.append((log_det(empirical(x[rows] - centre, True)), rows))
        found.sort(key=lambda f: f[0])
        centre, cov, _ = min((concentrate(x, rows, keep, centred) for _, rows in found[:10]), key=lambda f: log_det(f[1]))
    d = distances(x, centre, cov)
    cov = cov * np.median(d) / chi2_isf(0.5, p) if np.median(d) > 0 else cov
    inside = distances(x, centre, cov) < chi2_isf(0.025, p)
    if inside.sum() > p:
        centre = np.zeros(p) if centred else x[inside].mean(axis=0)
        share = 1 - 0.025
        cov = empirical(x[inside] - centre, True) * share / (1 - chi2_sf(chi2_isf(0.025, p), p + 2))
    return centre, cov, inside
