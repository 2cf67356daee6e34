"""Clustering of one group's scores: farthest seeding, cut-test merging, PCA features. NumPy on bounded groups."""

from __future__ import annotations

import math

import numpy as np

from fluxweave.functions.density import iso_cut


def dense(labels: np.ndarray) -> np.ndarray:
    """Labels 0..n-1 in the order of the old ones."""
    return np.unique(labels, return_inverse=True)[1].astype(np.int64)


def seed_farthest(x: np.ndarray, target: int, percentile: float = 0.95, n_random: int = 0, seed: int = 0) -> np.ndarray:
    """Labels of clusters grown from spread-out centres until the median cluster holds at most ``target`` points."""
    n = len(x)
    if n == 0 or x.ndim == 1 or n <= target:
        return np.zeros(n, dtype=np.int64)
    if target <= 2 or n_random >= n:
        return np.arange(n, dtype=np.int64)
    rng = np.random.default_rng(seed)
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    labels = np.zeros(n, dtype=np.int64)
    if not far.any():
        return labels
    centres = 1
    for _ in range(n_random):
        if not far.any():
            break
        pick = rng.choice(n, p=far / far.sum())
        d = ((x - x[pick]) ** 2).sum(axis=1)
        closer = d < far
        labels[closer], far = centres, np.minimum(far, d)
        centres += 1
    at = math.ceil((n - 1) * (1 - percentile))
    while np.median(np.unique(labels, return_counts=True)[1]) > target and centres < n:
        pick = np.argsort(-far, kind="stable")[at]
        d = ((x - x[pick]) ** 2).sum(axis=1)
        closer = d < far
        if not closer.any():
            break
        labels[closer], far = centres, np.minimum(far, d)
        centres += 1
    return dense(labels)


def mutual_pairs(x: np.ndarray, labels: np.ndarray, done: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of clusters whose centroids are nearest to each other, without pairs compared before."""
    names = np.unique(labels)
    centres = np.stack([x[labels == c].mean(axis=0) for c in names])
    d = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    place = {int(c): i for i, c in enumerate(names)}
    for a, b in done:
        if a in place and b in place:
            d[place[a], place[b]] = d[place[b], place[a]] = np.inf
    near = d.argmin(axis=1)
    return [(int(names[i]), int(names[j])) for i, j in enumerate(near) if i < j and near[j] == i and np.isfinite(d[i, j])]


def separating_axis(a: np.ndarray, b: np.ndarray, whiten: bool) -> np.ndarray:
    axis = a.mean(axis=0) - b.mean(axis=0)
    if whiten and len(a) + len(b) > 2:
        pooled = ((len(a) - 1) * np.cov(a.T, ddof=1) if len(a) > 1 else 0) + ((len(b) - 1) * np.cov(b.T, ddof=1) if len(b) > 1 else 0)
        pooled = np.atleast_2d(pooled) / (len(a) + len(b) - 2)
        if abs(np.linalg.det(pooled)) > 1e-6:
            axis = np.linalg.solve(pooled, axis)
    return axis


def merge_clusters(x: np.ndarray, labels: np.ndarray, p_cut: float = 0.01, whiten: bool = True, merge_only: bool = False, split_only: bool = False, match_size: bool = False, check_splits: bool = False, max_rounds: int = 20_000, seed: int = 0) -> np.ndarray:
    """Compare mutually nearest clusters along their separating axis; merge them unless the cut test parts them, in
    which case points are dealt anew at the cut. Pairs are not compared again until one of them merges."""
    labels = labels.astype(np.int64).copy()
    if len(labels) == 0 or x.ndim == 1 or len(np.unique(labels)) < 2:
        return labels
    done: set[tuple[int, int]] = set()
    for _ in range(max_rounds):
        pairs = mutual_pairs(x, labels, done) if len(np.unique(labels)) > 1 else []
        if not pairs:
            break
        for a, b in pairs:
            in_a, in_b = np.flatnonzero(labels == a), np.flatnonzero(labels == b)
            if len(in_a) == 0 or len(in_b) == 0:
                continue
            both = np.concatenate([in_a, in_b])
            merge, proj, cut = len(in_a) == len(in_b) == 1, None, None
            if not merge:
                left, right = in_a, in_b
                if match_size:  # the larger cluster's points nearest to the smaller one
                    small, large = (left, right) if len(left) <= len(right) else (right, left)
                    near = ((x[large] - x[small].mean(axis=0)) ** 2).sum(axis=1)
                    large = large[np.argsort(near, kind="stable")[: max(2, len(small))]]
                    left, right = (small, large) if len(in_a) <= len(in_b) else (large, small)
                axis = separating_axis(x[left], x[right], whiten) if x.shape[1] > 1 else np.ones(1)
                if not np.any(axis):
                    merge = True
                else:
                    proj = x[both] @ axis
                    tested = x[np.concatenate([left, right])] @ axis
                    p, cut = iso_cut(tested, p_cut, seed)
                    merge = p >= p_cut or cut is None
            if merge:
                if not split_only:
                    keep, gone = (a, b) if len(in_a) >= len(in_b) else (b, a)
                    labels[labels == gone] = keep
                    done = {q for q in done if a not in q and b not in q}
                    continue
            elif not merge_only:
                above = proj > cut + 1e-6
                if not above.any() or above.all():
                    keep = a if len(in_a) >= len(in_b) else b
                    labels[both] = keep
                    done = {q for q in done if a not in q and b not in q}
                    continue
                high, low = (a, b) if proj[: len(in_a)].mean() >= proj[len(in_a) :].mean() else (b, a)
                trial = labels.copy()
                trial[both] = np.where(above, high, low)
                apart = lambda ls: ((x[ls == a].mean(axis=0) - x[ls == b].mean(axis=0)) ** 2).sum()
                if not check_splits or apart(trial) >= apart(labels):
                    labels = trial
            done.add((a, b))
    return labels


def pca_axes(x: np.ndarray) -> np.ndarray | None:
    """Principal axes of the standardised columns, by falling variance; None if a column does not vary."""
    if len(x) < 2:
        return None
    sd = x.std(axis=0)
    if (sd == 0).any():
        return None
    values, axes = np.linalg.eigh(np.atleast_2d(np.cov(((x - x.mean(axis=0)) / sd).T, ddof=1)))
    return axes[:, np.argsort(-values, kind="stable")]


def reconstruction_order(x: np.ndarray, axes: np.ndarray, check: int | None, most: int | None) -> tuple[np.ndarray, bool]:
    """Axes by how well each alone rebuilds the raw rows, up to the first that adds nothing; and whether even the mean
    does better than the best of them."""
    axes = axes[:, : check or axes.shape[1]]
    proj = x @ axes
    total = float((x * x).sum())
    single = np.array([((x - np.outer(proj[:, i], axes[:, i])) ** 2).sum() for i in range(axes.shape[1])])
    order = np.argsort(single, kind="stable")
    best, kept = -np.inf, 0
    for k in range(1, len(order) + 1):
        use = order[:k]
        vaf = 1 - ((x - proj[:, use] @ axes[:, use].T) ** 2).sum() / total if total else 0.0
        if vaf < best:
            break
        best, kept = vaf, k
    mean_error = float(((x - x.mean(axis=0)) ** 2).sum())
    return order[: min(kept, most or kept)], bool(single[order[0]] > mean_error)


def pca_features(clips: np.ndarray, check: int | None = 100, most: int | None = 5, sample: int = 100_000, peak_valley: bool = False, seed: int = 0) -> np.ndarray:
    """Raw clips on the chosen axes; axes are fitted on at most ``sample`` clips."""
    clips = np.asarray(clips, dtype=np.float64)
    fit = clips if len(clips) <= sample else clips[np.random.default_rng(seed).choice(len(clips), sample)]
    axes = pca_axes(fit)
    if axes is None:
        return np.zeros((len(clips), 1))
    order, _ = reconstruction_order(fit, axes, check, most)
    scores = clips @ axes[:, order]
    if peak_valley:
        pv = clips.max(axis=1) - clips.min(axis=1)
        span = np.ptp(pv)
        scores = np.column_stack([scores, pv / span * np.ptp(scores) if span else pv * 0])
    return scores


def pca_by_channel(clips: np.ndarray, main: int, channels: int, check: int | None = 100, most: int | None = 5, seed: int = 0) -> np.ndarray:
    """Each channel's own features, the main channel first, without channels that their mean describes better; the
    features of highest variance stay."""
    width = clips.shape[1] // channels
    found = []
    for c in [main, *(k for k in range(channels) if k != main)]:
        part = np.asarray(clips[:, c * width : (c + 1) * width], dtype=np.float64)
        axes = pca_axes(part)
        if axes is None:
            continue
        order, worse = reconstruction_order(part, axes, check, most)
        if c == main or not worse:
            found.append(part @ axes[:, order])
    if not found:
        return np.zeros((len(clips), 1))
    scores = np.concatenate(found, axis=1)
    return scores[:, np.sort(np.argsort(-scores.var(axis=0), kind="stable")[: most or scores.shape[1]])]


def template_features(clips: np.ndarray, labels: np.ndarray, most: int | None = 5, weighted: bool = True) -> np.ndarray | None:
    """Clips on the principal axes of their clusters' means; None with one cluster."""
    names, counts = np.unique(labels, return_counts=True)
    if len(names) < 2:
        return None
    means = np.stack([clips[labels == c].mean(axis=0) for c in names])
    if weighted:
        means = means * np.sqrt(counts / counts.sum())[:, None]
    _, _, axes = np.linalg.svd(means - means.mean(axis=0), full_matrices=False)
    return clips @ axes[: min(most or len(names), len(names) - 1)].T


def template_features_by_channel(clips: np.ndarray, labels: np.ndarray, main: int, channels: int, check: int | None = 100, most: int | None = 5, weighted: bool = True) -> np.ndarray | None:
    """Each channel of the clips on the chosen axes of its clusters' median templates, the main channel first, without
    channels that their mean describes better; None with one cluster."""
    names, counts = np.unique(labels, return_counts=True)
    if len(names) < 2:
        return None
    clips = np.asarray(clips, dtype=np.float64)
    templates = np.stack([np.median(clips[labels == c], axis=0) for c in names])
    if weighted:
        templates = templates * np.sqrt(counts / counts.sum())[:, None]
    width, found = clips.shape[1] // channels, []
    for c in [main, *(k for k in range(channels) if k != main)]:
        part = slice(c * width, (c + 1) * width)
        axes = pca_axes(templates[:, part])
        if axes is None:
            if c == main:
                return np.zeros((len(clips), 1))
            continue
        order, worse = reconstruction_order(templates[:, part], axes, check, most)
        if c == main or not worse:
            found.append(clips[:, part] @ axes[:, order])
    return np.concatenate(found, axis=1)


def template_order(templates: np.ndarray, most: int, first: int = 0) -> list[int]:
    """Templates picked one by one so that each overlaps least with those picked before."""
    norm = templates / np.maximum(1e-300, np.linalg.norm(templates, axis=1, keepdims=True))
    picked = [first]
    while len(picked) < min(most, len(templates)):
        overlap = np.abs(norm @ norm[picked].T).max(axis=1)
        overlap[picked] = np.inf
        picked.append(int(overlap.argmin()))
    return picked


def branch(clips: np.ndarray, labels: np.ndarray, features, p_cut: float = 0.01, seed: int = 0, match_size: bool = False, check_splits: bool = False) -> np.ndarray:
    """Re-cluster every cluster of two events or more on its own features until none splits."""
    labels = dense(labels)
    work = list(np.unique(labels))
    while work:
        c = work.pop()
        rows = np.flatnonzero(labels == c)
        if len(rows) < 2:
            continue
        scores = features(clips[rows])
        n = len(rows)
        sub = merge_clusters(scores, seed_farthest(scores, min(100, round(n / 1000)), n_random=max(100, round(n / 100)), seed=seed), p_cut, match_size=match_size, check_splits=check_splits, seed=seed)
        names = np.unique(sub)
        if len(names) > 1:
            for name in names:
                new = labels.max() + 1
                labels[rows[sub == name]] = new
                work.append(new)
    return dense(labels)
