"""Units against each other: alignment of templates, confusion, merge tests, consolidation of one segment's units and
stitching of two. NumPy on groups that the number of units and the events of a segment bound."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from fluxweave.functions import clustering
from fluxweave.functions.nummath import norm_cdf

#: Chance of confusion above which two templates are one; share of the smaller template's energy that two
#: templates may differ by; signal to noise below which a unit, and a channel of one, is not looked at.
CONFUSED, NEAR, LEAST_SNR, LEAST_CHANNEL_SNR = 0.1, 0.5, 1.5, 0.5


def correlation_shift(a: np.ndarray, b: np.ndarray, most: int | None = None, absolute: bool = False) -> int:
    """The lag at which a follows b best; ties go to the least lag."""
    score = np.correlate(a, b, mode="full")
    score = np.abs(score) if absolute else score
    centre = len(score) // 2
    most = centre if most is None else most
    lo = max(0, centre - most)
    return int(score[lo : centre + most + 1].argmax()) + lo - centre


def shifted(x: np.ndarray, channels: int, shift: int, first: bool) -> np.ndarray:
    """Rows of clips with every channel cut to what two windows ``shift`` apart share; ``first`` is the one that leads."""
    grid = np.atleast_2d(x).reshape(-1, channels, np.atleast_2d(x).shape[1] // channels)
    width = grid.shape[2]
    lo = max(0, shift) if first else max(0, -shift)
    out = grid[:, :, lo : lo + width - abs(shift)].reshape(len(grid), -1)
    return out if np.ndim(x) == 2 else out[0]


def align(a: np.ndarray, b: np.ndarray, channels: int, most: int | None = None, absolute: bool = False, pad: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(a, b, shift, width): templates at their best shift, cut on each channel to what they share, or with ``pad`` laid
    back into windows of the old width with zeros around."""
    if a.ndim != 1 or a.shape != b.shape or not len(a) or len(a) % channels:
        raise ValueError("templates must be two vectors of one size that the channels divide evenly")
    width, shift = len(a) // channels, correlation_shift(a, b, most, absolute)
    if not shift:
        return a, b, 0, width
    cut = [shifted(a, channels, shift, True), shifted(b, channels, shift, False)]
    if not pad:
        return cut[0], cut[1], shift, width - abs(shift)
    out = []
    for x in cut:
        wide = np.zeros((channels, width))
        wide[:, max(0, shift) : max(0, shift) + width - abs(shift)] = x.reshape(channels, -1)
        out.append(wide.ravel())
    return out[0], out[1], shift, width


def confusion(a: np.ndarray, b: np.ndarray, covariance: list[np.ndarray]) -> float:
    """Chance that noise makes aligned template a look likelier to be b; the same with a and b exchanged."""
    d = (a - b).reshape(len(covariance), -1)
    variance = sum(float(x @ c @ x) for x, c in zip(d, covariance, strict=True))
    return float(norm_cdf(-0.5 * float((d * d).sum()) / np.sqrt(variance))) if variance > 0 else 1.0


def confused(a: np.ndarray, b: np.ndarray, covariance: list[np.ndarray], most: int | None = None) -> bool:
    x, y, _, _ = align(a, b, len(covariance), most, pad=True)
    return confusion(x, y, covariance) > CONFUSED


def merge_test(first: np.ndarray, second: np.ndarray, p_cut: float, method: str = "template_pca", channels: int = 1, main: int = 0, weighted: bool = True, check: int | None = 100, most: int | None = 5, merge_only: bool = False, split_only: bool = False, match_size: bool = False, check_splits: bool = False, seed: int = 0) -> tuple[bool, np.ndarray, np.ndarray]:
    """(merged, labels of the first clips, labels of the second): whether the cut test lets two units stay apart, on the
    features named by ``method``: pca, pca_by_channel, template_pca, channel_template_pca or projection."""
    clips = np.vstack([first, second]).astype(np.float64)
    labels = np.repeat([1, 2], [len(first), len(second)])
    if method == "pca":
        scores = clustering.pca_features(clips, check, most, seed=seed)
    elif method == "pca_by_channel":
        scores = clustering.pca_by_channel(clips, main, channels, check, most, seed)
    elif method == "template_pca":
        scores = clustering.template_features(clips, labels, most, weighted)
    elif method == "channel_template_pca":
        scores = clustering.template_features_by_channel(clips, labels, main, channels, check, most, weighted)
    elif method == "projection":
        templates = [np.median(x, axis=0) * (len(x) / len(clips) if weighted else 1) for x in (first, second)]
        scores = clips @ np.stack(templates).T
    else:
        raise ValueError(f"no such features: {method}")
    labels = clustering.merge_clusters(scores, labels, p_cut, merge_only=merge_only, split_only=split_only, match_size=match_size, check_splits=check_splits, seed=seed)
    return len(np.unique(labels)) == 1, labels[: len(first)], labels[len(first) :]


def check_alignment(clips: np.ndarray, events: np.ndarray, labels: np.ndarray, p_cut: float = 0.01, check: int | None = 100, most: int | None = 5, seed: int = 0) -> tuple[np.ndarray, bool]:
    """(events, whether any moved): clusters of one channel's clips that are the same once shifted are put at one place.

    The pair of templates that correlates best is settled first. If it needs no shift, the smaller cluster is done; if the
    shifted clips merge, the smaller cluster moves, with all that follow it, and is done; else both are.
    """
    events = events.copy()
    names = np.unique(labels)
    templates = {c: clips[labels == c].mean(axis=0) for c in names}
    sizes = {c: int((labels == c).sum()) for c in names}
    scores = {(a, b): np.correlate(templates[a], templates[b], mode="full") for i, a in enumerate(names) for b in names[i + 1 :]}
    left, follow, moved = list(names), {c: [] for c in names}, False
    while len(left) > 1:
        pair = max(((a, b) for i, a in enumerate(left) for b in left[i + 1 :]), key=lambda p: scores[p].max())
        shift = int(scores[pair].argmax()) - len(scores[pair]) // 2
        a, b = pair
        small, large, by = (b, a, -shift) if sizes[a] >= sizes[b] else (a, b, shift)
        if shift:
            x, y = shifted(clips[labels == a], 1, shift, True), shifted(clips[labels == b], 1, shift, False)
            if not merge_test(x, y, p_cut, "pca", check=check, most=most, merge_only=True, seed=seed)[0]:
                left = [c for c in left if c not in pair]
                continue
            moved = True
            for c in [small, *follow[small]]:
                events[labels == c] += by
            follow[large].append(small)
        left.remove(small)
    return events, moved


@dataclass
class Unit:
    """A segment's unit: its channel and that channel's neighbors, ordered events with their clips on all channels."""

    channel: int
    neighbors: np.ndarray
    events: np.ndarray
    clips: np.ndarray
    label: int = 0
    thresholds: np.ndarray | None = None
    template: np.ndarray = field(init=False)
    snr: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.events, kind="stable")
        self.events, self.clips = np.asarray(self.events)[order], np.asarray(self.clips, dtype=np.float64)[order]


def keep_of_duplicates(events: np.ndarray, clips: np.ndarray, template: np.ndarray, tolerance: int) -> np.ndarray:
    """Mask: of events at most ``tolerance`` apart the one whose clip is nearer to the template stays and meets the next."""
    error = ((clips - template) ** 2).sum(axis=1)
    keep, held = np.ones(len(events), dtype=bool), 0
    for k in range(1, len(events)):
        if events[k] - events[held] <= tolerance:
            gone, held = (held, k) if error[k] < error[held] else (k, held)
            keep[gone] = False
        else:
            held = k
    return keep


def summarise(unit: Unit, sigma: float, tolerance: int, least: float = LEAST_SNR) -> Unit | None:
    """A unit without repeated events, with its median template and the SNR of each channel ((max - min) over three
    deviations of the noise); None where its own channel's is too low or no channel stands out."""
    unit.template = np.median(unit.clips, axis=0)
    keep = keep_of_duplicates(unit.events, unit.clips, unit.template, tolerance)
    unit.events, unit.clips = unit.events[keep], unit.clips[keep]
    unit.template = np.median(unit.clips, axis=0)
    grid = unit.template.reshape(len(unit.thresholds), -1)
    unit.snr = np.ptp(grid, axis=1) / (3 * unit.thresholds / sigma)
    unit.high = np.flatnonzero(unit.snr > LEAST_CHANNEL_SNR)
    return None if unit.snr[unit.channel] < least or not len(unit.high) else unit


def without_weak_channels(template: np.ndarray, snr: np.ndarray, least: float | None) -> np.ndarray:
    """A template with zeros on the channels whose SNR is below ``least``."""
    if not least or least <= 0:
        return template
    return (template.reshape(len(snr), -1) * (np.asarray(snr) >= least)[:, None]).ravel()


def nearest_pair(units: list[Unit], left: list[int], done: set[tuple[int, int]], channels: int, most: int) -> tuple[int, int, int] | None:
    """(later, earlier, shift) of the units in reach of each other whose templates differ least per value at their best
    shift; pairs that differ by more than half of the smaller one's energy are done and passed over."""
    found = []
    for i in left:
        for j in left:
            if j >= i or (i, j) in done:
                continue
            a, b = units[i], units[j]
            if b.channel not in a.neighbors:
                done.add((i, j))
                continue
            shift = correlation_shift(a.template, b.template)  # over channels joined as one
            if abs(shift) <= most:
                n = len(a.template)
                d = a.template[max(0, shift) : n + min(0, shift)] - b.template[max(0, -shift) : n - max(0, shift)]
                found.append((float((d * d).sum()) / len(d), i, j, shift))
    for far, i, j, shift in sorted(found, key=lambda f: f[0]):
        a, b = units[i], units[j]
        least = min(float((u.template**2).sum()) for u in (a, b)) / (len(a.template) - abs(shift))
        if far < NEAR * least and (len(a.high) or len(b.high)):
            return i, j, shift
        done.add((i, j))
    return None


def sharpen(units: list[Unit], channels: int, most: int, p_cut: float, covariance: list[np.ndarray] | None = None, templates: list[np.ndarray] | None = None, check: int | None = 100, components: int | None = 5, seed: int = 0, **options) -> list[Unit]:
    """Units of one segment with those merged that are one source: the nearest pair is tested first, by confusion of
    ``templates`` (the units' own by default) where the noise's covariance is given, else by the cut test on two kinds
    of features. The unit of fewer events goes, its events and template join the other's."""
    left, done, merges = list(range(len(units))), set(), []
    while len(left) > 1 and (found := nearest_pair(units, left, done, channels, most)):
        i, j, shift = found
        a, b = units[i], units[j]
        used = np.isin(np.arange(channels), np.union1d(a.high, b.high))
        x, y = (c.reshape(len(c), channels, -1)[:, used].reshape(len(c), -1) for c in (shifted(a.clips, channels, shift, True), shifted(b.clips, channels, shift, False)))
        if len(x) == 1 or len(y) == 1:
            same = True
        elif covariance is not None:
            own = templates or [u.template for u in units]
            same = confused(own[i], own[j], covariance)
        else:
            tests = ("pca_by_channel", "template_pca")
            same = all(merge_test(x, y, p_cut, m, int(used.sum()), 0, False, check, components, seed=seed, **options)[0] for m in tests)
        done.add((i, j))
        if same:
            keep, gone, by = (i, j, shift) if len(a.events) > len(b.events) else (j, i, -shift)
            left.remove(gone)
            merges.append((keep, gone, by))
        else:
            left = [k for k in left if k not in (i, j)]
    sizes = [len(u.events) for u in units]
    for keep, gone, by in merges:
        a, b = units[keep], units[gone]
        width = len(b.template) // channels
        moved = np.zeros((channels, width))
        moved[:, max(0, by) : width + min(0, by)] = b.template.reshape(channels, width)[:, max(0, -by) : width - max(0, by)]
        share = sizes[keep] / (sizes[keep] + sizes[gone])
        a.template = share * a.template + (1 - share) * moved.ravel()
        sizes[keep] += sizes[gone]
        a.events = np.sort(np.concatenate([a.events, b.events + by]))
        a.neighbors, a.high = np.union1d(a.neighbors, b.neighbors), np.union1d(a.high, b.high)
    dropped = {gone for _, gone, _ in merges}
    return [u for k, u in enumerate(units) if k not in dropped]


def stitch_pair(first: dict[int, np.ndarray], second: dict[int, np.ndarray], channels: int, main: int, most: int, p_cut: float, components: int | None = 5, seed: int = 0, **options) -> list[tuple[int, int]]:
    """Pairs (label of the first segment, label of the second) that are one unit. ``first`` and ``second`` hold the clips
    in the time that the segments share. Of the labels left the pair is tested whose mean clips differ least per value at
    their best shift on the main channel; a pair that merges is linked and done, else the first one's label is."""
    found = []
    for a, x in first.items():
        for b, y in second.items():
            if len(x) and len(y):
                s, t = x.mean(axis=0), y.mean(axis=0)
                width = len(s) // channels
                part = slice(main * width, (main + 1) * width)
                shift = correlation_shift(s[part], t[part])
                if abs(shift) <= most:
                    n = len(s)
                    d = s[max(0, shift) : n + min(0, shift)] - t[max(0, -shift) : n - max(0, shift)]
                    found.append((float((d * d).sum()) / len(d), a, b, shift))
    left, right, links = set(first), set(second), []
    for _, a, b, shift in sorted(found, key=lambda f: f[0]):
        if a in left and b in right:
            left.discard(a)
            x, y = shifted(first[a], channels, shift, True), shifted(second[b], channels, shift, False)
            if len(x) > 1 and len(y) > 1 and merge_test(x, y, p_cut, "template_pca", channels, main, True, most=components, merge_only=True, seed=seed, **options)[0]:
                right.discard(b)
                links.append((a, b))
    return links


def coincident_pairs(left: tuple, right: tuple, span: int, limit: float | None, chunk: int = 128, window: int = 2048) -> tuple[np.ndarray, ...]:
    """(a, b, expected, actual, delta_max) of all pairs a < b of a unit of ``left`` and one of ``right`` on another channel
    that share a bin at a lag of at most ``span``; with ``limit`` of those with actual >= limit * delta_max + expected.

    A side is (ids, channels, sizes, unit, bin): the distinct bins, ascending, each with its unit's place in ids. Lag by
    lag a correlogram counts the bins of a that, moved by the lag, are bins of b. The product of two 0/1 matrices, units
    by bins, counts them for all pairs; its axis are the bins of ``left``, in windows. Sums stay below 2 ** 24, so single
    precision is exact within a window.
    """
    (ids, channels, sizes, unit, at), (other_ids, other_channels, other_sizes, other_unit, other_at) = left, right
    lags = np.arange(-span, span + 1)
    axis = np.unique(at)
    edges = [axis[k : k + window] for k in range(0, len(axis), window)]

    def rows_of(cols: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(at, cols[0]), np.searchsorted(at, cols[-1], side="right")
        dense = np.zeros((len(ids), len(cols)), dtype=np.float32)
        dense[unit[lo:hi], np.searchsorted(cols, at[lo:hi])] = 1
        return dense

    alone = rows_of(edges[0]) if len(edges) == 1 else None
    found = []
    for first in range(0, len(other_ids), chunk):
        some = np.flatnonzero((other_unit >= first) & (other_unit < first + chunk))
        y, who, n = other_at[some], other_unit[some] - first, min(chunk, len(other_ids) - first)
        counts = np.zeros((len(ids), len(lags) * n), dtype=np.int32)
        for cols in edges:
            lo, hi = np.searchsorted(y, cols[0] - span), np.searchsorted(y, cols[-1] + span, side="right")
            if lo == hi:
                continue
            moved = np.zeros((len(cols), len(lags), n), dtype=np.float32)
            for k, lag in enumerate(lags):
                x = y[lo:hi] - lag
                place = np.minimum(np.searchsorted(cols, x), len(cols) - 1)
                hit = cols[place] == x
                moved[place[hit], k, who[lo:hi][hit]] = 1
            counts += ((rows_of(cols) if alone is None else alone) @ moved.reshape(len(cols), -1)).astype(np.int32)
        counts = counts.reshape(len(ids), len(lags), n)
        part = slice(first, first + n)
        asked = (ids[:, None] < other_ids[None, part]) & (channels[:, None] != other_channels[None, part])
        sides = np.maximum(counts[:, span - 1], counts[:, span + 1])
        if limit is not None and limit > 0:  # a pair of no less than its sides; without a bin at lag zero its step is above zero
            asked &= (counts[:, span] >= sides) & (counts[:, span] > 0)
        else:
            asked &= counts.any(axis=1)
        i, j = np.nonzero(asked)
        steps = np.abs(np.diff(counts[i, :, j], axis=1))
        steps[:, span - 1 : span + 1] = 0  # into and out of lag zero
        least = np.minimum(sizes[i], other_sizes[first + j]).astype(np.float64)
        expected, actual, delta = sides[i, j] / least, counts[i, span, j] / least, steps.max(axis=1, initial=0) / least
        keep = np.ones(len(i), dtype=bool) if limit is None else actual >= limit * delta + expected
        found.append((ids[i[keep]], other_ids[first + j[keep]], expected[keep], actual[keep], delta[keep]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5))


def worse_of(a: int, b: int, mua: np.ndarray, snr: np.ndarray, n: np.ndarray, lost, partners, mixed) -> int:
    """Which of a redundant pair goes, by the rule of ``units.drop_redundant``. ``lost()`` gives the quality of each one's
    best partner that the other does not share less its own (0 without one), ``partners(x)`` the number of x's partners,
    ``mixed()`` whether the joined train is dirtier than either."""
    if np.isnan(mua[a]) and np.isnan(mua[b]):
        return b if snr[a] * n[a] > snr[b] * n[b] else a
    if np.isnan(mua[a]) or np.isnan(mua[b]):
        return a if np.isnan(mua[a]) else b
    lose_a, lose_b = lost()
    if lose_a != lose_b:
        return a if lose_a > lose_b else b
    clean = {x: (1 - mua[x]) * snr[x] for x in (a, b)}
    worse, other = (b, a) if clean[a] * n[a] > clean[b] * n[b] else (a, b)
    if clean[worse] > clean[other] and (partners(worse) < partners(other) or mixed()):
        return other
    return worse


def packed_bins(bins: list[np.ndarray], first: int, words: int, span: int = 10) -> np.ndarray:
    """Trains as bits, one row of 64-bit words each; bin ``first`` is bit ``span``, so that moves by ``span`` lose none."""
    dense = np.zeros((len(bins), 64 * words), dtype=np.uint8)
    dense[np.repeat(np.arange(len(bins)), [len(x) for x in bins]), np.concatenate(bins) - first + span] = 1
    return np.packbits(dense, axis=1, bitorder="little").view(np.uint64)


def moved_bits(bits: np.ndarray, span: int = 10) -> np.ndarray:
    """(rows, 2 * span + 1, words): trains moved by each lag from -span to span."""
    by = np.arange(1, span + 1, dtype=np.uint64)[None, :, None]
    back = np.uint64(64) - by
    x, none = bits[:, None, :], np.zeros((len(bits), 1, 1), dtype=np.uint64)
    later = (x << by) | (np.concatenate([none, x[:, :, :-1]], axis=2) >> back)
    sooner = (x >> by) | (np.concatenate([x[:, :, 1:], none], axis=2) << back)
    return np.concatenate([sooner[:, ::-1], x, later], axis=1)


def beyond_chance(moved: np.ndarray, other: np.ndarray, least: np.ndarray, limit: float) -> np.ndarray:
    """Which trains of ``moved`` (``moved_bits``) coincide with those of ``other`` beyond chance (``units.redundant_pairs``)."""
    span = moved.shape[1] // 2
    c = np.bitwise_count(moved & other[:, None, :]).sum(axis=2, dtype=np.int32)
    steps = np.abs(np.diff(c, axis=1))
    steps[:, span - 1 : span + 1] = 0  # into and out of lag zero
    sides = np.maximum(c[:, span - 1], c[:, span + 1])
    return (c[:, span] > 0) & (c[:, span] / least >= limit * (steps.max(axis=1) / least) + sides / least)


def highest_pairs(left: tuple, right: tuple, limit: float, floor: float, most: int | None, same: np.ndarray | None = None, span: int = 10, chunk: int = 256, window: int = 1 << 10) -> tuple:
    """(i, j, ratio, floor): pairs of a train of ``left`` and one of ``right``, each (sizes, bits), that coincide beyond
    chance, with a share of coincident bins of at least the floor given back. That is ``floor``, or higher if there are
    more than ``most`` pairs: a share is given out with all of its pairs or not at all, the highest in any case. ``same``
    says that both sides are one, where i <= j, and which of its trains are paired with themselves.

    Bins at lag zero are counted by matrix products, exact in single precision; what is left is judged by its bits.
    """
    (sizes, bits), (other_sizes, other_bits) = left, right
    words = bits.shape[1]
    edges = [(k, min(words, k + window // 64)) for k in range(0, words, window // 64)]
    dense = lambda x, lo, hi: np.unpackbits(np.ascontiguousarray(x[:, lo:hi]).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    turned = [np.ascontiguousarray(x) for x in moved_bits(other_bits, 1).swapaxes(0, 1)] if floor == 0 else [None, other_bits, None]
    ready = {k: dense(x, 0, words) for k, x in enumerate(turned) if x is not None} if len(edges) == 1 else {}

    def shared(part: np.ndarray, k: int) -> np.ndarray:
        """Common bins of the trains of ``part`` and those of the other side moved by k - 1; windows without any are left out."""
        counts = np.zeros((len(part), len(other_bits)), dtype=np.float32)
        for lo, hi in edges:
            if part[:, lo:hi].any() and turned[k][:, lo:hi].any():
                counts += dense(part, lo, hi) @ (ready[k] if ready else dense(turned[k], lo, hi)).T
        return counts

    batch = max(64, (1 << 22) // ((2 * span + 1) * words))
    found, held, bar = [], 0, floor
    for first in range(0, len(bits), chunk):
        part = bits[first : first + chunk]
        at_zero = shared(part, 1)
        asked = at_zero > 0
        if bar > 0:
            low = bar * (1 - 1e-6)
            asked &= (at_zero >= (low * sizes[first : first + chunk]).astype(np.float32)[:, None] - 1e-3) | (at_zero >= (low * other_sizes).astype(np.float32)[None, :] - 1e-3)
        else:  # most pairs have a higher side
            asked &= (shared(part, 0) <= at_zero) & (shared(part, 2) <= at_zero)
        if same is not None:
            own = np.arange(len(part))
            asked &= (own + first)[:, None] <= np.arange(len(other_bits))[None, :]
            asked[own, own + first] &= same[first : first + chunk]
        i, j = np.nonzero(asked)
        least = np.minimum(sizes[first + i], other_sizes[j]).astype(np.float64)
        ratio = at_zero[i, j] / least
        take = np.flatnonzero(ratio >= bar)
        i, j, least, ratio = i[take], j[take], least[take], ratio[take]
        moved = moved_bits(part, span) if len(part) * (2 * span + 1) * words <= 1 << 24 else None
        keep = np.zeros(len(i), dtype=bool)
        for lo in range(0, len(i), batch):
            some = slice(lo, lo + batch)
            shifts = moved_bits(part[i[some]], span) if moved is None else moved[i[some]]
            keep[some] = beyond_chance(shifts, other_bits[j[some]], least[some], limit)
        found.append((first + i[keep], j[keep], ratio[keep]))
        held += int(keep.sum())
        if most is not None and held > 2 * most:
            found, bar = _highest(found, most, bar)
            held = len(found[0][2])
    if most is not None and held > most:
        found, bar = _highest(found, most, bar)
    i, j, ratio = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=(np.int64, np.int64, np.float64)[k]) for k in range(3))
    return i, j, ratio, bar


def _highest(found: list, most: int, bar: float) -> tuple[list, float]:
    i, j, ratio = (np.concatenate([f[k] for f in found]) for k in range(3))
    cut = np.partition(ratio, len(ratio) - most - 1)[len(ratio) - most - 1]  # the highest share that does not fit
    above = ratio[ratio > cut]
    bar = max(bar, float(above.min()) if len(above) else float(cut))
    keep = ratio >= bar
    return [(i[keep], j[keep], ratio[keep])], bar


def settle_highest(kind: np.ndarray, channel: np.ndarray, sizes: np.ndarray, bits: np.ndarray, mua: np.ndarray, snr: np.ndarray, n: np.ndarray, edges: tuple, limit: float, span: int = 10) -> list[int]:
    """Places of the units that go, by the rule of ``units.drop_redundant``, as far as the pairs ``edges`` (kinds a and b,
    ratio) lead; units are in the order of their names, those of a kind have the same train and size.

    Partners are looked up when a pair is settled: units come in the order of their quality, and the first that is a
    partner of one and not of the other is its best. So a pair costs a few correlograms, not one for each partner.
    """
    clean = np.where(np.isnan(mua), 0.0, 1 - mua) * snr
    quality = clean * n
    order = np.lexsort((np.arange(len(n)), -quality, ~np.isnan(quality)))  # a maximum is NaN if any value is
    there = np.ones(len(n), dtype=bool)
    names, of = np.unique(kind, return_inverse=True)
    alive = np.bincount(of)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(alive)[:-1])
    gone: list[int] = []
    dead = 0

    def partners(x: int, some: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
        moved = moved_bits(bits[x : x + 1], span) if moved is None else moved
        near = beyond_chance(moved, bits[some], np.minimum(sizes[x], sizes[some]), limit)
        return near & (channel[some] != channel[x]) & (some != x)

    def lost(a: int, b: int) -> tuple[float, float]:
        best: list[int | None] = [None, None]
        if kind[a] == kind[b]:  # of equal trains only units on the other's channel are not shared
            pools = [order[channel[order] == channel[y]] if shared_channels else order[:0] for y in (b, a)]
            for k, (x, y) in enumerate(((a, b), (b, a))):
                some = pools[k][there[pools[k]] & (pools[k] != y)]
                hit = some[partners(x, some) & ~partners(y, some)] if len(some) else some
                best[k] = int(hit[0]) if len(hit) else None
        else:
            shifts = [moved_bits(bits[x : x + 1], span) for x in (a, b)]
            at, step = 0, 64
            while at < len(order) and None in best:
                some = order[at : at + step]
                some = some[there[some] & (some != a) & (some != b)]
                at, step = at + step, min(2 * step, max(64, (1 << 20) // bits.shape[1] // 21))
                near = [partners(x, some, s) for x, s in zip((a, b), shifts, strict=True)] if len(some) else []
                for k in range(2 if near else 0):
                    hit = np.flatnonzero(near[k] & ~near[1 - k])
                    if best[k] is None and len(hit):
                        best[k] = int(some[hit[0]])
        return tuple((quality[x] if p is None else quality[p]) - quality[x] for x, p in zip((a, b), best, strict=True))

    def count(x: int) -> int:
        moved = moved_bits(bits[x : x + 1], span)
        some = order[there[order]]
        step = max(64, (1 << 22) // bits.shape[1] // 21)
        return 1 + sum(int(partners(x, some[k : k + step], moved).sum()) for k in range(0, len(some), step))

    shared_channels = len(np.unique(channel)) < len(channel)
    ka, kb, ratios = np.searchsorted(names, edges[0]), np.searchsorted(names, edges[1]), edges[2]
    sort = np.argsort(-ratios, kind="stable")
    sort = sort[ratios[sort] > 0]
    ends = np.flatnonzero(np.append(np.diff(ratios[sort]) != 0, True)) + 1 if len(sort) else []
    begin = 0
    for end in ends:
        level, begin = sort[begin:end], end
        x, y = ka[level], kb[level]
        asked = (alive[x] > 0) & (alive[y] > np.where(x == y, 1, 0))
        x, y = x[asked], y[asked]
        if not len(x):
            continue
        apart = x != y
        x, y = np.concatenate([x, y[apart]]), np.concatenate([y, x[apart]])
        by_first = np.argsort(x, kind="stable")
        x, y = x[by_first], y[by_first]
        firsts = np.sort(np.concatenate([members[k] for k in np.unique(x)]))
        for first in firsts[there[firsts]].tolist():
            if not there[first]:
                continue
            lo, hi = np.searchsorted(x, of[first]), np.searchsorted(x, of[first], side="right")
            lists = [_after(members[k], first) for k in y[lo:hi][alive[y[lo:hi]] > 0].tolist()]
            for second in lists[0] if len(lists) == 1 else heapq.merge(*lists):
                if not there[second] or channel[first] == channel[second]:
                    continue
                worse = worse_of(first, second, mua, snr, n, lambda a=first, b=second: lost(a, b), count, lambda: False)
                there[worse] = False
                alive[of[worse]] -= 1
                gone.append(worse)
                dead += 1
                if 8 * dead > len(order):
                    order, dead = order[there[order]], 0
                if worse == first:
                    break
    return gone


def _after(places: np.ndarray, first: int, step: int = 1024):
    """The places beyond ``first``, one by one."""
    for k in range(int(np.searchsorted(places, first, side="right")), len(places), step):
        yield from places[k : k + step].tolist()
