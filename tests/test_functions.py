import math

import numpy as np
import pytest

from fluxweave.functions import clustering, covariance, density, nummath, pursuit, synthetic
from fluxweave.operators import filters
from fluxweave.operators.settings import SortSettings
from fluxweave.operators.signal import plan_segments, time_window_samples


def test_normal_and_chi_square():
    assert nummath.norm_cdf(0.0) == 0.5
    assert abs(nummath.norm_sf(np.array([1.959964]))[0] - 0.025) < 1e-6
    for k, q, x in ((1, 0.05, 3.841459), (4, 0.5, 3.356694), (10, 0.025, 20.483177)):
        assert abs(nummath.chi2_isf(q, k) - x) < 1e-5
        assert abs(nummath.chi2_sf(x, k) - q) < 1e-6


def test_cosine_transform():
    x = np.random.default_rng(0).normal(size=32)
    k, j = np.arange(32)[:, None], np.arange(32)[None, :]
    assert np.allclose(nummath.dct2(x), (2 * x[None, :] * np.cos(np.pi * k * (2 * j + 1) / 64)).sum(axis=1))
    assert np.allclose(nummath.idct2(nummath.dct2(x)), x)


def test_bandpass_keeps_the_band():
    b, a = nummath.bandpass_coefficients(300, 3000, 20_000)
    t = np.arange(20_000) / 20_000
    gain = lambda f: nummath.filtfilt(b, a, np.sin(2 * np.pi * f * t))[5000:15000].std() / np.sqrt(0.5)
    assert gain(1000) > 0.9 and gain(20) < 0.02
    z = np.exp(1j * 2 * np.pi * 300 / 20_000)
    assert abs(abs(np.polyval(b, z) / np.polyval(a, z)) - math.sqrt(0.5)) < 1e-9


def test_isotonic_prefix_and_mode():
    y = np.array([1.0, 3, 2, 5, 9, 7, 8, 2, 1])
    fit, mode = density.up_down(y, np.ones(9))
    assert mode in (3, 4) and (np.diff(fit[: mode + 1]) >= 0).all() and (np.diff(fit[mode + 1 :]) <= 0).all()
    assert np.allclose(density.pava(np.array([3.0, 1, 2]), np.ones(3)), 2)
    errors = density.prefix_errors(y, np.ones(9))
    for i in range(1, 10):
        assert abs(errors[i] - ((density.pava(y[:i], np.ones(i)) - y[:i]) ** 2).sum()) < 1e-9


def test_multinomial_exact():
    t = density.MultinomialTest(np.array([3, 0]), np.array([0.5, 0.5]))
    assert abs(t.exact() - 0.25) < 1e-12
    assert len(list(density.MultinomialTest(np.array([2, 1, 0]), np.ones(3)).cases())) == 10


def test_density_integrates_to_one():
    x = np.random.default_rng(1).normal(size=2000)
    f, mesh, h = density.kde(x, 64)
    assert abs(f.sum() * (mesh[1] - mesh[0]) - 1) < 0.05 and 0.05 < h < 1


def test_cut_parts_two_modes_and_leaves_one():
    rng = np.random.default_rng(2)
    one = rng.normal(size=2000)
    two = np.concatenate([rng.normal(-4, 1, 1000), rng.normal(4, 1, 1000)])
    assert density.iso_cut(one, 0.01)[1] is None
    p, cut = density.iso_cut(two, 0.01)
    assert p < 0.01 and abs(cut) < 2
    assert density.iso_cut(np.array([1.0, 2.0]), 0.01) == (1.0, None)
    assert density.iso_cut(np.full(50, 3.0), 0.01)[1] is None


def test_clusters_of_a_mixture():
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 2], 300)
    x = rng.normal(size=(900, 3)) + 9 * np.eye(3)[truth]
    labels = clustering.merge_clusters(x, clustering.seed_farthest(x, 30, n_random=9), 0.01)
    agree = sum(np.bincount(labels[truth == c]).max() for c in range(3)) / 900
    assert len(np.unique(labels)) <= 4 and agree > 0.95
    assert (clustering.seed_farthest(x[:5], 10) == 0).all()
    assert clustering.dense(np.array([7, 3, 7])).tolist() == [1, 0, 1]


def test_mutual_pairs_skip_those_done():
    x = np.array([[0.0, 0], [1, 0], [10, 0], [11.5, 0]])
    assert clustering.mutual_pairs(x, np.arange(4), set()) == [(0, 1), (2, 3)]
    assert (0, 1) not in clustering.mutual_pairs(x, np.arange(4), {(0, 1)})


def test_robust_covariance_ignores_outliers():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 2)), rng.normal(30, 1, size=(60, 2))])
    centre, cov, inside = covariance.min_cov_det(x)
    assert np.abs(centre).max() < 0.3 and np.abs(cov - np.eye(2)).max() < 0.5 and not inside[400:].any()


def test_pursuit_finds_overlapping_events():
    rng = np.random.default_rng(6)
    width = 30
    shapes = np.stack([np.outer([5.0, 1.0], synthetic.waveform(width, 0)), np.outer([1.0, 6.0], synthetic.waveform(width, 1))])
    v = rng.normal(0, 0.2, size=(2, 4000))
    truth = [(0, 100), (1, 112), (0, 700), (1, 1500), (0, 1503), (1, 3000)]
    for u, t in truth:
        v[:, t : t + width] += shapes[u]
    thresholds = np.full(2, 5.0)
    for reach in (0, 8):
        units, starts, residual = pursuit.pursue(v, shapes, thresholds, reach)
        assert sorted(zip(units.tolist(), starts.tolist(), strict=True)) == sorted(truth)
        assert residual.std() < 0.3


def test_whitening_and_wiener():
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(3, 3))
    cov = np.cov(mix @ rng.normal(size=(3, 5000)))
    z = filters.zca_matrix(cov)
    white = z @ cov @ z.T
    assert np.abs(white - np.diag(np.diag(white))).max() < 1e-6 and np.allclose(np.diag(z), 1)
    t = np.arange(4096)
    s = np.sin(2 * np.pi * t / 64)
    noisy = s + rng.normal(0, 1, 4096)
    out = filters.wiener_array(noisy, s, noisy - s, 2)
    assert np.corrcoef(out, s)[0, 1] > np.corrcoef(noisy, s)[0, 1] + 0.2


def test_segments_and_windows():
    assert plan_segments(2_400_000, 1_200_000, 600_000) == [(0, 1_200_000), (600_000, 1_800_000), (1_200_000, 2_400_000)]
    assert plan_segments(100, 200, 10) == [(0, 100)]
    assert time_window_samples((-15e-4, 15e-4), 40_000) == (-60, 61)


def test_settings_are_checked():
    assert SortSettings.of(clip_width=(1e-3, 2e-3)).clip_width == (-1e-3, 2e-3)
    assert SortSettings.of(segment_duration=None, check_components=None).ci_multiplier == math.inf
    with pytest.raises(TypeError):
        SortSettings.of(nonsense=1)
    with pytest.raises(ValueError):
        SortSettings.of(sigma=0)
