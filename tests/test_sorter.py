import numpy as np
import pandas as pd
import pytest

from fluxweave.functions import synthetic
from fluxweave.operators.settings import SortSettings
from fluxweave.plans import sorter

FS = 10_000


def frame(spark, v):
    c, n = v.shape
    pdf = pd.DataFrame({"channel": np.repeat(np.arange(c, dtype=np.int32), n), "sample": np.tile(np.arange(n), c), "v": v.ravel()})
    return spark.createDataFrame(pdf)


def recall(found, truth, tolerance=10):
    hit = sum(np.abs(found - t).min() <= tolerance for t in truth) / len(truth)
    good = sum(np.abs(truth - f).min() <= tolerance for f in found) / max(1, len(found))
    return hit, good


@pytest.mark.parametrize("wiener", [False, True])
def test_two_units_end_to_end(spark, wiener):
    scales = np.array([[6.0, 5.0, 1.0, 0.5], [0.5, 1.5, 5.0, 7.0]])
    v, truth = synthetic.recording(8, FS, [30, 40], scales, 30, 0.4, seed=3)
    options = {"segment_duration": 5.0, "segment_overlap": 2.0, "filter_band": (300, 4000), "do_zca": wiener, "sigma": 4.0, "wiener": wiener, "n_cov_samples": 2000}
    result = sorter.sort(frame(spark, v), FS, SortSettings.of(**options))
    neurons, events = sorter.stitch(result)
    events = events.toPandas()
    groups = [np.sort(g["idx"].to_numpy()) for _, g in events.groupby("id")]
    for t in truth:
        scores = [recall(g, t) for g in groups]
        best = max(scores, key=lambda s: s[0] + s[1])
        assert best[0] > 0.85 and best[1] > 0.85, scores
    table = neurons.toPandas()
    assert len(table) == len(groups) and set(table["summary_type"]) == {"across_channels"} and (table["n_spikes"] == [len(g) for _, g in events.groupby("id")]).all()
    assert result.units.count() >= 2 and (result.units.toPandas()["snr"] > 1.5).all()
